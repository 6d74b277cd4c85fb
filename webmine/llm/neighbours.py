"""Nearest neighbours by a block matrix join.

Vectors are dealt into blocks of bounded size, and every block of queries meets every block of vectors once (an
equi-join on the block number, for a stated query set against all rows). In such a tile the cosines come from a
product of int8 codes. Each code carries the norm of its rounding error, which bounds the error of the product, so a
vector is dropped only if its upper bound lies below the k-th best lower bound of the tile. What survives is computed
again in double precision from the original vectors, and the tiles' best are merged by heaps. The result is exact.

Tiles are made by a sort-merge join: Spark takes the queries, which it repeats for each block, for as small as they were
before, and would broadcast them through the driver.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import merged

#: Vectors in a block, about: a tile's products take BLOCK * BLOCK numbers of memory.
BLOCK = 2048
#: float32 sums int8 products exactly up to this many components.
_EXACT = 1024
_SLACK = 1e-12


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(__id, __v, __dim)``: one row per id, without vectors that are null, empty, zero or not finite throughout.

    Rows that share an id are one record; the smallest of their vectors counts. Rows without an id take no part.
    """
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))
    kept = vectors.select(F.col(id_col).cast("long").alias("__id"), v.alias("__v")).where(
        F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    )
    return kept.groupBy("__id").agg(F.min("__v").alias("__v")).withColumn("__dim", F.size("__v"))


def _packed(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """A row per block: ids and vectors of about BLOCK rows as bytes."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["__v"].to_numpy()).astype("<f8")
        ids = pdf["__id"].to_numpy("<i8")
        return pd.DataFrame({"__dim": [x.shape[1]], name: [int(pdf[name].iloc[0])], "ids": [ids.tobytes()], "vectors": [x.tobytes()]})

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("__id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("__dim", name).applyInPandas(pack, f"__dim int, {name} int, ids binary, vectors binary")


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, their scales, norms of the decoded vectors and of the rounding errors."""
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    code = np.rint(unit / scale)
    error = unit - code * scale
    return code.astype(np.int8), scale[:, 0], np.sqrt(((code * scale) ** 2).sum(axis=1)), np.sqrt((error**2).sum(axis=1))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two (exact), so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _sum(x: np.ndarray) -> np.ndarray:
    """Row sums, added from left to right (as SQL engines do, so that scores agree to the last bit)."""
    return np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def tile_best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, cosines): the k best rows of ``x`` for each query, ties to smaller ids, without the query."""
    q, x = _scaled(q), _scaled(x)
    qc, qs, _, qe = _codes(q)
    xc, xs, xn, xe = _codes(x)
    product = np.zeros((len(q), len(x)), dtype=np.float64)
    for lo in range(0, q.shape[1], _EXACT):
        product += qc[:, lo : lo + _EXACT].astype(np.float32) @ xc[:, lo : lo + _EXACT].astype(np.float32).T
    near = product * qs[:, None] * xs[None, :]
    bound = xe[None, :] + qe[:, None] * xn[None, :] + _SLACK
    lower = near - bound
    own = q_ids[:, None] == ids[None, :]
    lower[own] = -np.inf
    upper = np.where(own, -np.inf, near + bound)
    floor = np.partition(lower, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(q), -np.inf)
    qi, xi = np.nonzero((upper >= floor[:, None]) & ~own)
    a, b = q[qi], x[xi]
    cosine = np.clip(_sum(a * b) / np.sqrt(_sum(a * a) * _sum(b * b)), -1, 1)
    order = np.lexsort((ids[xi], -cosine, qi))
    qi, xi, cosine = qi[order], xi[order], cosine[order]
    first = np.searchsorted(qi, np.arange(len(q) + 1))
    for i in range(len(q)):
        best = slice(first[i], min(first[i] + k, first[i + 1]))
        yield int(q_ids[i]), ids[xi[best]], cosine[best]


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows of ``vectors`` with the largest cosine to each query.

    The row with the query's own id is no candidate; ties go to the smaller id; ranks start at 1. Vectors that are
    null, empty, zero or hold null or non-finite components take no part on either side; only vectors of the same
    length are compared. Rows that share an id are one record. A query without candidates has no rows, empty tables
    give an empty result, extra columns are not read.
    """
    rows = cut_lineage(usable_vectors(vectors, id_col, vec_col))
    asked = cut_lineage(usable_vectors(queries, id_col, vec_col))
    n_blocks, n_asked = (max(1, math.ceil(x.count() / BLOCK)) for x in (rows, asked))
    data = _packed(rows, n_blocks, "__block")
    ask = _packed(asked, n_asked, "__part").withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"})
    ask = ask.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    tiles = ask.join(merged(data), ["__dim", "__block"])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples(index=False):
                d = int(t.dim)
                got = [(qid, ids, s) for qid, ids, s in tile_best(
                    np.frombuffer(t.q_ids, "<i8"), np.frombuffer(t.q_vectors, "<f8").reshape(-1, d),
                    np.frombuffer(t.ids, "<i8"), np.frombuffer(t.vectors, "<f8").reshape(-1, d), k)]
                yield pd.DataFrame(got, columns=["query_id", "ids", "scores"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [list(zip((-s).tolist(), ids.tolist(), strict=True)) for ids, s in zip(pdf["ids"], pdf["scores"], strict=True)]
        top = [x for x, _ in zip(heapq.merge(*lists), range(k), strict=False)]
        return pd.DataFrame({
            "query_id": int(pdf["query_id"].iloc[0]), "rank": range(1, len(top) + 1),
            "vec_id": [i for _, i in top], "score": [-s for s, _ in top],
        })

    found = tiles.select(F.col("__dim").alias("dim"), "q_ids", "q_vectors", "ids", "vectors").mapInPandas(
        best, "query_id long, ids array<long>, scores array<double>"
    )
    return found.groupBy("query_id").applyInPandas(merge, "query_id long, rank int, vec_id long, score double")
