"""Compression of vectors into codes of their parts (a product quantiser on whole numbers).

Components become whole numbers, vectors are cut into equal consecutive parts, and each part position has a codebook of
a few entries that rounds of assignment and averaging move. The work of a round is done on the *distinct* parts of a
position, each with its number of occurrences, so a part that a third of all rows share is one leaf.

Distinct parts lie in lexicographic order (a range sort over part position and components). A run of them is a trie:
level j has a node for each different prefix of j + 1 components. The traversal is depth first over blocks of
neighbouring nodes. A node's distances to all entries so far are its parent's plus one square per entry, so parts with
a common prefix share what that prefix costs; a leaf takes the nearest entry and adds its components, times its number,
to that entry's sums. All numbers are whole, so results are exact and don't depend on how rows are partitioned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .vectors import is_finite, matrix, per_length, whole

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Nodes of one level that a step of the traversal holds: BLOCK x ENTRIES distances.
BLOCK = 8192
#: A label's sum is joined under so many keys, so that a label of very many rows is spread.
LABEL_KEYS = 64
#: Beyond this, squares could leave 64 bits: Python's whole numbers take over.
_WIDE = 1 << 28

_CODED = "vec_id long, label string, code string, error long"


def trie_levels(parts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level, its nodes' components and where their children begin on the next level (leaves: rows).

    ``parts``: distinct rows in lexicographic order.
    """
    starts, new = [], np.zeros(len(parts), dtype=bool)
    new[:1] = True
    for j in range(parts.shape[1]):
        new[1:] |= parts[1:, j] != parts[:-1, j]
        starts.append(np.flatnonzero(new))
    ends = [*starts[1:], np.arange(len(parts))]
    return [
        (parts[at, j], np.append(np.searchsorted(below, at), len(below)))
        for j, (at, below) in enumerate(zip(starts, ends, strict=True))
    ]


def leaf_distances(levels: list[tuple[np.ndarray, np.ndarray]], entries: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first leaf, squared distances of some leaves to all entries), in the order of leaves, depth first."""
    stack = [(0, 0, len(levels[0][0]), 0, np.zeros((1, len(entries)), dtype=entries.dtype), np.array([0, len(levels[0][0])]))]
    while stack:
        level, lo, hi, first, above, begins = stack.pop()
        if hi - lo > BLOCK:  # the later half waits
            mid = lo + BLOCK
            stack.append((level, mid, hi, first, above, begins))
            hi = mid
        parent = np.searchsorted(begins, np.arange(lo, hi), side="right") - 1
        values, children = levels[level]
        step = values[lo:hi, None] - entries[None, :, level]
        distances = above[parent] + step * step
        if level + 1 == len(levels):
            yield lo, distances
        else:
            stack.append((level + 1, int(children[lo]), int(children[hi]), lo, distances, children[lo : hi + 1]))


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row; ``parts`` distinct and in lexicographic order."""
    if not parts.shape[1] or not len(parts):
        return np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=np.int64)
    if max(int(np.abs(parts).max()), int(np.abs(entries).max())) >= _WIDE:
        parts, entries = parts.astype(object), entries.astype(object)
    index, error = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=entries.dtype)
    for lo, d in leaf_distances(trie_levels(parts), entries):
        best = d.argmin(axis=1).astype(np.int64)
        index[lo : lo + len(d)] = best
        error[lo : lo + len(d)] = np.take_along_axis(d, best[:, None], axis=1)[:, 0]
    return index, error


def _cuts(width: int, parts: int) -> list[int]:
    return [i * width // parts for i in range(parts + 1)]


def _packed_parts(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """``(part, n, leaves, weights)``: distinct parts of each position in lexicographic runs, as bytes."""
    cuts = _cuts(width, parts)
    pieces = F.array(*[F.slice("x", lo + 1, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)])
    each = rows.select(F.posexplode(pieces).alias("part", "v")).groupBy("part", "v").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.repartitionByRange("part", "v").sortWithinPartitions("part", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("part", "n"))
            seams = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for lo, hi in zip(seams, seams[1:], strict=False):
                if lo < hi:
                    p = int(part[lo])
                    leaves = matrix(batch.column("v").slice(lo, hi - lo), cuts[p + 1] - cuts[p])
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([p], pa.int32()), "n": pa.array([hi - lo], pa.int64()),
                        "leaves": pa.array([leaves.astype("<i8").tobytes()], pa.binary()),
                        "weights": pa.array([n[lo:hi].astype("<i8").tobytes()], pa.binary()),
                    })

    return ordered.mapInArrow(pack, "part int, n long, leaves binary, weights binary")


def _moved(packed: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: entries become the floored means of their parts, unused ones stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((b.shape[0], b.shape[1] + 1), dtype=object) for b in books]
        for batch in batches:
            for row in batch.to_pylist():
                book = books[row["part"]]
                leaves = np.frombuffer(row["leaves"], "<i8").reshape(row["n"], book.shape[1])
                weights = np.frombuffer(row["weights"], "<i8")
                index, _ = nearest(leaves, book)
                with_one = np.column_stack((np.ones(len(leaves), dtype=np.int64), leaves)) * weights[:, None]
                for e in np.unique(index):
                    total[row["part"]][e] += with_one[index == e].sum(axis=0).astype(object)
        flat = [(p, e, k, t[e, k]) for p, t in enumerate(total) for e in range(len(t)) for k in range(t.shape[1]) if t[e, 0]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[i] for f in flat], pa.int32()) for i in range(3)] + [pa.array([int(f[3]) for f in flat], pa.int64())],
            names=["part", "entry", "k", "s"],
        )

    got = packed.mapInArrow(sums, "part int, entry int, k int, s long").groupBy("part", "entry", "k").agg(F.sum("s").alias("s"))
    total = {(r.part, r.entry, r.k): r.s for r in got.collect()}
    return [
        np.array([
            [total[p, e, k + 1] // total[p, e, 0] for k in range(b.shape[1])] if (p, e, 0) in total else list(b[e])
            for e in range(len(b))
        ], dtype=np.int64).reshape(b.shape)
        for p, b in enumerate(books)
    ]


def _coded(rows: DataFrame, books: list[np.ndarray], cuts: list[int]) -> DataFrame:
    """``(vec_id, label, code, error)`` of every row."""
    width = cuts[-1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width)
            index, error = np.zeros((len(x), len(books)), dtype=np.int64), [0] * len(x)
            for p, book in enumerate(books):
                part = x[:, cuts[p] : cuts[p + 1]]
                order = np.lexsort(part.T[::-1]) if part.shape[1] else np.arange(len(x))
                sorted_part = part[order]
                new = np.ones(len(x), dtype=bool)
                new[1:] = (sorted_part[1:] != sorted_part[:-1]).any(axis=1)
                best, distance = nearest(sorted_part[new], book)
                leaf = np.cumsum(new) - 1
                index[order, p] = best[leaf]
                own = np.empty(len(x), dtype=distance.dtype)
                own[order] = distance[leaf]
                error = error + own
            codes = ["".join(f"{i:02x}" for i in row) for row in index.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array([int(e) for e in error], pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return rows.select("vec_id", "label", "x").mapInArrow(assign, _CODED)


def encode_vectors(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label",
) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``: one row per usable vector.

    ``code``: the nearest entry of each part, two hex digits each. ``error``: the squared distances summed over parts.
    ``label_error``: that summed over rows with an equal label, NULL labels together (all rows if ``label_col`` is
    None). ``codebooks_sha256``: of the final entries' components by part, entry and position, comma-joined.

    Vectors that are NULL or hold NULL or non-finite components are dropped; all other rows stay, rows with the same id
    and NULL ids too (NULL ids sort last when the first codebook is chosen, equal ids by their vectors). With fewer
    than ``entries`` rows there are as many entries as rows. Ties go to the lower entry. Vectors of another length are
    a collection of their own, with its own codebooks. Where the length can't be divided evenly, parts differ by one
    component. Empty tables give an empty result; other columns are not read.
    """
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    v = F.col(vec_col)
    kept = vectors.where(is_finite(v)).select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), whole(v, scale).alias("x"))

    def one_length(rows: DataFrame, width: int) -> DataFrame:
        first = [r.x for r in rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()]
        cuts = _cuts(width, parts)
        start = np.array(first, dtype=np.int64).reshape(len(first), width)
        books = [start[:, lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]
        packed = cut_lineage(_packed_parts(rows, width, parts))
        for _ in range(rounds):
            books = _moved(packed, books)
        text = ",".join(str(c) for b in books for entry in b.tolist() for c in entry)
        sha = hashlib.sha256(text.encode()).hexdigest()
        return _coded(rows, books, cuts).withColumn("codebooks_sha256", F.lit(sha))

    coded = per_length(kept, "x", one_length)
    if coded is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = cut_lineage(coded)
    keys = F.explode(F.sequence(F.lit(0), F.lit(LABEL_KEYS - 1)))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("__key", keys)
    sums = sums.select(F.col("label").alias("__label"), "__key", "label_error")
    dealt = coded.withColumn("__deal", F.pmod(F.xxhash64("vec_id", "code"), F.lit(LABEL_KEYS)).cast("int"))
    joined = dealt.join(sums, F.col("label").eqNullSafe(F.col("__label")) & (F.col("__deal") == F.col("__key")))
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
