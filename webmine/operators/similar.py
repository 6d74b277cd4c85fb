"""Exact and near-duplicate bodies per host.

Similarity is the Jaccard index of word-3-shingle sets (lower-cased text split on ASCII whitespace). A body is dropped
when it is exact-equal to, or at least 97% similar to, an *earlier* (smaller id) body of the same host — "earlier"
rather than "earlier kept", which is order-free (differs only when A~B, B~C and A!~C).

Plan: one map-side pass computes each body's content hash and, over slices of Arrow batches (numpy inside), its
shingle hashes and MinHash signature, so the body text is never shuffled. Exact copies are grouped on the hash (narrow
columns), and only representatives go on, of those only the ones that share a signature band with another body.
(Below a cut of BAND_CUT all go on.) They meet in a prefix-filter join: a body's shingles are ordered by rarity in its
group, and two similar bodies must share one of their rarest. How many of them count follows from both sizes, so bodies
are met by shingle *and* size classes: pages of one template with a few own words have only own shingles there and
don't meet at all, unless they are similar. Each (group, shingle, size classes) bucket is searched leader-first: a body is verified against the
bucket's smallest id, and only when that leader is not similar against the other earlier members below the best match
so far. Verification is the exact Jaccard on the shingle-hash sets (JVM side).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.patterns import BODY_SIMILARITY_CUT
from ..session import cut_lineage

N_BANDS, ROWS_PER_BAND = 24, 8  # P(miss | J=0.97) = (1 - 0.97^8)^24 < 1e-15; P(candidate | J=0.5) < 0.1
#: From this similarity on, bodies without a common band are left out first (a pair is missed less than once in 10^11).
BAND_CUT = 95
_NUM_HASHES = N_BANDS * ROWS_PER_BAND
_rng = np.random.default_rng(20240611)
_A = (_rng.integers(1, 2**63 - 1, size=_NUM_HASHES, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 2**63 - 1, size=_NUM_HASHES, dtype=np.int64).astype(np.uint64)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPLIT = None
#: Size classes of the prefix-filter join: exact sizes up to CLASS_FROM shingles, then steps of CLASS_WIDTH (a ratio's log).
CLASS_FROM, CLASS_WIDTH = 500, 0.002

#: Bodies whose shingles a Python worker holds at a time; it lets go of them before it takes the next ones.
SLICE = 64


def _one(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes and the band hashes of a text; none if it has no three words."""
    import re

    global _SPLIT
    if _SPLIT is None:
        _SPLIT = re.compile(r"[\t\n\f\r ]+")
    toks = [t for t in _SPLIT.split(text or "") if t]
    if len(toks) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    th = pd.util.hash_array(np.asarray(toks, dtype=object), categorize=False)
    with np.errstate(over="ignore"):
        sh = (th[:-2] * _C1) ^ ((th[1:-1] * _C2) >> np.uint64(1)) ^ (th[2:] + _C1)
        sh = np.unique(sh)
        mins = np.full(_NUM_HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
        for lo in range(0, len(sh), 4096):  # bounded memory: 4096 x hashes at a time
            block = sh[lo:lo + 4096, None] * _A[None, :] + _B[None, :]
            mins = np.minimum(mins, block.min(axis=0))
        bands = mins.reshape(N_BANDS, ROWS_PER_BAND)
        bh = np.zeros(N_BANDS, dtype=np.uint64)
        for j in range(ROWS_PER_BAND):
            bh = (bh * _C2) ^ (bands[:, j] + np.uint64(j))
    return sh.view(np.int64), bh.view(np.int64)


# The map is the only Python code that runs on workers: ship it (and the constants above) by value, so workers need
# no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _sign_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``sh`` and ``bands`` in place of ``text``, a slice of a batch at a time. Arrays go to Arrow as they are: as lists
    of Python numbers, a batch's shingles would take several times the batch."""

    def lists(arrays: list[np.ndarray]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))

    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            part = batch.slice(lo, SLICE)
            signed = [_one(t.as_py()) for t in part.column("text")]
            columns = [part.column(c) for c in ("page_id", "grp", "body_hash")]
            columns += [lists([sh for sh, _ in signed]), lists([bands for _, bands in signed])]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "grp", "body_hash", "sh", "bands"])


def _signed(prepared: DataFrame) -> DataFrame:
    """``(page_id, grp, body_hash, sh, bands)`` of ``prepared`` bodies (page_id, grp, text)."""
    rows = prepared.select("page_id", "grp", F.sha2("text", 256).alias("body_hash"), F.lower("text").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(
        _sign_slices, f"page_id {kinds['page_id']}, grp {kinds['grp']}, body_hash string, sh array<bigint>, bands array<bigint>"
    )


def _prepare(bodies: DataFrame, group: str) -> DataFrame:
    if group == "host":
        g = F.lower(U.url_hostname(F.col("url")))
    else:
        g = F.col(group)
    return bodies.select("page_id", g.alias("grp"), F.col("html").alias("text"))


def exact_body_groups(bodies: DataFrame, group: str = "host") -> DataFrame:
    """``(page_id, grp, body_hash, dup_of)``; dup_of is the smallest id with the same body in the group (NULL for
    that first one). Bodies are read and hashed once."""
    return _first_copies(cut_lineage(_prepare(bodies, group).select("page_id", "grp", F.sha2("text", 256).alias("body_hash"))))


def _first_copies(hashed: DataFrame) -> DataFrame:
    first = hashed.groupBy("grp", "body_hash").agg(F.min("page_id").alias("_first"))
    return hashed.join(first, ["grp", "body_hash"]).select(
        "page_id", "grp", "body_hash", F.when(F.col("_first") < F.col("page_id"), F.col("_first")).alias("dup_of")
    )


def _least_overlap(a: Column, b: Column, cut: int) -> Column:
    """Shingles that two sets of these sizes share at least if they are ``cut``% similar."""
    return F.floor((F.lit(cut) * (a + b) + (99 + cut)) / F.lit(100 + cut)).cast("int")


def _size_class(size: Column) -> Column:
    """Sizes below CLASS_FROM are classes of their own, above a class spans CLASS_WIDTH."""
    wide = F.lit(CLASS_FROM) + F.floor(F.log(size / F.lit(float(CLASS_FROM))) / F.lit(CLASS_WIDTH))
    return F.when(size < CLASS_FROM, size).otherwise(wide).cast("int")


def prefix_rows(sets: DataFrame, cut: int) -> DataFrame:
    """``(grp, tok, small, large, side, want, page_id)``: what a set is met by. ``sets``: (page_id, grp, sh).

    Similar sets of sizes a <= b share at least k = ceil(cut (a + b) / (100 + cut)) shingles, so in any common order the
    first that they share is among the first a - k + 1 of the one and b - k + 1 of the other. The order is by rarity in
    the group, then hash. A set gives these shingles for each size class that a similar set can have. Rows meet where
    group, shingle and both classes agree and the ``want`` of the one is the ``side`` of the other.
    """
    tokens = sets.select("page_id", "grp", F.explode("sh").alias("tok"))
    often = tokens.groupBy("grp", "tok").agg(F.count(F.lit(1)).alias("n"))
    by_rarity = F.array_sort(F.collect_list(F.struct("n", "tok")))
    ordered = tokens.join(often, ["grp", "tok"]).groupBy("page_id", "grp").agg(by_rarity.alias("o"))
    m = F.size("o")
    least, most = F.floor((F.lit(cut) * m + 99) / 100).cast("int"), F.floor(F.lit(100) * m / F.lit(cut)).cast("int")
    sizes = F.transform(F.sequence(least, most), lambda b: F.struct(_size_class(b).alias("c"), b.alias("b")))
    d = ordered.select("page_id", "grp", "o", m.alias("m"), _size_class(m).alias("own"), sizes.alias("sizes"))
    # the smallest size of each class of possible partners bounds the shared shingles from below
    starts = F.filter("sizes", lambda s, i: (i == 0) | (F.get("sizes", i - 1)["c"] != s["c"]))
    d = d.select("page_id", "grp", "o", "m", "own", F.explode(starts).alias("p"))
    count = F.greatest(F.col("m") - _least_overlap(F.col("m"), F.col("p.b"), cut) + 1, F.lit(0))
    d = d.select("page_id", "grp", "own", F.col("p.c").alias("other"), F.explode(F.slice("o", F.lit(1), count)).alias("t"))
    side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1)
    want = F.when(F.col("own") < F.col("other"), 1).otherwise(0)
    return d.select(
        "grp", F.col("t.tok").alias("tok"), F.least("own", "other").alias("small"), F.greatest("own", "other").alias("large"),
        side.alias("side"), want.alias("want"), "page_id",
    )


_BUCKET = ["grp", "tok", "small", "large"]


def _leader_pairs(rows: DataFrame) -> DataFrame:
    """Each row with the smallest id that it can meet in its bucket, where that is an earlier one: ``(..., x, y)``."""
    leaders = rows.groupBy(*_BUCKET, F.col("side").alias("want")).agg(F.min("page_id").alias("x"))
    return rows.withColumnRenamed("page_id", "y").drop("side").join(leaders, [*_BUCKET, "want"]).where("x < y")


def similar_bodies(bodies: DataFrame, group: str = "host", cut: int = BODY_SIMILARITY_CUT) -> DataFrame:
    """``(page_id, grp, similar_to)`` for every body with an earlier body of its group at least ``cut``% similar
    (exact copies included); ``similar_to`` is the smallest such id."""
    # One map-side pass over the bodies: content hash and signature together, so html is never shuffled.
    sig = cut_lineage(_signed(_prepare(bodies, group)))
    exact = _first_copies(sig.select("page_id", "grp", "body_hash"))
    reps = exact.where(F.col("dup_of").isNull()).select("page_id")
    met = reps
    if cut >= BAND_CUT:  # below, bands could miss pairs, and the prefix-filter join alone is exact
        banded = sig.select("page_id", "grp", F.posexplode("bands").alias("band", "bh")).join(reps, "page_id", "left_semi")
        shared = banded.groupBy("grp", "band", "bh").agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).where("lo < hi")
        met = banded.join(shared, ["grp", "band", "bh"], "left_semi").select("page_id").distinct()
    sh = cut_lineage(sig.select("page_id", "grp", "sh").join(met, "page_id", "left_semi").where(F.size("sh") > 0))
    rows = cut_lineage(prefix_rows(sh, cut))

    def verify(cand: DataFrame) -> DataFrame:
        """Keep candidate pairs (x < y) whose exact shingle Jaccard is >= cut (integer arithmetic)."""
        v = cand.join(sh.select(F.col("page_id").alias("x"), F.col("sh").alias("shx")), "x").join(
            sh.select(F.col("page_id").alias("y"), F.col("sh").alias("shy")), "y"
        )
        inter = F.size(F.array_intersect("shx", "shy"))
        union = F.size("shx") + F.size("shy") - inter
        return v.where(F.lit(100) * inter >= F.lit(cut) * union).select("x", "y")

    # Phase A: every body meets only the smallest id that it can meet in each of its buckets.
    led = _leader_pairs(rows)
    pa = cut_lineage(verify(led.select("x", "y").distinct()))
    best_a = pa.groupBy("y").agg(F.min("x").alias("best"))
    # Phase B: only where that leader is not similar, look at the other earlier members of the bucket below the best
    # match found so far. Together A and B give the smallest similar earlier body among all candidates.
    open_ = led.join(pa, ["x", "y"], "left_anti").join(best_a, "y", "left").withColumnRenamed("x", "leader")
    others = rows.select(*_BUCKET, F.col("side").alias("want"), F.col("page_id").alias("x"))
    cb = open_.join(others, [*_BUCKET, "want"]).where(
        (F.col("x") > F.col("leader")) & (F.col("x") < F.col("y")) & (F.col("best").isNull() | (F.col("x") < F.col("best")))
    )
    pb = verify(cb.select("x", "y").distinct())
    first = pa.unionByName(pb).groupBy("y").agg(F.min("x").alias("first"))
    rep_rows = first.select(F.col("y").alias("page_id"), F.col("first").alias("similar_to"))
    dups = exact.where(F.col("dup_of").isNotNull()).select("page_id", "dup_of")
    # an exact copy of representative A is similar to A and to whatever A is similar to; the smallest of those is
    # A's own first similar body when A has one, else A
    dup_rows = dups.join(first.withColumnRenamed("y", "dup_of"), "dup_of", "left").select(
        "page_id", F.coalesce(F.col("first"), F.col("dup_of")).alias("similar_to")
    )
    grp = exact.select("page_id", "grp")
    return rep_rows.unionByName(dup_rows).join(grp, "page_id").select("page_id", "grp", "similar_to")


def drop_similar_bodies(bodies: DataFrame, group: str = "host", cut: int = BODY_SIMILARITY_CUT) -> DataFrame:
    """N1 filter: the bodies that are kept (rows of ``bodies`` without an earlier similar body)."""
    dropped = similar_bodies(bodies, group, cut).select("page_id")
    return bodies.join(dropped, "page_id", "left_anti")
