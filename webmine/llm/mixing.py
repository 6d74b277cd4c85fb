"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Each source's documents are shuffled (by md5 of seed, id and text) and served again and again, ``max_repeats`` times
at most. A served copy has the virtual finish time ``words the source has served through it / weight of the source``.
In the order of finish times all sources progress in proportion to their weights; a source that has been served
``max_repeats`` times drops out and leaves its share to the others. The queue stops at the virtual time when the
budget (the words of all documents) is served. That time follows from the sources' totals alone, so each copy is
judged on its own, and the order is one range sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash_bucket, offsets_before, word_count

MAX_REPEATS = 3
WEIGHTS = (5, 2, 1)


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``totals`` (source, source_size) with ``weight``, ``target`` and ``stop_time``.

    Sources by code point, NULL last, get the weights in turn. A target is ``weight * stop_time``, at most
    ``max_repeats`` times the source's size; what is above goes to the others by weight until none is above. In the
    order of (cap / weight) the capped sources come first, so the stop time is (budget - caps before) / (weights from
    here on) at the first source whose own cap that time does not pass. One row per source: a small table.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(x)) for x in weights])
    place = F.row_number().over(by_name) - 1
    s = totals.withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")))
    s = s.withColumn("__cap", F.col("source_size") * max_repeats).withColumn("__full", F.col("__cap") / F.col("weight"))
    by_full = Window.orderBy("__full", F.col("source").asc_nulls_last())
    before = by_full.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_full.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("__cap").over(before), F.lit(0))
    s = s.withColumn("__time", left / F.sum("weight").over(onward)).withColumn("__at", F.row_number().over(by_full))
    first = F.min(F.when(F.col("__time") <= F.col("__full"), F.struct("__at", "__time"))).over(Window.partitionBy())
    s = s.withColumn("stop_time", first["__time"])
    target = F.least(F.col("__cap").cast("double"), F.col("stop_time") * F.col("weight"))
    return s.withColumn("target", target).select("source", "source_size", "weight", "stop_time", "target")


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = "mix",
    keep_rows: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id, size, source, source_size, target, copies, taken, finish_times``.

    ``copies``: how often the mix takes the document; ``taken`` the words of that. A copy is taken if at least half of
    it is served before its source's target, so a source misses its target by half a document at most. A source that
    reaches its cap is taken ``max_repeats`` times whole. ``finish_times``: virtual finish times of the copies taken.
    ``keep_rows`` adds the input row as struct ``__row``.

    The running sums restart in 4096 md5 buckets per source, so no task holds a source. NULL or empty texts have size
    0 and take nothing. NULL source: a source of its own, last. Rows with equal ids and texts are separate documents
    next to each other in the order. Empty tables give an empty result. Extra columns are not read.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if keep_rows else []
    name, content = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))
    shuffle_key = F.md5(F.concat_ws(":", F.lit(seed), name, content))
    rows = docs.select(
        F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"),
        shuffle_key.alias("__md5"), *row,
    ).withColumn("__bucket", hash_bucket(F.col("__md5")))
    sums = rows.groupBy("source", "__bucket").agg(F.sum("size").alias("__sum"))
    totals = sums.groupBy("source").agg(F.sum("__sum").alias("source_size"))
    before = offsets_before(sums, ["source"], "__bucket", "__sum", "__before")
    plan = source_targets(totals, weights, max_repeats).withColumnRenamed("source", "__s")
    start = before.join(plan, F.col("source").eqNullSafe(F.col("__s"))).select(
        F.col("source").alias("__source"), F.col("__bucket").alias("__b"), "__before", "source_size", "weight", "target"
    )
    w = Window.partitionBy("source", "__bucket").orderBy("__md5", F.col("doc_id").asc_nulls_last(), "size")
    served = rows.withColumn("__in", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    served = served.join(start, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__b")))

    def through(turn: Column) -> Column:
        return turn * F.col("source_size") + F.col("__before") + F.col("__in")

    turns = F.sequence(F.lit(0), F.lit(max_repeats - 1))
    taken = F.filter(turns, lambda t: through(t) * 2 - F.col("size") <= F.col("target") * 2)
    served = served.withColumn("__turns", taken).withColumn("copies", F.size("__turns"))
    return served.select(
        "doc_id", "size", "source", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
        F.transform("__turns", lambda t: through(t) / F.col("weight")).alias("finish_times"),
        *(["__row"] if keep_rows else []),
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, repeated as often as they are taken, in the order
    of virtual finish times (a global range sort). Documents without words carry nothing to mix and are kept once."""
    mixed = mix_sources(docs, weights, max_repeats, keep_rows=True)
    empty = F.col("size") == 0
    times = F.when(empty, F.array(F.lit(0.0))).otherwise(F.col("finish_times"))
    copies = mixed.select("__row", F.explode(times).alias("__finish"))
    return copies.orderBy("__finish", "__row.doc_id").select("__row.*")
