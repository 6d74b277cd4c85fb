"""Small helpers that several operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: One word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Hex digits of md5 that choose a rank bucket: 4096 buckets per group, whatever the size of the input.
BUCKET_DIGITS = 3

#: Sorts after every real id.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_or_last(c: Column | str) -> Column:
    """The id as a number that sorts; NULL ids sort after all others."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(LAST_ID)).cast("long")


def merged(side: DataFrame) -> DataFrame:
    """One side of a join whose sides both grow with the input: it is a sort-merge join, so that neither is gathered on the
    driver and broadcast, however small Spark takes it to be."""
    return side.hint("merge")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def hash_bucket(md5: Column) -> Column:
    """The bucket 0..4095 that the first hex digits of an md5 name."""
    return F.conv(F.substring(md5, 1, BUCKET_DIGITS), 16, 10).cast("int")


def offsets_before(sizes: DataFrame, group: list[str], order: str, size: str, name: str) -> DataFrame:
    """``sizes`` (one row per group and bucket) with the sum of ``size`` over the group's earlier buckets."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)))


def rank_in_group(rows: DataFrame, group: str, bucket: str, order: list[str], name: str) -> DataFrame:
    """Gapless ranks from 0 inside each group, without a task that holds a whole group.

    Rows are ranked inside (group, bucket), and every bucket starts at the number of rows in the group's earlier
    buckets. ``rows`` must give the same rows each time it is read (a scan or a checkpoint).
    """
    counts = rows.groupBy(group, bucket).agg(F.count(F.lit(1)).alias("__n"))
    start = offsets_before(counts, [group], bucket, "__n", "__before").select(
        F.col(group).alias("__g"), F.col(bucket).alias("__b"), "__before"
    )
    w = Window.partitionBy(group, bucket).orderBy(*order)
    ranked = rows.withColumn("__in", F.row_number().over(w) - 1)
    joined = ranked.join(start, (F.col(group) == F.col("__g")) & (F.col(bucket) == F.col("__b")))
    return joined.withColumn(name, (F.col("__before") + F.col("__in")).cast("long")).drop("__g", "__b", "__in", "__before")


def process_cache(key: str, make: Callable):
    """``make()``, kept for the life of a worker process.

    Functions are shipped by value, so their own globals are new in every task; a module entry is not.
    """
    store = sys.modules.setdefault("_worker_cache_of_llm", types.ModuleType("_worker_cache_of_llm")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
