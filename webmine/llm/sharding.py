"""Sharding by rendezvous hashing of record keys (DataFrame functions only).

Every (key, shard) pair has a pseudo-random number u in (0, 1) from md5; the record goes to the shard with the largest
``weight / -ln(u)``. The shard of a record depends on its key and the set of shards alone, so a shard that is added
takes records only into itself, and on average its weight's share of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_bucket, rank_in_group

#: 13 hex digits: 52 bits, which a double holds exactly.
_DIGITS = 13


def rendezvous_shard(key: Column, shards: int, weights: Sequence[float] | None = None) -> Column:
    """The shard 0 to ``shards - 1`` of a string key. ``weights``: of each shard, all alike if not given."""
    if weights is not None and (len(weights) != shards or min(weights) <= 0):
        raise ValueError("one positive weight per shard")
    weight = F.array(*[F.lit(float(x)) for x in weights]) if weights is not None else None

    def cost(shard: Column) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, _DIGITS)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**_DIGITS))
        c = -F.log(u)
        return F.struct((c if weight is None else c / F.element_at(weight, shard + 1)).alias("c"), shard.alias("shard"))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), cost))["shard"]


def assign_shards(
    docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None, grown_weight: float = 1.0,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``.

    ``size``: UTF-8 bytes of the text plus 8. ``slot``: the record's place in its shard, gapless from 0, in the order
    of (md5 bucket, key, text_crc32, size). ``grown_shard``: the shard if there were one more (of ``grown_weight``).

    NULL text: as empty (size 8, crc 0). NULL key: hashed as the empty string, sorted last in a bucket. Rows with the
    same key share a shard (the law) but not a slot bucket, unless their texts are equal too; equal rows get slots
    next to each other. An empty table gives an empty result. Other columns are not read.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    more = None if weights is None else [*weights, grown_weight]
    rows = docs.select(
        F.col(key).alias("__key"),
        name.alias("__name"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        rendezvous_shard(name, shards, weights).alias("shard"),
        rendezvous_shard(name, shards + 1, more).alias("grown_shard"),
    ).withColumn("__bucket", hash_bucket(F.md5(F.concat_ws(":", "__name", F.col("text_crc32").cast("string")))))
    order = [F.col("__key").asc_nulls_last(), "text_crc32", "size"]
    ranked = rank_in_group(rows, "shard", "__bucket", order, "slot")
    return ranked.select(
        F.col("__key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
