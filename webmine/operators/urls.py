"""Visited dedup and query-alias collapsing over ``(seq, url)`` tables.

Order is explicit: ``seq`` says which URL came first (the crawler used arrival order). Redundancy is decided against
*any* earlier URL instead of "any earlier URL that was itself kept"; the two differ only for chains where A aliases B,
B aliases C and A does not alias C.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.patterns import BAD_ESCAPE
from ..session import cut_lineage

SEP = "\u0001"


def dedupe_visited(df: DataFrame, visited: DataFrame | None = None, url: str = "url", seq: str = "seq") -> DataFrame:
    """U4: first occurrence of each exact URL string (by ``seq``), minus URLs already visited."""
    first = df.groupBy(url).agg(F.min(seq).alias(seq))
    if visited is not None:
        first = first.join(visited.select(F.col(url)).distinct(), url, "left_anti")
    return first.select(seq, url)


def query_pairs(q: Column) -> Column:
    """Decoded ``k<SEP>v`` pairs of a raw query in order; NULL when the query does not parse (a pair with ';' or a bad
    escape). First value per name only."""
    raw = F.filter(F.split(q, "&"), lambda p: p != "")
    bad = F.exists(raw, lambda p: p.contains(";") | p.rlike(BAD_ESCAPE))
    kv = F.transform(
        raw,
        lambda p: F.struct(
            F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"),
            F.try_url_decode(F.when(p.contains("="), F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).otherwise(F.lit(""))).alias("v"),
        ),
    )
    keys = F.transform(kv, lambda x: x["k"])
    first = F.filter(kv, lambda x, i: F.array_position(keys, x["k"]) == i + 1)
    return F.when(bad | F.exists(kv, lambda x: x["k"].isNull() | x["v"].isNull()), F.lit(None)).otherwise(first)


def _with_query_info(df: DataFrame, url: str) -> DataFrame:
    q = U.url_query(F.col(url))
    return df.select(
        "*",
        U.strip_query(F.col(url)).alias("_base"),
        q.alias("_q"),
    ).withColumn("_pairs", F.when(F.col("_q") != "", query_pairs(F.col("_q"))))


def _global_rank(df: DataFrame, order: str, out: str) -> DataFrame:
    """Dense 1-based ranks of distinct ``order`` values without a single-partition window: range-partition, number rows
    within each partition, add the row counts of the partitions before it (a table with one row per partition)."""
    from pyspark.sql import Window

    parted = cut_lineage(df.repartitionByRange(order).withColumn("_pid", F.spark_partition_id()))
    local = parted.withColumn("_local", F.row_number().over(Window.partitionBy("_pid").orderBy(order)))
    counts = parted.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select(
        "_pid", (F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off")
    )
    return local.join(F.broadcast(offsets), "_pid").select(
        *df.columns, (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local")).cast("bigint").alias(out)
    )


def _maps_by_two_pairs(maps: DataFrame, wanted: DataFrame) -> DataFrame:
    """``maps`` once for each two of their pairs that ``wanted`` (lo, hi) asks for."""
    low = maps.select("*", F.explode("_m").alias("lo")).join(wanted.select("lo").distinct(), "lo", "left_semi")
    both = low.select("*", F.explode(F.filter("_m", lambda p: p > F.col("lo"))).alias("hi"))
    return both.join(wanted.select("lo", "hi").distinct(), ["lo", "hi"], "left_semi")


def superset_candidates(keys: DataFrame, maps: DataFrame) -> DataFrame:
    """``(_s, _e, _tmin)``: for each key, the maps first seen before the key's own (``_kmin``) that hold all its pairs S
    and no value for a name of E. ``keys``: (_s, _e, _kmin), S not empty. ``maps``: (_m, _tmin, _nv).

    A key of three and more pairs meets only the maps that hold its two rarest. For keys of one or two pairs, what all
    maps with them know is summed up before the join: the earliest one for each set of names that matters to any E.
    So no pair, however popular, is a join key whose rows multiply.
    """
    asked = keys.select(F.explode("_e").alias("_n")).distinct()
    names = maps.select("_m", F.explode("_nv").alias("_n")).join(asked, "_n").groupBy("_m").agg(F.array_sort(F.collect_set("_n")).alias("_nr"))
    maps = maps.select("_m", "_tmin").join(names, "_m", "left").withColumn("_nr", F.coalesce("_nr", F.array().cast("array<string>")))
    maps = cut_lineage(maps)
    free = (F.col("_tmin") < F.col("_kmin")) & (F.size(F.array_intersect("_e", "_nr")) == 0)
    out = ["_s", "_e", "_tmin"]

    one = maps.select("_tmin", "_nr", F.explode("_m").alias("_p")).groupBy("_p", "_nr").agg(F.min("_tmin").alias("_tmin"))
    single = keys.where(F.size("_s") == 1).withColumn("_p", F.col("_s")[0]).join(one, "_p").where(free).select(*out)

    freq = maps.select(F.explode("_m").alias("_p")).groupBy("_p").agg(F.count(F.lit(1)).alias("_f"))
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("_f", "_p"))), 1, 2)["_p"]
    more = keys.where(F.size("_s") > 1).select("*", F.explode("_s").alias("_p")).join(freq, "_p").groupBy("_s", "_e", "_kmin").agg(rarest.alias("_r"))
    more = cut_lineage(more.select("_s", "_e", "_kmin", F.array_min("_r").alias("lo"), F.array_max("_r").alias("hi")))
    two, three = more.where(F.size("_s") == 2), more.where(F.size("_s") > 2)
    sums = _maps_by_two_pairs(maps, two).groupBy("lo", "hi", "_nr").agg(F.min("_tmin").alias("_tmin"))
    double = two.join(sums, ["lo", "hi"]).where(free).select(*out)
    holds = F.size(F.array_except("_s", "_m")) == 0
    many = three.join(_maps_by_two_pairs(maps, three), ["lo", "hi"]).where(free & holds).select(*out)
    return single.unionByName(double).unionByName(many)


def earlier_supersets(keys: DataFrame, maps: DataFrame) -> DataFrame:
    """``(_s, _e, _best)``: when the earliest of :func:`superset_candidates` was seen, for keys that have one."""
    return superset_candidates(keys, maps).groupBy("_s", "_e").agg(F.min("_tmin").alias("_best"))


def collapse_query_aliases(df: DataFrame, scope: str = "path", url: str = "url", seq: str = "seq") -> DataFrame:
    """U5 (scope='path') and U6 (scope='global').

    path: a URL with a parsable query is redundant when an earlier URL, itself without a query or with a parsable one,
    has the same query-less form.
    global: also redundant when an earlier URL with a query carries every (name, first value) of it; a name with an
    empty value only asks that the other URL has no non-empty value for it. A URL without a query is never redundant.
    """
    t = _with_query_info(df, url)
    parsable = (F.col("_q") == "") | F.col("_pairs").isNotNull()
    first_by_base = t.groupBy("_base").agg(F.min(F.when(parsable, F.col(seq))).alias("_base_min"))
    t = t.join(first_by_base, "_base")
    redundant = (F.col("_q") != "") & F.col("_pairs").isNotNull() & F.coalesce(F.col("_base_min") < F.col(seq), F.lit(False))
    if scope == "path":
        return t.where(~redundant).select(*df.columns)
    if scope != "global":
        raise ValueError("scope must be 'path' or 'global'")

    enc = lambda x: F.concat(x["k"], F.lit(SEP), x["v"])
    t = t.withColumn("_m", F.array_sort(F.transform(F.col("_pairs"), enc))).withColumn(
        "_s", F.array_sort(F.transform(F.filter("_pairs", lambda x: x["v"] != ""), enc))
    ).withColumn("_e", F.array_sort(F.transform(F.filter("_pairs", lambda x: x["v"] == ""), lambda x: x["k"])))
    # parsed once: feeds the distinct maps, the distinct keys and the final join
    t = cut_lineage(t)
    withq = t.where(F.col("_pairs").isNotNull())
    # distinct first-value maps of URLs with a query, with their earliest seq
    tv = withq.groupBy("_m").agg(F.min(seq).alias("_tmin")).withColumn(
        "_nv", F.transform(F.filter("_m", lambda p: ~p.endswith(SEP)), lambda p: F.substring_index(p, SEP, 1))
    )
    # distinct (S, E) keys asking for their earliest superset; a key's own map is one, first seen at _kmin
    keys = withq.groupBy("_s", "_e").agg(F.min(seq).alias("_kmin"))
    best_s = earlier_supersets(keys.where(F.size("_s") > 0), tv)
    best_s = keys.where(F.size("_s") > 0).join(best_s, ["_s", "_e"], "left").select(
        "_s", "_e", F.coalesce("_best", "_kmin").alias("_sup_min")
    )
    # Keys with only empty-valued names E: the earliest map with no non-empty value for any name of E. Maps get
    # distributed global ranks by first seq; the blocked (E, map) pairs come from an equi-join on the name, and the
    # answer is the smallest rank that is 1 or follows a blocked rank without being blocked itself.
    ke = keys.where(F.size("_s") == 0).select("_s", "_e")
    if ke.limit(1).count() == 0:
        return _drop_redundant(t.join(best_s, ["_s", "_e"], "left"), redundant, seq, df.columns)
    ranked = _global_rank(tv.select("_tmin", "_nv"), "_tmin", "_rank")
    blocked = (
        ke.select("_s", "_e", F.explode("_e").alias("_n"))
        .join(ranked.select("_rank", F.explode("_nv").alias("_n")), "_n")
        .select("_s", "_e", "_rank")
        .distinct()
    )
    cands = ke.select("_s", "_e", F.lit(1).cast("bigint").alias("_rank")).unionByName(
        blocked.select("_s", "_e", (F.col("_rank") + 1).alias("_rank"))
    )
    first_free = cands.join(blocked, ["_s", "_e", "_rank"], "left_anti").groupBy("_s", "_e").agg(F.min("_rank").alias("_rank"))
    best_e = first_free.join(ranked.select("_rank", "_tmin"), "_rank").select("_s", "_e", F.col("_tmin").alias("_sup_min"))
    best = best_s.unionByName(best_e)
    return _drop_redundant(t.join(best, ["_s", "_e"], "left"), redundant, seq, df.columns)


def _drop_redundant(t: DataFrame, redundant: Column, seq: str, cols: list[str]) -> DataFrame:
    redundant_g = redundant | (
        (F.col("_q") != "") & F.col("_pairs").isNotNull() & F.coalesce(F.col("_sup_min") < F.col(seq), F.lit(False))
    )
    return t.where(~redundant_g).select(*cols)
