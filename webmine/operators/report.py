"""Result reporting (filters, first result per request, labelled lines, status rollups)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U


def hide_media(results: DataFrame, url: str = "request_url") -> DataFrame:
    """R1."""
    return results.where(~U.is_media_url(F.col(url)))


def filter_extension(results: DataFrame, exts: list[str], url: str = "request_url") -> DataFrame:
    """R2: keep when the whole URL ends in '.ext' for one of ``exts`` (a query string defeats it)."""
    cond = F.lit(False)
    for e in exts:
        cond = cond | F.col(url).endswith("." + e)
    return results.where(cond)


def distinct_requests(results: DataFrame, url: str = "request_url", order: str = "page_id") -> DataFrame:
    """First result per request URL (by ``order``); partial aggregation, no window over a hot key."""
    cols = [c for c in results.columns if c != url]
    first = F.min_by(F.struct(*cols), F.col(order))
    return results.groupBy(url).agg(first.alias("_r")).select(url, *[F.col(f"_r.{c}").alias(c) for c in cols])


def filter_status(results: DataFrame, codes: list[int] | None, hide_status: bool = False) -> DataFrame:
    """Exact codes; ignored when the status is hidden."""
    if hide_status or not codes:
        return results
    return results.where(F.col("status_code").isin([int(c) for c in codes]))


def status_class(st) -> F.Column:
    st = F.col(st) if isinstance(st, str) else st
    return (
        F.when((st >= 200) & (st < 300), "2xx")
        .when((st >= 300) & (st < 400), "3xx")
        .when((st >= 400) & (st < 500), "4xx")
        .when(st >= 500, "5xx")
        .when((st >= 100) & (st < 200), "1xx")
        .otherwise("other")
    )


def label_results(results: DataFrame, verbosity: int = 0) -> DataFrame:
    """Status class, ``<code>[*] <url>`` label; 4xx lines shown only at verbosity 2."""
    st = F.col("status_code")
    label = F.concat(st.cast("string"), F.when(F.col("is_catch_all"), F.lit("*")).otherwise(F.lit("")))
    cls = status_class(st)
    return results.select(
        "*", cls.alias("status_class"), F.concat_ws(" ", label, F.col("request_url")).alias("line"),
        ((cls != "4xx") | F.lit(verbosity > 1)).alias("shown"),
    )


def report(results: DataFrame, hide_media_urls: bool = False, exts: list[str] | None = None,
           codes: list[int] | None = None, hide_status: bool = False, verbosity: int = 0) -> DataFrame:
    """R1, R2, R3, then R4 + R5 lines (``line``); rows not shown at this verbosity are dropped."""
    r = results
    if hide_media_urls:
        r = hide_media(r)
    if exts:
        r = filter_extension(r, exts)
    r = distinct_requests(r)
    r = filter_status(r, codes, hide_status)
    if hide_status:
        return r.select("request_url", F.col("request_url").alias("line"))
    return label_results(r, verbosity).where("shown").select("request_url", "line")


def status_rollup(results: DataFrame) -> DataFrame:
    """Counts per (host, status class) with per-host and grand totals (rollup)."""
    d = results.select(F.lower(U.url_hostname(F.col("request_url"))).alias("host"), status_class("status_code").alias("status_class"))
    return d.rollup("host", "status_class").agg(F.count(F.lit(1)).alias("n"))
