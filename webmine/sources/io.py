"""IO1-IO7: seeds, pages, wordlists, result and parameter sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators.report import distinct_requests, filter_extension, hide_media

PAGES_SCHEMA = "page_id BIGINT, url STRING, html STRING"


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """IO3: stored response bodies ``pages(page_id, url, html)`` (Parquet or JSON lines)."""
    reader = spark.read
    if fmt == "json":
        reader = reader.schema(PAGES_SCHEMA)
    return reader.format(fmt).load(path).select("page_id", "url", "html")


def split_seed_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """IO1 core: a target line with a comma is a list (spaces removed); otherwise the line is one target."""
    v = F.col(col)
    targets = F.when(v.contains(","), F.split(F.regexp_replace(v, " ", ""), ",")).otherwise(F.array(v))
    return lines.select(F.posexplode(targets).alias("pos", "seed"), *[c for c in lines.columns if c != col])


def load_seeds(spark: SparkSession, *, path: str | None = None, targets: str | None = None) -> DataFrame:
    """IO1: targets from a one-per-line text file (``path``) or a target or comma list of them (``targets``)."""
    if (path is None) == (targets is None):
        raise ValueError("give either path or targets")
    lines = spark.createDataFrame([(targets,)], "value STRING") if path is None else spark.read.text(path)
    return split_seed_lines(lines).select("seed")


def load_wordlist(lines: DataFrame, col: str = "value") -> DataFrame:
    """IO4: trim all white space of each line; drop blank lines and lines starting with '#'. Duplicates are kept."""
    w = F.regexp_replace(F.col(col), r"^[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+$", "")
    others = [c for c in lines.columns if c != col]
    return lines.select(*others, w.alias("path")).where((F.col("path") != "") & ~F.col("path").startswith("#"))


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    return load_wordlist(spark.read.text(path))


def prepare_seeds(seeds: DataFrame, prefer_http: bool = False, col: str = "seed") -> DataFrame:
    """IO7: add a scheme when missing; an explicit default port reduces the seed to scheme://hostname (path dropped).

    Returns ``seed, url, host (Host with port, the scope include), hostname (the visited host)``.
    """
    s = F.col(col)
    scheme = "http://" if prefer_http else "https://"
    u = F.when(~s.contains("://"), F.concat(F.lit(scheme), s)).otherwise(s)
    sch = U.url_scheme(u)
    port = U.url_port(u)
    hostname = U.url_hostname(u)
    default_port = ((sch == "https") & (port == "443")) | ((sch == "http") & (port == "80"))
    url = F.when(default_port, F.concat(sch, F.lit("://"), hostname)).otherwise(u)
    others = [c for c in seeds.columns if c not in (col, "url", "host", "hostname")]
    return seeds.select(
        *others, s.alias("seed"), url.alias("url"), U.url_hostport(u).alias("host"), hostname.alias("hostname")
    )


def result_lines(results: DataFrame) -> DataFrame:
    """IO5 line format ``"<status> <request_url>"`` (the status filter does not apply to the file)."""
    return results.select(
        F.concat_ws(" ", F.col("status_code").cast("string"), F.col("request_url")).alias("line"), "request_url",
        *[c for c in ("page_id",) if c in results.columns],
    )


def file_results(results: DataFrame, hide_media_urls: bool = False, exts: list[str] | None = None) -> DataFrame:
    """What the result file holds: R1, R2 and R3 (the first result per request URL), before any status filter."""
    r = hide_media(results) if hide_media_urls else results
    return distinct_requests(filter_extension(r, exts) if exts else r)


def write_results(results: DataFrame, path: str, fmt: str = "text", hide_media_urls: bool = False, exts: list[str] | None = None) -> None:
    """IO5: append the lines (text) or rows (parquet) of :func:`file_results`."""
    r = file_results(results, hide_media_urls, exts)
    if fmt == "text":
        result_lines(r).select("line").write.mode("append").text(path)
    else:
        r.write.mode("append").format(fmt).save(path)


def write_params_json(params: DataFrame, path: str) -> None:
    """IO6: JSON lines of (name, type, source, certainty, url); bag, not distinct."""
    params.select("name", "type", "source", "certainty", "url").write.mode("overwrite").json(path)

