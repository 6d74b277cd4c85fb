"""Link and robots extraction, filtering, resolution, edges and degrees.

All of it is Column expressions over one row per page plus one ``explode``; the html column is dropped right after
extraction so no later shuffle carries it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.patterns import LINK_PATTERN_JAVA, ROBOTS_EXTENSION, ROBOTS_PATTERN


def _unquote_all(matches: Column) -> Column:
    """Each quoted match yields its inner text; a match with mismatched quotes also keeps the quoted text first."""

    def one(m):
        inner = F.substring(m, 2, F.length(m) - 2)
        same = (m.startswith('"') & m.endswith('"')) | (m.startswith("'") & m.endswith("'"))
        return F.when(same, F.array(inner)).otherwise(F.array(m, inner))

    return F.array_distinct(F.flatten(F.transform(matches, one)))


def _links_of(html: Column) -> Column:
    return _unquote_all(F.regexp_extract_all(html, F.lit(LINK_PATTERN_JAVA), 0))


def extract_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """L1: ``(page_id, url, pos, raw)``; distinct per page, first occurrence order."""
    return pages.select("page_id", "url", F.posexplode(_links_of(F.col(html))).alias("pos", "raw"))


def _rules_of(body: Column) -> Column:
    vals = F.regexp_extract_all(body, F.lit("(?d)" + ROBOTS_PATTERN), 1)

    def clean(v):
        v = F.regexp_replace(v, r"^\s+|\s+$", "")
        v = F.replace(F.replace(v, F.lit("*"), F.lit("")), F.lit("$"), F.lit(""))
        v = F.regexp_replace(v, r"\?$", "")
        return F.regexp_replace(v, ROBOTS_EXTENSION, "/")

    return F.array_distinct(F.filter(F.transform(vals, clean), lambda p: F.octet_length(p) > 1))


def extract_robots(bodies: DataFrame, body: str = "body") -> DataFrame:
    """L2: every Allow/Disallow value, trimmed, without * and $, one trailing ? dropped, trailing /.ext -> /.

    Keeps values longer than one byte; distinct per body, first occurrence order. ``(page_id, pos, path)``.
    """
    others = [c for c in bodies.columns if c != body]
    return bodies.select(*others, F.posexplode(_rules_of(F.col(body))).alias("pos", "path"))


def route_bodies(pages: DataFrame) -> DataFrame:
    """L3: a body fetched from a URL ending in robots.txt goes to L2, every other body to L1.

    ``(page_id, url, kind, pos, raw)`` with kind 'robots' or 'html'.
    """
    is_robots = F.col("url").endswith("robots.txt")
    found = F.when(is_robots, _rules_of(F.col("html"))).otherwise(_links_of(F.col("html")))
    kind = F.when(is_robots, F.lit("robots")).otherwise(F.lit("html"))
    return pages.select("page_id", "url", kind.alias("kind"), F.posexplode(found).alias("pos", "raw"))


def keep_link(page_url: Column, raw: Column) -> Column:
    """L4 predicate: not empty, not the page host or a suffix of it, not MIME-like, printable, and the page's own
    path has fewer than two dots."""
    host = U.url_hostport(page_url)
    path = U.url_path(page_url)
    dots = F.length(path) - F.length(F.replace(path, F.lit("."), F.lit("")))
    return (
        (raw != "")
        & (raw != host)
        & ~host.endswith(raw)
        & ~U.is_mime_like(raw)
        & ~U.is_unprintable(raw)
        & (dots < 2)
    )


def filter_links(links: DataFrame, url: str = "url", raw: str = "raw") -> DataFrame:
    """L4."""
    return links.where(keep_link(F.col(url), F.col(raw)))


def format_link(page_url: Column, raw: Column) -> Column:
    """L5 before normalisation: the crawler's ordered rules (not RFC 3986 resolution)."""
    p0 = F.replace(raw, F.lit("\\"), F.lit(""))
    p = F.when(~p0.startswith("/") & ~p0.startswith("http") & p0.contains("."), F.concat(F.lit("/"), p0)).otherwise(p0)
    scheme = U.url_scheme(page_url)
    host = U.url_hostport(page_url)
    root = F.concat(scheme, F.lit("://"), host)
    page_path = U.url_path(page_url)
    return (
        F.when(U.has_scheme(p) | U.is_domain_name(p) | p.startswith("//"), p)
        .when(p.contains(".") & p.startswith("/"), F.concat(root, p))
        .when(p.contains("."), F.concat(page_url, F.lit("/"), p))
        .when(p.startswith("/"), F.concat(root, p, F.lit("/")))
        .when(U.has_extension(p) | U.has_param(p), F.concat(root, page_path, F.lit("/"), p))
        .otherwise(F.concat(root, page_path, F.lit("/"), p, F.lit("/")))
    )


def resolve_links(links: DataFrame, url: str = "url", raw: str = "raw") -> DataFrame:
    """Adds ``resolved`` (canonical form; NULL when unparsable)."""
    d = links.withColumn("_fmt", format_link(F.col(url), F.col(raw)))
    return U.with_canonical(d, "_fmt", "resolved").drop("_fmt")


def expand_domain_links(links: DataFrame, url: str = "url", raw: str = "raw") -> DataFrame:
    """A domain-looking link also yields ``page_url/link`` as is, before itself. Adds ``kind`` and ``dst``."""
    d = resolve_links(links, url, raw)
    resolved = F.struct(F.lit("resolved").alias("kind"), F.col("resolved").alias("dst"))
    domain = F.struct(F.lit("domain").alias("kind"), F.concat(F.col(url), F.lit("/"), F.col(raw)).alias("dst"))
    outs = F.when(U.is_domain_name(F.col(raw)), F.array(domain, resolved)).otherwise(F.array(resolved))
    return d.select("*", F.explode(outs).alias("_o")).select("*", "_o.kind", "_o.dst").drop("_o", "resolved")


def link_targets(pages: DataFrame) -> DataFrame:
    """L7 before duplicates go: ``(src_page_id, src_url, dst_url, pos)`` for every link of a body or rule of a robots.txt
    body (L3) that passes L4, unparsable targets dropped. ``pos`` is the order in which the page gives its targets."""
    out = expand_domain_links(filter_links(route_bodies(pages).drop("kind")))
    second = U.is_domain_name(F.col("raw")) & (F.col("kind") == "resolved")
    pos = F.col("pos").cast("bigint") * 2 + F.when(second, 1).otherwise(0)
    return out.where(F.col("dst").isNotNull()).select(
        F.col("page_id").alias("src_page_id"), F.col("url").alias("src_url"), F.col("dst").alias("dst_url"), pos.alias("pos")
    )


def build_link_edges(pages: DataFrame) -> DataFrame:
    """``(src_page_id, src_url, dst_url, pos)``, one row per page and target with the target's first position."""
    return link_targets(pages).groupBy("src_page_id", "src_url", "dst_url").agg(F.min("pos").alias("pos"))


def host_outdegree(edges: DataFrame, approx: bool = False) -> DataFrame:
    """Per source host, edges and distinct targets (``approx=True``: HyperLogLog++ sketch, constant memory)."""
    distinct = F.approx_count_distinct("dst_url") if approx else F.count_distinct("dst_url")
    return (
        edges.select(F.lower(U.url_hostname("src_url")).alias("host"), "dst_url")
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n_edges"), distinct.alias("n_targets"))
    )


def url_indegree(edges: DataFrame, approx: bool = False) -> DataFrame:
    """Per target URL, linking pages (``approx=True``: HyperLogLog++ sketch)."""
    distinct = F.approx_count_distinct("src_page_id") if approx else F.count_distinct("src_page_id")
    return edges.groupBy("dst_url").agg(distinct.alias("indegree"))
