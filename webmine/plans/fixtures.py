"""Derived views from FIXTURES.md, built with the DataFrame API over the driver's tables.

Each view grows with ``pages``; the same definitions exist as SQL text in ``oracles.py`` for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import load_table

PAGES_PLUS_SNIPPETS = [
    '<form><input type="text" name="q_user"><textarea name="message"></textarea><select name="country"></select></form>',
    '<input type="hidden" name="csrf_token"><input type=hidden xname="legacy_tok">',
    '<script>fetch("/api/users?limit=10&offset=20"); xhr.open("GET", "/api/x?sid=1");</script>',
    '<script>fetch("/p",{method:"POST",body: JSON.stringify({title: 1, content: 2})})</script>',
    '<script>$.post("/u", {user_id: 1, email: 2}); $.ajax({url:"/s", data: {name: 1, age: 2}})</script>',
    "<script>query G($userId: ID!, $inc: [Boolean]) { a }</script>",
    '<script>new WebSocket("wss://h.example/ws?token=a&room=b")</script>',
    '<div data-user-id="1" data-api-key="2"></div><meta name="base_url" content="/api/v1">',
    '<a href="../lib/app.js"></a><a href="img/logo.png?v=1"></a><a href="sub/dir"></a>'
    '<a href="//cdn.example.org/x.css"></a><a href="image/jpeg"></a>',
]

SCOPE_RULES = [
    ("include", "example.org"),
    ("include", "blog"),
    ("include", "example3.com"),
    ("include", "example4.com"),
    ("exclude", "thth"),
    ("exclude", "example3.com"),
]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored pages."""
    return load_table(spark, sf_dir, "pages").select("page_id", "url", "html")


def pages_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    m = F.col("page_id") % 9
    extra = F.when(m == 0, F.lit(PAGES_PLUS_SNIPPETS[0]))
    for i in range(1, 8):
        extra = extra.when(m == i, F.lit(PAGES_PLUS_SNIPPETS[i]))
    extra = extra.otherwise(F.lit(PAGES_PLUS_SNIPPETS[8]))
    return p.select("page_id", "url", F.concat("html", extra).alias("html"))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select("page_id", "url")
    m = F.col("page_id") % 50
    status = (
        F.when(m.between(20, 32), 301)
        .when(m.isin(5, 6, 44, 45), 302)
        .when(m.isin(11, 12), 404)
        .when(m == 17, 500)
        .when(m == 18, 0)
        .otherwise(200)
    )
    loc_id = F.when(m.between(20, 32) | m.isin(5, 6, 44), F.col("page_id") + 1).when(m == 45, F.col("page_id") - 1)
    f = p.select("page_id", "url", status.cast("int").alias("status_code"), loc_id.alias("location_page_id"))
    tgt = p.select(F.col("page_id").alias("location_page_id"), F.col("url").alias("location"))
    return f.join(tgt, "location_page_id", "left").select("page_id", "url", "status_code", "location")


def robots_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    nl = F.lit("\n")
    body = F.concat(
        F.lit("User-agent: *"), nl, F.lit("Disallow: /admin"), nl,
        F.lit("Allow: /p"), (F.col("page_id") % 13).cast("string"), F.lit("/*.tmp$"), nl,
        F.lit("Disallow: /q"), (F.col("page_id") % 5).cast("string"), F.lit("?"), nl,
        F.lit("Disallow: "), nl, F.lit("Allow: /after"), nl, F.lit("Disallow: /t/.htm"),
    )
    return pages(spark, sf_dir).select("page_id", body.alias("body"))


def crawl_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select("page_id", "url")
    pid = F.col("page_id")
    base = F.regexp_replace("url", r"(?s)[?#].*$", "")
    parts = [
        p.select((pid * 5).alias("seq"), F.col("url")),
        p.select((pid * 5 + 1).alias("seq"), F.concat(base, F.repeat(F.lit("/loop"), (pid % 14).cast("int"))).alias("url")),
        p.select(
            (pid * 5 + 2).alias("seq"),
            F.concat(base, F.lit("?page="), (pid % 4).cast("string"), F.lit("&ref=x")).alias("url"),
        ),
        p.select(
            (pid * 5 + 3).alias("seq"),
            F.concat(
                F.lit("HTTP://EXAMPLE"), (pid % 20).cast("string"), F.lit(".COM:80//a/./b/../c%2d/?b=2&a="),
                (pid % 3).cast("string"),
            ).alias("url"),
        ),
        p.select(
            (pid * 5 + 4).alias("seq"),
            F.concat(
                base,
                F.when(pid % 4 == 0, "/i.png").when(pid % 4 == 1, "/a.js").when(pid % 4 == 2, "/f.woff2").otherwise("/a.js?v=1"),
            ).alias("url"),
        ),
    ]
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    pid = F.col("page_id")
    return (
        p.select("page_id", "url", "html")
        .unionByName(p.where(pid % 3 == 0).select((pid + 1000000).alias("page_id"), "url", F.concat("html", F.lit(" extra words")).alias("html")))
        .unionByName(p.where(pid % 5 == 0).select((pid + 2000000).alias("page_id"), "url", "html"))
        .unionByName(
            p.where(pid % 4 == 0).select(
                (pid + 3000000).alias("page_id"), "url",
                F.substring("html", 1, F.floor(F.length("html") / 2).cast("int")).alias("html"),
            )
        )
    )


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    a = p.select(F.col("page_id").alias("a_id"), F.col("url").alias("a_url"))
    b = p.select(F.col("page_id").alias("b_id"), F.col("url").alias("b_url"))
    j = p.join(a, F.col("a_id") == 2 * F.col("page_id") + 1, "left").join(b, F.col("b_id") == 2 * F.col("page_id") + 2, "left")
    link = lambda u: F.when(u.isNull(), F.lit("")).otherwise(F.concat(F.lit('<a href="'), u, F.lit('"></a>')))
    return j.select("page_id", "url", F.concat("html", link(F.col("a_url")), link(F.col("b_url"))).alias("html"))


def scope_rules(spark: SparkSession) -> DataFrame:
    """Rules are configuration (a few lines), not data; they filter tables derived from ``pages``."""
    return spark.createDataFrame(SCOPE_RULES, "action STRING, pattern STRING")


def seed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target lines derived from stored pages: bare host, default-port URL, plain URL, or a comma list of two hosts."""
    p = pages(spark, sf_dir).select("page_id", "url")
    pid = F.col("page_id")
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1)
    scheme = F.regexp_extract("url", r"^([a-zA-Z]+)://", 1)
    port = F.when(scheme == "https", F.lit(":443")).otherwise(F.lit(":80"))
    with_port = F.concat(scheme, F.lit("://"), host, port, F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+(.*)$", 1))
    line = (
        F.when(pid % 4 == 0, host)
        .when(pid % 4 == 1, with_port)
        .when(pid % 4 == 2, F.col("url"))
        .otherwise(F.concat(host, F.lit(", www."), host))
    )
    return p.select("page_id", line.alias("value"))


def wordlist_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wordlist lines derived from stored pages: first path segment, padded, commented, blank, or with a leading /."""
    p = pages(spark, sf_dir).select("page_id", "url")
    pid = F.col("page_id")
    seg = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+/([^/?#]*)", 1)
    line = (
        F.when(pid % 5 == 0, seg)
        .when(pid % 5 == 1, F.concat(F.lit("  "), seg, F.lit(" ")))
        .when(pid % 5 == 2, F.concat(F.lit("# "), seg))
        .when(pid % 5 == 3, F.lit(""))
        .otherwise(F.concat(F.lit("/"), seg, F.lit(".json")))
    )
    return p.select("page_id", line.alias("value"))
