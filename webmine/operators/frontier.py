"""Frontier admission, robots seeds, discovery candidates, visited hosts, the crawl loop and one round."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import cut_lineage, scratch_path
from ..sources.io import prepare_seeds
from .links import build_link_edges
from .scope import ScopeRules, filter_scope, prepare_rules
from .urls import collapse_query_aliases, query_pairs


def admit_frontier(candidates: DataFrame, visited: DataFrame | None, rules: DataFrame | ScopeRules, alias_scope: str = "path",
                   url: str = "url", seq: str = "seq") -> DataFrame:
    """first occurrence of each URL that has a host, is in scope, is unvisited, not a trap and not redundant.

    ``candidates(seq, url)`` are queue-form URLs; ``visited(url)``. ``seq`` is any orderable type; URLs with equal ``seq``
    don't make each other redundant, so give a total order (a page and a position on it). Returns ``(seq, url, host)``.
    """
    return _admit(candidates.select(seq, url, F.lit(1).alias("_w")), visited, rules, alias_scope, url, seq).drop("n_links")


def _admit(candidates: DataFrame, visited: DataFrame | None, rules: DataFrame | ScopeRules, alias_scope: str, url: str,
           seq: str) -> DataFrame:
    """F1 with ``n_links``, the sum of the candidates' weights ``_w`` per URL."""
    c = candidates.groupBy(url).agg(F.min(seq).alias(seq), F.sum("_w").alias("n_links"))
    if visited is not None:
        c = c.join(visited.select(url).distinct(), url, "left_anti")
    c = c.withColumn("host", F.lower(U.url_hostname(F.col(url)))).where(F.col("host") != "")
    c = c.where(~U.is_trapped(U.url_path(F.col(url))))
    # the candidate set feeds three joins (host verdicts, semi join, alias groups): materialise it once
    c = cut_lineage(c.select(seq, url, "host", "n_links"))
    # scoped candidates feed the alias check and the join back: materialise once so the verdict plan runs once
    c = cut_lineage(filter_scope(c, rules, "host"))
    # visited URLs count as earlier than every candidate for the query-alias check, then are dropped again
    alias_in = c.select(F.struct(F.lit(1).alias("new"), F.col(seq).alias("s")).alias("_o"), url, "n_links")
    if visited is not None:
        none = F.lit(None).cast(c.schema[seq].dataType).alias("s")
        old = visited.select(F.struct(F.lit(0).alias("new"), none).alias("_o"), url, F.lit(None).cast("bigint").alias("n_links"))
        alias_in = old.distinct().unionByName(alias_in)
    kept = collapse_query_aliases(alias_in, alias_scope, url, "_o").where(F.col("_o.new") == 1)
    return kept.select(F.col("_o.s").alias(seq), url, F.lower(U.url_hostname(F.col(url))).alias("host"), "n_links")


def robots_of(urls: DataFrame, url: str = "url") -> DataFrame:
    """F2 per row: the rows whose URL has an empty or "/" path, with ``url`` the robots.txt of their host."""
    path = U.url_path(F.col(url))
    robots = F.concat(U.url_scheme(F.col(url)), F.lit("://"), U.url_hostport(F.col(url)), F.lit("/robots.txt"))
    return urls.where(path.isin("", "/")).withColumn("url", robots)


def seed_robots(urls: DataFrame, visited: DataFrame | None = None, url: str = "url") -> DataFrame:
    """a URL with an empty or "/" path adds ``scheme://host/robots.txt`` (distinct, unvisited)."""
    r = robots_of(urls, url).select("url").distinct()
    if visited is not None:
        r = r.join(visited.select("url").distinct(), "url", "left_anti")
    return r


def visited_hosts(prepared_seeds: DataFrame) -> DataFrame:
    """only seed hostnames (no port) are recorded."""
    return prepared_seeds.select(F.col("hostname").alias("host")).where(F.col("host") != "").distinct()


#: A wordlist of up to so many bytes goes to every task whole; a longer one is joined by WORD_KEYS keys.
WORDLIST_BYTES, WORD_KEYS = 8 << 20, 64


def discover_paths(hosts: DataFrame, wordlist: DataFrame, visited: DataFrame | None = None) -> DataFrame:
    """every host x word x {https, http}, one leading '/' trimmed; unvisited. Returns ``(url, queue_url)``.

    The output is hosts x words by definition. A wordlist is configuration: its distinct words are counted in bytes, and
    up to WORDLIST_BYTES they are one broadcast row that each host's task unfolds, so that the product is streamed and
    only it is shuffled, for the visited check. A longer list isn't broadcast: each word has one of WORD_KEYS keys, every
    (host, scheme) row is repeated for each key, and the two meet in an equi-join. Nothing is collected.
    """
    words = cut_lineage(wordlist.select(F.regexp_replace("path", r"^/", "").alias("word")).distinct())
    h = hosts.select("host").distinct().select("host", F.explode(F.array(F.lit("https"), F.lit("http"))).alias("scheme"))
    size = words.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0
    if size <= WORDLIST_BYTES:
        one = words.agg(F.collect_list("word").alias("words")).withColumn("k", F.lit(0))
        pairs = h.withColumn("k", F.lit(0)).join(F.broadcast(one), "k").select("host", "scheme", F.explode("words").alias("word"))
    else:
        keyed = words.withColumn("k", F.pmod(F.xxhash64("word"), F.lit(WORD_KEYS)).cast("int"))
        pairs = h.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(WORD_KEYS - 1)))).join(keyed, "k")
    out = pairs.select(F.concat("scheme", F.lit("://"), "host", F.lit("/"), "word").alias("url"))
    if visited is not None:
        out = out.join(visited.select("url").distinct(), "url", "left_anti")
    return out.distinct().select("url", U.clean_url(F.col("url")).alias("queue_url"))


def next_frontier(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """F6 (flagship): one crawl round from everything stored.

    Edges of all pages (L7, robots.txt bodies included) and the robots.txt of stored root URLs (F2) become queue-form
    candidates, ordered by page and position on it; stored pages are visited and their hosts are scope includes (as
    seeds would be). Returns the admitted URLs with their first linking page and link count (0: a robots.txt seed only).
    """
    order = lambda page, pos: F.struct(page.cast("bigint").alias("page"), pos.cast("bigint").alias("pos")).alias("seq")
    cand = build_link_edges(pages).select(
        order(F.col("src_page_id"), F.col("pos")), U.clean_url(F.col("dst_url")).alias("url"), F.lit(1).alias("_w")
    )
    robots = robots_of(pages.select("page_id", U.clean_url(F.col("url")).alias("url"))).select(
        order(F.col("page_id"), F.lit(-1)), "url", F.lit(0).alias("_w")
    )
    visited = pages.select(U.clean_url(F.col("url")).alias("url"))
    seed_hosts = pages.select(F.lit("include").alias("action"), F.lower(U.url_hostname(F.col("url"))).alias("pattern"))
    all_rules = cut_lineage((seed_hosts if rules is None else seed_hosts.unionByName(rules)).distinct())
    admitted = _admit(cand.unionByName(robots), visited, all_rules, "path", "url", "seq")
    return admitted.select("url", "host", F.col("seq.page").alias("first_src_page_id"), "n_links")


def _targets(urls: DataFrame, rules: ScopeRules) -> DataFrame:
    """What the crawl loop asks of a URL, once per distinct ``url`` that has a host, is in scope and no trap: ``key``
    (the canonical form that stored pages go by), ``base`` (the query-less form), ``aliasable`` (it has a parsable
    query), ``parsable`` (it can make others redundant), ``robots`` and ``robots_key`` (of a root URL, else NULL)."""
    u = urls.select("url").distinct().withColumn("host", F.lower(U.url_hostname(F.col("url"))))
    u = u.where((F.col("host") != "") & ~U.is_trapped(U.url_path(F.col("url"))))
    u = filter_scope(cut_lineage(u), rules, "host").select("url")
    queries = U.url_query(F.col("url"))
    u = u.select("url", U.strip_query(F.col("url")).alias("base"), queries.alias("q")).withColumn("p", F.when(F.col("q") != "", query_pairs(F.col("q"))).isNotNull())
    u = u.select("url", "base", ((F.col("q") != "") & F.col("p")).alias("aliasable"), ((F.col("q") == "") | F.col("p")).alias("parsable"))
    u = U.with_canonical(u, "url", "key")
    robots = robots_of(u.select("url", F.col("url").alias("robots")), "robots")
    robots = U.with_canonical(robots, "robots", "robots_key")
    return u.join(robots, "url", "left")


_STATE = "url string, base string, aliasable boolean, parsable boolean, key string, robots string, robots_key string"
_FIELDS = ["base", "aliasable", "parsable", "key", "robots", "robots_key"]


def _round(frontier: DataFrame, edges: DataFrame, visited: DataFrame) -> DataFrame:
    """The URLs that a round admits: targets of the frontier's stored pages and robots.txt of its root URLs, unvisited,
    and without an earlier URL of the same base (visited ones come first, then page and position)."""
    found = edges.join(frontier.select(F.col("key").alias("src_key")).distinct(), "src_key").drop("src_key")
    nothing = F.lit(None).cast("string")
    robots = frontier.where(F.col("robots").isNotNull()).select(
        F.struct(F.lit(-1).cast("bigint").alias("page"), F.lit(0).cast("bigint").alias("pos")).alias("seq"), F.col("robots").alias("url"),
        F.col("robots").alias("base"), F.lit(False).alias("aliasable"), F.lit(True).alias("parsable"), F.col("robots_key").alias("key"),
        nothing.alias("robots"), nothing.alias("robots_key"),
    )
    # the other columns follow from the URL
    cand = found.unionByName(robots).groupBy("url").agg(F.min("seq").alias("seq"), *[F.min(c).alias(c) for c in _FIELDS])
    # What of the visited set touches this round: the candidates are the small side of both joins.
    new = cut_lineage(cand.join(visited.select("url"), "url", "left_anti"))
    known = visited.where("parsable").select("base").join(new.where("aliasable").select("base"), "base", "left_semi").distinct()
    first = new.where("parsable").groupBy("base").agg(F.min("seq").alias("first"))
    judged = new.join(first, "base", "left").join(known.withColumn("known", F.lit(True)), "base", "left")
    redundant = F.col("aliasable") & (F.coalesce("known", F.lit(False)) | F.coalesce(F.col("first") < F.col("seq"), F.lit(False)))
    return judged.where(~redundant).select("url", *_FIELDS)


def expand_frontier(seeds: DataFrame, pages: DataFrame, rules: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """the crawl loop over stored pages. Round 0 is the prepared seeds; each round joins the frontier to stored
    bodies (by canonical URL), takes their links (L7) in the order of page and position, and the robots.txt of its root
    URLs (F2), and admits unvisited in-scope URLs (F1). Stops when a round admits nothing, or after ``max_rounds`` if
    that is given.

    Evaluation is semi-naive. Links are extracted once, and what F1 asks of a target (scope, trap, canonical form,
    query-less form) is worked out once per distinct target. A round joins only the last round's URLs with the links,
    and writes what it admits as a part of its own under its depth, in the shared folder; the visited set is the union
    of these parts, so bytes written follow the frontier and nothing is written twice.

    Returns ``(url, depth, page_id)`` — page_id is NULL for a URL with no stored body.
    """
    spark = pages.sparkSession
    prep = prepare_seeds(seeds)
    seed_rules = prep.select(F.lit("include").alias("action"), F.col("host").alias("pattern"))
    all_rules = prepare_rules(cut_lineage(rules.unionByName(seed_rules)))  # once for every round
    store = U.with_canonical(pages.select("page_id", "url", "html", U.clean_url(F.col("url")).alias("queue_url")), "queue_url", "key").drop("queue_url")
    # Links of all stored pages, once: html is read here and never again; the rounds join narrow edges.
    keyed = cut_lineage(store.select("page_id", "key"))
    links = build_link_edges(store.select("page_id", "url", "html")).select(
        "src_page_id", F.struct(F.col("src_page_id").cast("bigint").alias("page"), "pos").alias("seq"), U.clean_url(F.col("dst_url")).alias("url")
    )
    links = cut_lineage(links)
    sources = keyed.select(F.col("page_id").alias("src_page_id"), F.col("key").alias("src_key"))
    edges = cut_lineage(links.join(_targets(links, all_rules), "url").join(sources, "src_page_id").drop("src_page_id"))
    start = _targets(prep.select(U.clean_url(F.col("url")).alias("url")), all_rules)

    root, parts = scratch_path(spark, "frontier"), []

    def visited() -> DataFrame:
        return spark.read.schema(_STATE).option("basePath", root).parquet(*parts)

    for depth in itertools.count() if max_rounds is None else range(max_rounds + 1):
        admitted = start.select("url", *_FIELDS) if depth == 0 else _round(spark.read.schema(_STATE).parquet(parts[-1]), edges, visited())
        admitted.write.parquet(f"{root}/depth={depth}")
        parts.append(f"{root}/depth={depth}")
        if spark.read.schema(_STATE).parquet(parts[-1]).isEmpty():
            break
    reached = spark.read.schema(_STATE + ", depth int").option("basePath", root).parquet(*parts).select("url", "depth", "key")
    return reached.join(keyed, "key", "left").select("url", "depth", "page_id")
