"""Registered queries: one per operator key of the inventory. Each takes (spark, sf_dir) and returns a DataFrame whose
columns match the DuckDB oracle in ``oracles.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import fetches as H
from ..operators import frontier as FR
from ..operators import links as L
from ..operators import params as P
from ..operators import report as R
from ..operators import scope as G
from ..operators import similar as N
from ..operators import urls as UO
from ..sources import io as IO
from ..streaming import jobs as S
from ..session import scratch_path
from . import fixtures as X

Q = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Q] = {}


def q(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn

    return deco


def _big(c):
    return F.col(c).cast("bigint")


# ---------------------------------------------------------------- shared inputs
def _seeds(spark, sf):
    return IO.split_seed_lines(X.seed_lines(spark, sf))


def _prepared(spark, sf):
    return IO.prepare_seeds(_seeds(spark, sf))


def _visited(spark, sf):
    return X.pages(spark, sf).select(U.clean_url(F.col("url")).alias("url"))


def _crawl_queue(spark, sf):
    return X.crawl_urls(spark, sf).select("seq", U.clean_url(F.col("url")).alias("url"))


def _crawl_with_host(spark, sf):
    return X.crawl_urls(spark, sf).select("seq", "url", F.lower(U.url_hostname(F.col("url"))).alias("host"))


def _params(spark, sf, last_rank=P.LAST_RANK):
    return P.mine_params(X.pages_plus(spark, sf), last_rank=last_rank)


def _bag(df):
    return df.select(_big("page_id").alias("page_id"), "name", "type", "source", "certainty", "url")


def _crawl_store(spark, sf):
    rb = X.robots_bodies(spark, sf).join(X.pages(spark, sf).select("page_id", "url"), "page_id").select(
        (F.col("page_id") + 1000000000).alias("page_id"),
        F.concat(F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]*)", 1), F.lit("/robots.txt")).alias("url"),
        F.col("body").alias("html"),
    )
    return X.pages_plus(spark, sf).unionByName(rb)


def _crawl_results(spark, sf):
    seq = F.col("seq")
    st = F.when(seq % 7 == 0, 404).when(seq % 7 == 1, 301).when(seq % 7 == 2, 500).otherwise(200)
    return X.crawl_urls(spark, sf).select(
        seq.alias("page_id"), F.col("url").alias("request_url"), st.alias("status_code"), (seq % 6 == 1).alias("is_catch_all")
    )


# ---------------------------------------------------------------- IO
@q("seeds_from_list")
def seeds_from_list(spark, sf):
    return _seeds(spark, sf).select(_big("page_id").alias("page_id"), _big("pos").alias("pos"), "seed")


@q("stream_seeds")
def stream_seeds(spark, sf):
    folder = scratch_path(spark, "seed-lines")
    X.seed_lines(spark, sf).select("value").write.text(folder)
    return S.run_available(S.stream_seeds(spark, folder), "seeds")


@q("pages_scan")
def pages_scan(spark, sf):
    return IO.load_pages(spark, f"{sf}/pages.parquet").select(
        "page_id", "url", F.octet_length("html").cast("bigint").alias("html_bytes")
    )


@q("wordlist_clean")
def wordlist_clean(spark, sf):
    return IO.load_wordlist(X.wordlist_lines(spark, sf))


@q("result_lines")
def result_lines(spark, sf):
    res = H.resolve_redirects(X.fetch_log(spark, sf))
    return IO.result_lines(res).select(_big("page_id").alias("page_id"), "line")


@q("result_file")
def result_file(spark, sf):
    path = scratch_path(spark, "result-file")
    IO.write_results(_crawl_results(spark, sf), path, hide_media_urls=True, exts=["js", "html", "com/"])
    return spark.read.text(path).select(F.col("value").alias("line"))


@q("params_json")
def params_json(spark, sf):
    return P.params_json(_params(spark, sf)).select(
        _big("page_id").alias("page_id"), _big("rank").alias("rank"), _big("pos").alias("pos"), "json"
    )


@q("prepare_seeds")
def prepare_seeds(spark, sf):
    return _prepared(spark, sf).select(
        _big("page_id").alias("page_id"), _big("pos").alias("pos"), "seed", "url", "host", "hostname"
    )


# ---------------------------------------------------------------- URL jobs
@q("url_parts")
def url_parts(spark, sf):
    return X.crawl_urls(spark, sf).select("seq", "url", U.url_parts("url").alias("u")).select("seq", "url", "u.*")


@q("canonical_urls")
def canonical_urls(spark, sf):
    return U.with_canonical(X.crawl_urls(spark, sf), "url", "canonical_url").select("seq", "url", "canonical_url")


@q("canonical_groups")
def canonical_groups(spark, sf):
    c = U.with_canonical(X.crawl_urls(spark, sf), "url", "canonical_url")
    return c.groupBy("canonical_url").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@q("queue_urls")
def queue_urls(spark, sf):
    return X.crawl_urls(spark, sf).select("seq", "url", U.clean_url(F.col("url")).alias("queue_url"))


@q("dedupe_visited")
def dedupe_visited(spark, sf):
    return UO.dedupe_visited(_crawl_queue(spark, sf), _visited(spark, sf))


@q("alias_path")
def alias_path(spark, sf):
    return UO.collapse_query_aliases(X.crawl_urls(spark, sf), "path")


@q("alias_global")
def alias_global(spark, sf):
    return UO.collapse_query_aliases(X.crawl_urls(spark, sf), "global")


@q("ext_histogram")
def ext_histogram(spark, sf):
    c = X.crawl_urls(spark, sf)
    return c.select(U.has_extension(F.col("url")).alias("has_ext"), U.extension_of(F.col("url")).alias("ext")).groupBy(
        "has_ext", "ext"
    ).agg(F.count(F.lit(1)).alias("n"))


@q("trap_urls")
def trap_urls(spark, sf):
    return X.crawl_urls(spark, sf).select("seq", "url", U.is_trapped(U.url_path(F.col("url"))).alias("trapped"))


# ---------------------------------------------------------------- links
def _links_kept(spark, sf):
    return L.filter_links(L.extract_links(X.pages_plus(spark, sf)))


@q("links_raw")
def links_raw(spark, sf):
    return L.extract_links(X.pages_plus(spark, sf)).select("page_id", _big("pos").alias("pos"), "raw")


@q("robots_paths")
def robots_paths(spark, sf):
    return L.extract_robots(X.robots_bodies(spark, sf)).select("page_id", _big("pos").alias("pos"), "path")


@q("links_routed")
def links_routed(spark, sf):
    return L.route_bodies(_crawl_store(spark, sf)).select("page_id", "kind", _big("pos").alias("pos"), "raw")


@q("links_kept")
def links_kept(spark, sf):
    return _links_kept(spark, sf).select("page_id", _big("pos").alias("pos"), "raw")


@q("links_resolved")
def links_resolved(spark, sf):
    return L.resolve_links(_links_kept(spark, sf)).select("page_id", _big("pos").alias("pos"), "raw", "resolved")


@q("links_domain")
def links_domain(spark, sf):
    return L.expand_domain_links(_links_kept(spark, sf)).select("page_id", _big("pos").alias("pos"), "raw", "kind", "dst")


@q("link_edges")
def link_edges(spark, sf):
    return L.build_link_edges(_crawl_store(spark, sf))


@q("host_outdegree")
def host_outdegree(spark, sf):
    return L.host_outdegree(L.build_link_edges(X.pages_plus(spark, sf)))


@q("url_indegree")
def url_indegree(spark, sf):
    return L.url_indegree(L.build_link_edges(X.pages_plus(spark, sf)))


# ---------------------------------------------------------------- scope & frontier
def _rules(spark, which):
    r = X.scope_rules(spark)
    return r if which == "all" else r.where(F.col("action") == which)


@q("scope_include")
def scope_include(spark, sf):
    return G.filter_scope(_crawl_with_host(spark, sf), _rules(spark, "include"))


@q("scope_exclude")
def scope_exclude(spark, sf):
    return G.filter_scope(_crawl_with_host(spark, sf), _rules(spark, "exclude"))


@q("scope_default")
def scope_default(spark, sf):
    return G.filter_scope(_crawl_with_host(spark, sf), _rules(spark, "all"))


@q("frontier_admitted")
def frontier_admitted(spark, sf):
    return FR.admit_frontier(_crawl_queue(spark, sf), _visited(spark, sf), _rules(spark, "all"))


@q("robots_seeds")
def robots_seeds(spark, sf):
    prep = _prepared(spark, sf).select(U.clean_url(F.col("url")).alias("url"))
    return FR.seed_robots(prep, _visited(spark, sf))


@q("discovery_candidates")
def discovery_candidates(spark, sf):
    hosts = FR.visited_hosts(_prepared(spark, sf))
    words = wordlist_clean(spark, sf)
    return FR.discover_paths(hosts, words, _visited(spark, sf))


@q("visited_hosts")
def visited_hosts(spark, sf):
    return FR.visited_hosts(_prepared(spark, sf))


@q("frontier_rounds")
def frontier_rounds(spark, sf):
    lp = X.linked_pages(spark, sf)
    seeds = lp.where(F.col("page_id") == 0).select(F.col("url").alias("seed"))
    rules = spark.createDataFrame([("include", "example")], "action STRING, pattern STRING")
    return FR.expand_frontier(seeds, lp, rules).select("url", _big("depth").alias("depth"), "page_id")


@q("frontier_next")
def frontier_next(spark, sf):
    return FR.next_frontier(_crawl_store(spark, sf)).select(
        "url", "host", _big("first_src_page_id").alias("first_src_page_id"), _big("n_links").alias("n_links")
    )


# ---------------------------------------------------------------- fetch outcomes
@q("redirect_chains")
def redirect_chains(spark, sf):
    return H.assemble_results(H.resolve_redirects(X.fetch_log(spark, sf)))


def _crawled(spark, sf):
    """A fetch log with bodies: the stored pages' log, and further copies of bodies fetched under URLs of their own."""
    b, pid = X.bodies(spark, sf), F.col("page_id")
    more = pid >= 1000000
    b = b.withColumn("url", F.when(more, F.concat("url", F.lit("?copy="), pid.cast("string"))).otherwise(F.col("url")))
    copies = b.where(more).select("page_id", "url", F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("location"))
    return X.fetch_log(spark, sf).unionByName(copies), b


@q("crawl_results")
def crawl_results(spark, sf):
    return H.crawl_results(*_crawled(spark, sf))


@q("crawl_report")
def crawl_report(spark, sf):
    return R.report(H.crawl_results(*_crawled(spark, sf)), hide_media_urls=True)


@q("redirect_first_hop")
def redirect_first_hop(spark, sf):
    return H.assemble_results(H.first_hop(X.fetch_log(spark, sf)))


@q("catch_all")
def catch_all(spark, sf):
    r = H.resolve_redirects(X.fetch_log(spark, sf))
    r = r.withColumn(
        "final_url",
        F.concat("final_url", F.when(F.col("page_id") % 7 == 0, F.lit("/error/notfound")).otherwise(F.lit(""))),
    )
    return H.flag_catch_all(r).select("page_id", "final_url", "is_catch_all")


@q("results")
def results(spark, sf):
    return H.assemble_results(H.resolve_redirects(X.fetch_log(spark, sf))).select(
        "page_id", "request_url", "final_url", "status_code", "error", "is_catch_all"
    )


# ---------------------------------------------------------------- similar bodies
@q("similar_bodies")
def similar_bodies(spark, sf):
    return N.similar_bodies(X.bodies(spark, sf)).select("page_id", F.col("grp").alias("host"), "similar_to")


@q("similar_bodies_kept")
def similar_bodies_kept(spark, sf):
    return N.drop_similar_bodies(X.bodies(spark, sf)).select("page_id")


@q("exact_bodies")
def exact_bodies(spark, sf):
    return N.exact_body_groups(X.bodies(spark, sf)).select("page_id", F.col("grp").alias("host"), "dup_of")


# ---------------------------------------------------------------- parameters
def _extractor_query(rank):
    def fn(spark, sf):
        return _bag(P.params_of_extractor(_params(spark, sf, rank), rank))

    return fn


for _key, _rank in P.EXTRACTOR_BY_KEY.items():
    REGISTRY[_key] = _extractor_query(_rank)


@q("params_object_keys")
def params_object_keys(spark, sf):
    return _bag(_params(spark, sf, 9).where(F.col("rank").isin(7, 8, 9)))


@q("params_by_page")
def params_by_page(spark, sf):
    return _bag(_params(spark, sf))


@q("params_unique")
def params_unique(spark, sf):
    return P.unique_params(_params(spark, sf)).select("name", "type", "source", "certainty", "url", _big("page_id").alias("page_id"))


@q("params_form")
def params_form(spark, sf):
    return _bag(P.params_of_type(_params(spark, sf, P.last_rank_of("form", 1)), "form"))


@q("params_high")
def params_high(spark, sf):
    return _bag(P.params_of_certainty(_params(spark, sf, P.last_rank_of("high", 3)), "high"))


@q("param_summary")
def param_summary(spark, sf):
    return P.param_summary(P.unique_params(_params(spark, sf)))


# ---------------------------------------------------------------- reporting
@q("report_no_media")
def report_no_media(spark, sf):
    return R.hide_media(_crawl_results(spark, sf)).select(_big("page_id").alias("page_id"), "request_url")


@q("report_ext")
def report_ext(spark, sf):
    return R.filter_extension(_crawl_results(spark, sf), ["js", "html"]).select(_big("page_id").alias("page_id"), "request_url")


@q("report_distinct")
def report_distinct(spark, sf):
    return R.distinct_requests(_crawl_results(spark, sf)).select(
        "request_url", _big("page_id").alias("page_id"), _big("status_code").alias("status_code")
    )


@q("report_status")
def report_status(spark, sf):
    return R.filter_status(_crawl_results(spark, sf), [200, 404]).select(
        _big("page_id").alias("page_id"), "request_url", _big("status_code").alias("status_code")
    )


@q("report_labels")
def report_labels(spark, sf):
    return R.label_results(_crawl_results(spark, sf)).select(
        _big("page_id").alias("page_id"), "request_url", "status_class", "line", "shown"
    )


@q("report_lines")
def report_lines(spark, sf):
    return R.report(_crawl_results(spark, sf), hide_media_urls=True)


@q("status_by_host")
def status_by_host(spark, sf):
    return R.status_rollup(_crawl_results(spark, sf))


# ---------------------------------------------------------------- streaming
def _pages_stream(spark, sf):
    return S.stream_stored(spark, f"{sf.rstrip('/')}/pages.parquet")


def _pages_plus_stream(spark, sf):
    p = _pages_stream(spark, sf)
    snippet = X.PAGES_PLUS_SNIPPETS
    m = F.col("page_id") % 9
    extra = F.when(m == 0, F.lit(snippet[0]))
    for i in range(1, 8):
        extra = extra.when(m == i, F.lit(snippet[i]))
    return p.select("page_id", "url", F.concat("html", extra.otherwise(F.lit(snippet[8]))).alias("html"))


@q("stream_dedupe")
def stream_dedupe(spark, sf):
    p = _pages_stream(spark, sf).select("page_id", "url")
    pid = F.col("page_id")
    base = F.regexp_replace("url", r"(?s)[?#].*$", "")
    urls = p.select("url").unionByName(
        p.select(F.concat(base, F.repeat(F.lit("/loop"), (pid % 14).cast("int"))).alias("url"))
    ).unionByName(
        p.select(F.concat(base, F.lit("?page="), (pid % 4).cast("string"), F.lit("&ref=x")).alias("url"))
    ).unionByName(
        p.select(F.concat(F.lit("HTTP://EXAMPLE"), (pid % 20).cast("string"), F.lit(".COM:80//a/./b/../c%2d/?b=2&a="),
                          (pid % 3).cast("string")).alias("url"))
    )
    return S.run_available(S.stream_dedupe_urls(urls), "dedupe")


@q("stream_links")
def stream_links(spark, sf):
    return S.run_available(S.stream_links(_pages_plus_stream(spark, sf)), "links").select("src_page_id", "src_url", "dst_url").distinct()


@q("stream_params")
def stream_params(spark, sf):
    return _bag(S.run_available(S.stream_params(_pages_plus_stream(spark, sf)), "params"))


@q("stream_report")
def stream_report(spark, sf):
    p = _pages_stream(spark, sf).select("page_id", "url")
    m = F.col("page_id") % 50
    status = (
        F.when(m.between(20, 32), 301).when(m.isin(5, 6, 44, 45), 302).when(m.isin(11, 12), 404)
        .when(m == 17, 500).when(m == 18, 0).otherwise(200)
    )
    loc_id = F.when(m.between(20, 32) | m.isin(5, 6, 44), F.col("page_id") + 1).when(m == 45, F.col("page_id") - 1)
    f = p.select("page_id", "url", status.cast("int").alias("status_code"), loc_id.alias("location_page_id"))
    tgt = X.pages(spark, sf).select(F.col("page_id").alias("location_page_id"), F.col("url").alias("location"))
    fetches = f.join(tgt, "location_page_id", "left").select("page_id", "url", "status_code", "location")
    out = S.run_available(S.stream_report(fetches), "report")
    return out.select("request_url", _big("status_code").alias("status_code"), "line")


@q("stream_param_counts")
def stream_param_counts(spark, sf):
    return S.run_counts(S.stream_param_counts(_pages_plus_stream(spark, sf)), "param-counts")
