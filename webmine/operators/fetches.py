"""H1-H4: redirect chains, first-hop results, catch-all flags and result assembly over a fetch log.

``fetches(page_id, url, status_code, location)``: one row per fetched URL; status 0 is a failed fetch.
Each request is resolved on its own (the crawler's shared visited map made cross-request outcomes timing-dependent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import BODY_SIMILARITY_CUT, CATCH_ALL_WORDS, MAX_REQUESTS_PER_CHAIN
from ..session import cut_lineage
from .similar import similar_bodies

HOP = "struct<url:string,status_code:int,type:string>"


def is_catch_all(c: Column) -> Column:
    """H3 predicate: the URL contains one of the catch-all words (case-sensitive)."""
    cond = F.lit(False)
    for w in CATCH_ALL_WORDS:
        cond = cond | c.contains(w)
    return cond


def _is_redirect(status: Column) -> Column:
    return (status >= 300) & (status <= 399)


def redirect_paths(nodes: DataFrame, max_requests: int) -> DataFrame:
    """``(url, path ARRAY<STRUCT<url,status_code,type>>, end)`` for every URL that redirects: the redirecting URLs from
    it on, and where the last of them leads. Paths of ``max_requests`` and more hops may stop anywhere beyond that.

    Pointer doubling: paths of up to 2^k hops are joined with the paths of their ends, so ten requests take four rounds
    (fewer if none grows). ``nodes``: (url, st, loc), one row per URL. On a cycle a path runs round.
    """
    hop = F.struct(F.col("url").alias("url"), F.col("st").alias("status_code"), F.lit("http").alias("type"))
    paths = cut_lineage(nodes.where(_is_redirect(F.col("st")) & F.col("loc").isNotNull()).select("url", F.array(hop).alias("path"), F.col("loc").alias("end")))
    hops = 1
    while hops < max_requests:
        onward = paths.select(F.col("url").alias("end"), F.col("path").alias("more"), F.col("end").alias("then"))
        grown = paths.join(onward, "end", "left").select(
            "url", F.when(F.col("then").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"),
            F.coalesce("then", "end").alias("end"), F.col("then").isNotNull().alias("grew"),
        )
        grown = cut_lineage(grown)
        paths = grown.drop("grew")
        if grown.where("grew").isEmpty():
            break
        hops *= 2
    return paths


def resolve_redirects(fetches: DataFrame, max_requests: int = MAX_REQUESTS_PER_CHAIN, targets: DataFrame | None = None) -> DataFrame:
    """H1: follow 3xx Location hops.

    - at most ``max_requests`` requests per chain: a chain whose last allowed request is still a redirect gives no
      result (so at most ``max_requests - 1`` redirects resolve);
    - a 3xx without Location gives no result;
    - a URL requested twice in one chain, a failed fetch (status 0) or a target that was never fetched gives an error
      row with status 0 and the URL reached so far as final URL;
    - otherwise the status is the first hop's when redirected, and the catch-all flag is tested on the final URL.

    Returns ``(page_id, request_url, final_url, redirect_chain ARRAY<STRUCT<url,status_code,type>>, status_code, error,
    is_catch_all)``. ``targets``: the fetch log that hops are looked up in, ``fetches`` itself if not given. Paths of
    URLs come from :func:`redirect_paths`; each request then takes one join for its path and one for the page at its end.
    """
    log = fetches if targets is None else targets
    # A URL that was fetched more than once counts as its first fetch.
    seen = log.groupBy("url").agg(F.min(F.struct("page_id", F.col("status_code").cast("int").alias("st"), F.col("location").alias("loc"))).alias("f"))
    nodes = cut_lineage(seen.select("url", "f.st", "f.loc"))
    paths = redirect_paths(nodes, max_requests).toDF("loc", "path", "then")
    st, loc = F.col("st"), F.col("loc")
    own = fetches.select("page_id", F.col("url").alias("request_url"), F.col("status_code").cast("int").alias("st"), F.col("location").alias("loc"))
    redirected = _is_redirect(st)
    # what the request itself answers, with its hops so far and the URL they lead to
    direct = own.where(~redirected).select(
        "page_id", "request_url", F.array().cast(f"array<{HOP}>").alias("hops"), F.col("request_url").alias("end"), "st", F.lit(True).alias("found")
    )
    hop = F.struct(F.col("request_url").alias("url"), st.alias("status_code"), F.lit("http").alias("type"))
    none = F.array().cast(f"array<{HOP}>")
    led = own.where(redirected & loc.isNotNull()).join(paths, "loc", "left").select(
        "page_id", "request_url", F.concat(F.array(hop), F.coalesce("path", none)).alias("hops"), F.coalesce("then", "loc").alias("end")
    )
    ends = nodes.select(F.col("url").alias("end"), "st", F.lit(True).alias("found"))
    led = led.join(ends, "end", "left").select("page_id", "request_url", "hops", "end", "st", F.coalesce("found", F.lit(False)).alias("found"))
    r = direct.unionByName(led).withColumn("urls", F.concat(F.transform("hops", lambda h: h["url"]), F.array("end")))
    again = F.filter(F.transform("urls", lambda u, i: F.when(F.array_position(F.col("urls"), u) <= i, i)), lambda i: i.isNotNull())
    r = r.withColumn("at", F.get(again, F.lit(0)))  # the place of the first URL that was requested before
    r = r.withColumn("revisit", F.coalesce(F.col("at") < max_requests, F.lit(False)))
    failed = ~F.col("found") | F.coalesce(st == 0, F.lit(False))
    ended = (F.size("hops") < max_requests) & (failed | ~_is_redirect(st))
    chain = F.when(F.col("revisit"), F.slice("hops", F.lit(1), F.coalesce("at", F.lit(0)))).otherwise(F.col("hops"))
    r = r.where(F.col("revisit") | ended).select(
        "page_id", "request_url", F.when(F.col("revisit"), F.get("urls", F.col("at"))).otherwise(F.col("end")).alias("final_url"),
        chain.alias("redirect_chain"), "st",
        F.when(F.col("revisit"), "URL already visited").when(~F.col("found"), "not fetched").when(st == 0, "request failed").alias("error"),
    )
    first, error = F.get("redirect_chain", F.lit(0))["status_code"], F.col("error").isNotNull()
    return r.select(
        "page_id", "request_url", "final_url", "redirect_chain", F.when(error, 0).otherwise(F.coalesce(first, st)).cast("int").alias("status_code"),
        "error", (~error & (F.size("redirect_chain") > 0) & is_catch_all(F.col("final_url"))).alias("is_catch_all"),
    )


def first_hop(fetches: DataFrame) -> DataFrame:
    """H2: redirects are not followed; a 3xx with Location gives a one-hop chain, the final URL is the request URL,
    the status is the hop's, and the catch-all flag is tested on the Location."""
    st, loc = F.col("status_code").cast("int"), F.col("location")
    hop = F.struct(F.col("url").alias("url"), st.alias("status_code"), F.lit("http").alias("type"))
    redirect = _is_redirect(st)
    base = fetches.where(~redirect | loc.isNotNull())
    return base.select(
        "page_id", F.col("url").alias("request_url"), F.col("url").alias("final_url"),
        F.when(redirect, F.array(hop)).otherwise(F.array().cast(f"array<{HOP}>")).alias("redirect_chain"),
        st.alias("status_code"),
        F.when(st == 0, F.lit("request failed")).alias("error"),
        F.when(redirect, is_catch_all(loc)).otherwise(F.lit(False)).alias("is_catch_all"),
    )


def flag_catch_all(results: DataFrame, final: str = "final_url") -> DataFrame:
    """H3: recompute the flag on ``final`` (only results that were redirected can be catch-all)."""
    return results.withColumn("is_catch_all", (F.size("redirect_chain") > 0) & is_catch_all(F.col(final)))


def crawl_results(fetches: DataFrame, bodies: DataFrame, cut: int = BODY_SIMILARITY_CUT, max_requests: int = MAX_REQUESTS_PER_CHAIN) -> DataFrame:
    """N1, H1 (with H3 on the final URL) and H4 in the crawler's order: a fetch whose body is similar to an earlier body of its host gives no
    result; of the others redirects are followed and results assembled. Targets of redirects are looked up among all
    fetches. ``bodies``: (page_id, url, html); fetches without a body there are kept."""
    dropped = similar_bodies(bodies, cut=cut).select("page_id")
    kept = cut_lineage(fetches.join(dropped, "page_id", "left_anti"))
    return assemble_results(resolve_redirects(kept, max_requests, targets=fetches))


def assemble_results(results: DataFrame) -> DataFrame:
    """H4: flat result rows as reported: request, final URL, hop count, '|'-joined chain, status, error, flag."""
    return results.select(
        "page_id", "request_url", "final_url", F.size("redirect_chain").cast("bigint").alias("n_redirects"),
        F.array_join(F.transform("redirect_chain", lambda h: h["url"]), "|").alias("chain_urls"),
        F.col("status_code").cast("bigint").alias("status_code"), "error", "is_catch_all",
    )
