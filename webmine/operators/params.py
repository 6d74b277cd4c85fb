"""Parameter mining.

One narrow projection per page builds an array of candidate claims ``struct(rank, pos, name, type, source, certainty)``
from the 14 extractors in their fixed order; within a page the first extractor (then the first position) to claim a
name wins. That is per-row array work: no shuffle until the corpus-wide aggregates (P18, P21).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import urls as U

HIGH, MEDIUM = P.CERTAINTY_HIGH, P.CERTAINTY_MEDIUM

# (rank, type, source, certainty, kind, pattern, its Java form); kind: page_query | names | url_keys | object_keys | hidden
EXTRACTORS = [
    (1, "query", "url", HIGH, "page_query", None, None),
    (2, "form", "input", HIGH, "names", P.PARAM_FORM_INPUT, P.PARAM_FORM_INPUT_JAVA),
    (3, "form", "textarea", HIGH, "names", P.PARAM_FORM_TEXTAREA, P.PARAM_FORM_TEXTAREA_JAVA),
    (4, "form", "select", HIGH, "names", P.PARAM_FORM_SELECT, P.PARAM_FORM_SELECT_JAVA),
    (5, "fetch", "api", MEDIUM, "url_keys", P.PARAM_JS_FETCH, P.PARAM_JS_FETCH),
    (6, "xhr", "api", MEDIUM, "url_keys", P.PARAM_JS_XHR, P.PARAM_JS_XHR),
    (7, "post", "data", MEDIUM, "object_keys", P.PARAM_JS_POST_DATA, P.PARAM_JS_POST_DATA_JAVA),
    (8, "ajax", "data", MEDIUM, "object_keys", P.PARAM_JS_AJAX_DATA, P.PARAM_JS_AJAX_DATA_JAVA),
    (9, "fetch", "body", MEDIUM, "object_keys", P.PARAM_FETCH_BODY, P.PARAM_FETCH_BODY_JAVA),
    (10, "graphql", "variable", MEDIUM, "names", P.PARAM_GRAPHQL_VAR, P.PARAM_GRAPHQL_VAR),
    (11, "websocket", "url", MEDIUM, "url_keys", P.PARAM_WEBSOCKET_URL, P.PARAM_WEBSOCKET_URL),
    (12, "data", "attribute", MEDIUM, "names", P.PARAM_DATA_ATTR, P.PARAM_DATA_ATTR_JAVA),
    (13, "hidden", "input", MEDIUM, "hidden", P.PARAM_HIDDEN_INPUT, None),
    (14, "meta", "tag", MEDIUM, "meta", P.PARAM_META_CONTENT, None),
]
EXTRACTOR_BY_KEY = {
    "params_query": 1, "params_input": 2, "params_textarea": 3, "params_select": 4, "params_fetch": 5,
    "params_xhr": 6, "params_post": 7, "params_ajax": 8, "params_fetch_body": 9, "params_graphql": 10,
    "params_websocket": 11, "params_data_attr": 12, "params_hidden": 13, "params_meta": 14,
}
LAST_RANK = EXTRACTORS[-1][0]
_M = 1_000_000  # pos = match index * _M + key index


def last_rank_of(value: str, field: int) -> int:
    """Rank of the last extractor whose ``field`` (1 type, 3 certainty) is ``value``."""
    return max(e[0] for e in EXTRACTORS if e[field] == value)


def valid_name(c: Column) -> Column:
    """P15."""
    return c.rlike(P.PARAM_NAME_VALID)


def common_name(c: Column) -> Column:
    """P16 (object-key extractors only): stoplist against the lower-cased name."""
    return F.lower(c).isin(P.COMMON_NON_PARAMS)


def query_keys(u: Column) -> Column:
    """Decoded query keys of a URL string in order of first appearance (pairs with ';' or a bad escape skipped)."""
    q = U.url_query(u)
    pairs = F.filter(F.split(q, "&"), lambda p: (p != "") & ~p.contains(";"))
    kv = F.transform(
        pairs,
        lambda p: F.struct(
            F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"),
            F.try_url_decode(F.when(p.contains("="), F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).otherwise(F.lit(""))).alias("v"),
        ),
    )
    return F.transform(F.filter(kv, lambda x: x["k"].isNotNull() & x["v"].isNotNull()), lambda x: x["k"])


def _claim(rank, typ, source, cert, pos, name):
    return F.struct(
        F.lit(rank).alias("rank"), pos.cast("bigint").alias("pos"), name.alias("name"), F.lit(typ).alias("type"),
        F.lit(source).alias("source"), F.lit(cert).alias("certainty"),
    )


def _matches(text: Column, java: str) -> Column:
    """Group 1 of every match of a Java form (an empty group is a stretch without a match)."""
    return F.filter(F.regexp_extract_all(text, F.lit(java), 1), lambda m: m != "")


def _bodies(text: Column, java: str) -> Column:
    """Object bodies without their braces (one that never closes is no match)."""
    closed = F.filter(_matches(text, java), lambda m: m.endswith("}"))
    return F.transform(closed, lambda m: F.substring(m, F.lit(2), F.length(m) - 2))


def _hidden_name(tag: Column) -> Column:
    """The name that the hidden-input pattern gives for one tag, '' for none.

    The pattern matches at the last place it can: at the last "type=hidden" if a name follows it, else at the last name
    before it. Only where "type=hidden" is itself the start of a name's value is the pattern run as it is.
    """
    before, after = F.regexp_extract(tag, P.HIDDEN_LAST_TYPE, 1), F.regexp_extract(tag, P.HIDDEN_LAST_TYPE, 2)
    name = F.regexp_extract(after, P.HIDDEN_NAME_AFTER, 1)
    whole = [F.regexp_extract(tag, P.PARAM_HIDDEN_INPUT, g) for g in (1, 2)]
    return (
        F.when(before == "", F.lit(""))
        .when(name != "", name)
        .when(before.rlike(P.HIDDEN_OPEN_NAME), F.when(whole[0] != "", whole[0]).otherwise(whole[1]))
        .otherwise(F.regexp_extract(before, P.HIDDEN_NAME_BEFORE, 1))
    )


def _meta_name(tag: Column) -> Column:
    """The name that the meta pattern gives for one tag, '' for none."""
    open_name = F.regexp_extract(tag, P.META_OPEN_NAME, 1)
    before = F.regexp_extract(tag, P.META_BEFORE_CONTENT, 1)
    return F.when(open_name != "", open_name).otherwise(F.regexp_extract(before, P.META_LAST_NAME, 1))


def extracted(kind: str, pattern: str, java: str | None, html: Column) -> Column:
    """What an extractor's pattern captures in ``html``, in order (names, URLs or object bodies)."""
    if kind == "hidden":
        tags = F.regexp_extract_all(html, F.lit(P.HIDDEN_TAG), 0)
        return F.filter(F.transform(tags, _hidden_name), lambda m: m != "")
    if kind == "meta":
        tags = F.regexp_extract_all(html, F.lit(P.META_TAG), 0)
        return F.filter(F.transform(tags, _meta_name), lambda m: m != "")
    return _bodies(html, java) if kind == "object_keys" else _matches(html, java)


def _extractor_claims(rank, typ, source, cert, kind, pattern, java, url: Column, html: Column) -> Column:
    if kind == "page_query":
        arr = F.transform(query_keys(url), lambda k, i: _claim(rank, typ, source, cert, i, k))
    elif kind in ("names", "hidden", "meta"):
        arr = F.transform(extracted(kind, pattern, java, html), lambda n, i: _claim(rank, typ, source, cert, i, n))
    elif kind == "url_keys":
        arr = F.flatten(
            F.transform(
                extracted(kind, pattern, java, html),
                lambda s, i: F.transform(query_keys(s), lambda k, j: _claim(rank, typ, source, cert, i * _M + j, k)),
            )
        )
    elif kind == "object_keys":
        arr = F.flatten(
            F.transform(
                extracted(kind, pattern, java, html),
                lambda b, i: F.transform(
                    F.filter(_matches(b, P.PARAM_OBJECT_KEY_JAVA), lambda k: ~common_name(k)),
                    lambda k, j: _claim(rank, typ, source, cert, i * _M + j, k),
                ),
            )
        )
    else:  # pragma: no cover
        raise ValueError(kind)
    return F.filter(arr, lambda x: valid_name(x["name"]))


def mine_params(pages: DataFrame, url: str = "url", html: str = "html", last_rank: int = LAST_RANK) -> DataFrame:
    """``params(page_id, name, type, source, certainty, url, rank, pos)``, one row per (page, name).

    Later extractors never take a name from earlier ones, so a caller that wants ranks up to ``last_rank`` runs only
    those; rank 1 reads no html.
    """
    u, h = F.col(url), F.col(html)
    claims = F.concat(*[_extractor_claims(*e, url=u, html=h) for e in EXTRACTORS if e[0] <= last_rank])
    d = pages.select("page_id", F.col(url).alias("url"), F.array_sort(
        F.transform(claims, lambda x: F.struct(x["name"].alias("name"), x["rank"].alias("rank"), x["pos"].alias("pos"), x.alias("c")))
    ).alias("_sorted"))
    first = F.filter(F.col("_sorted"), lambda x, i: (i == 0) | (x["name"] != F.col("_sorted")[i - 1]["name"]))
    d = d.select("page_id", "url", F.explode(first).alias("_x"))
    return d.select(
        "page_id", F.col("_x.c.name").alias("name"), F.col("_x.c.type").alias("type"),
        F.col("_x.c.source").alias("source"), F.col("_x.c.certainty").alias("certainty"), "url",
        F.col("_x.c.rank").alias("rank"), F.col("_x.c.pos").alias("pos"),
    )


def params_of_extractor(params: DataFrame, rank: int) -> DataFrame:
    return params.where(F.col("rank") == rank)


def params_of_type(params: DataFrame, t: str) -> DataFrame:
    """P19."""
    return params.where(F.col("type") == t)


def params_of_certainty(params: DataFrame, c: str) -> DataFrame:
    """P20."""
    return params.where(F.col("certainty") == c)


def unique_params(params: DataFrame) -> DataFrame:
    """Corpus-wide first occurrence per name, ordered by (page_id, rank, pos). Partial aggregation per name."""
    first = F.min_by(
        F.struct("type", "source", "certainty", "url", "page_id"), F.struct("page_id", "rank", "pos")
    )
    return params.groupBy("name").agg(first.alias("_f")).select(
        "name", "_f.type", "_f.source", "_f.certainty", "_f.url", "_f.page_id"
    )


def param_summary(unique: DataFrame) -> DataFrame:
    """``(certainty, rank, name)``, the distinct names of each certainty in order, ranked from 1 (empty groups have
    no rows). The crawler's line of a certainty is its names in the order of ranks, joined with ', '.

    Ranks come from a range-partitioned sort, so no task holds a certainty's names and no single-partition window runs.
    """
    from .urls import _global_rank

    names = unique.select("certainty", "name").distinct()
    ranked = _global_rank(names.withColumn("_k", F.concat("certainty", F.lit("\u0000"), "name")), "_k", "_r")
    first = ranked.groupBy("certainty").agg(F.min("_r").alias("_r0"))  # one row per certainty: at most three
    return ranked.join(F.broadcast(first), "certainty").select("certainty", (F.col("_r") - F.col("_r0") + 1).alias("rank"), "name")


def params_json(params: DataFrame) -> DataFrame:
    """IO6 rows: one JSON object per bag row with the crawler's field names."""
    return params.select(
        "page_id", "rank", "pos",
        F.to_json(F.struct("name", "type", "source", "certainty", "url")).alias("json"),
    )
