"""The Java forms of the parameter patterns capture what the original patterns capture, and stay fast on long input."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from webmine.functions import patterns as P
from webmine.operators import params as PM
from webmine.plans import fixtures as X

PIECES = {
    "names": ["<input", "<textarea", "<select", "<meta", "data-", "data-1", " name", "name", " type=", "=", " = ", '"', "'", " ", ">",
              "content=", "api", "x", "-", "hidden", "a1", "\n", "$v", ":", "Int!", "<input name=", '<meta name="n', '" content="api', "data-x="],
    "meta": ["<meta", "<meta ", " name", "name=", " name='n", '" ', "' ", '"', "'", "=", " ", ">", ">", "content=", "content", " content='api", "api", "x", "a1", "\n", '<meta name="n', '" content="api', 'name="k" ', 'content="/api" '],
    "hidden": ["<input", "type", "=", " = ", '"', "'", " ", "hidden", "type=hidden", " name=", "name", "x", ">", "q"],
    "object_keys": ["$.post", "$.ajax", "(", "{", "}", ",", " ", "data", "body", ":", " : ", "JSON.stringify(", "k", '"k"', "\n", "$.post(", '$.post("/u", {', "$.ajax({url", "data: {", "body:{"],
    "url_keys": ["fetch", "(", " ", '"', "'", "/u?a=1", "xhr.open", "xmlhttp.open", ",", '"GET"', "new WebSocket", "x", 'xhr.open("GET", "', 'fetch("', 'new WebSocket("'],
}


def original(kind, pattern, html):
    if kind != "hidden":
        return F.regexp_extract_all(html, F.lit(pattern), 1)
    g1, g2 = (F.regexp_extract_all(html, F.lit(pattern), g) for g in (1, 2))
    return F.transform(g1, lambda a, i: F.when(a != "", a).otherwise(g2[i]))


def texts(kind, n, seed):
    rnd = random.Random(seed)
    return [("".join(rnd.choice(PIECES[kind]) for _ in range(rnd.randint(2, 24))),) for _ in range(n)]


MINED = [e for e in PM.EXTRACTORS if e[5]]


@pytest.mark.parametrize("e", MINED, ids=lambda e: f"{e[0]}-{e[1]}-{e[2]}")
def test_same_captures(spark, e):
    rank, _, _, _, kind, pattern, java = e
    for df, need in ((spark.createDataFrame(texts(kind, 30000, rank), "html string"), 20), (X.pages_plus(spark, SF001), 0)):
        both = df.select("html", original(kind, pattern, F.col("html")).alias("a"), PM.extracted(kind, pattern, java, F.col("html")).alias("b"))
        bad = both.where(~(F.col("a") == F.col("b"))).limit(3).collect()
        assert not bad, bad
        assert both.where(F.size("a") > 0).count() >= need


META = ["name='a' ", "name='a", "content='x' ", "content='", "name='a' content='x' ", "<meta name='a' ", "name='a>b' ", "content='api' name='a' ", "name=''", "name = ", "<meta "]


@pytest.mark.parametrize("piece", META)
@pytest.mark.parametrize("tail", ["", ">", " content='api'>", "' content='api'>"])
def test_meta_tags_of_any_length_are_quick(spark, piece, tail):
    html = "<meta " + piece * (100_000 // len(piece)) + tail
    df = spark.createDataFrame([(html,)], "html string")
    names = PM.extracted("meta", P.PARAM_META_CONTENT, None, F.col("html"))
    df.select(F.size(names)).collect()
    t = time.time()
    df.select(F.size(names)).collect()
    assert time.time() - t < 1.5


def test_same_object_keys(spark):
    parts = ["a", "b_1", '"', "'", ":", " ", "1", "-", "{", ","]
    rnd = random.Random(3)
    rows = [("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 16))),) for _ in range(30000)]
    df = spark.createDataFrame(rows, "s string")
    got = PM._matches(F.col("s"), P.PARAM_OBJECT_KEY_JAVA)
    assert df.where(~(F.regexp_extract_all("s", F.lit(P.PARAM_OBJECT_KEY), 1) == got)).count() == 0


LONG = ["<input", "<input name", "<input name=a ", "<input type=hidden ", "type=hidden ", "<input name=type=hidden", "<meta ",
        "<meta name=", "$.ajax(", "$.post({", "{", "$.post(,{", "data:{", "body : ", "data-", "data-a", "a", "fetch(", "$a", "xhr.open('"]


@pytest.mark.parametrize("piece", LONG)
def test_fast_on_long_input(spark, piece):
    head = {"type=hidden ": "<input name=x ", "{": "$.post(", "a": "data:{"}.get(piece, "")
    tail = "}" if piece == "a" else ""
    html = head + piece * (100_000 // len(piece)) + tail
    df = spark.createDataFrame([(1, "http://x.test/?q=1", html)], "page_id bigint, url string, html string")
    t = time.time()
    assert PM.mine_params(df).where(F.col("rank") == 1).count() == 1
    assert time.time() - t < 20
