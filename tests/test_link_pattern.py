"""The Java form of the link pattern matches exactly what the original pattern matches, and stays fast on long runs."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from webmine.functions import urls as U
from webmine.functions.patterns import LINK_PATTERN, LINK_PATTERN_JAVA
from webmine.operators import links as L
from webmine.plans import fixtures as X

ALPHABET = list("\"'/.-_?#|<>,;()*%$^\\[]: ab1Z")
PIECES = ["http://", "//", "../", "./", "a.b", "x/y", ".js", "?q=1", "#t", "abc/", "a.bc", "\\/"]


def _random_strings(n, seed=7):
    """Quoted segments whose bodies mix path-like pieces with the characters the pattern treats specially."""
    rnd = random.Random(seed)
    body_chars = [c for c in ALPHABET if c not in "\"'"]
    out = []
    for _ in range(n):
        segs = []
        for _ in range(rnd.randint(1, 3)):
            body = "".join(rnd.choice(PIECES) if rnd.random() < 0.5 else rnd.choice(body_chars) for _ in range(rnd.randint(0, 6)))
            segs.append(rnd.choice("\"'") + body + rnd.choice(["\"", "'", "<", " ", ""]) + rnd.choice(["", " ", "x"]))
        out.append("".join(segs))
    return out


def _same(df, col):
    a = F.regexp_extract_all(F.col(col), F.lit(LINK_PATTERN), 0)
    b = F.regexp_extract_all(F.col(col), F.lit(LINK_PATTERN_JAVA), 0)
    return df.where(~(a == b)).count()


def test_same_matches_on_random_strings(spark):
    df = spark.createDataFrame([(s,) for s in _random_strings(40000)], "s string")
    matched = df.where(F.size(F.regexp_extract_all("s", F.lit(LINK_PATTERN), 0)) > 0).count()
    assert matched > 4000  # the comparison is not vacuous
    assert _same(df, "s") == 0


def test_same_matches_on_pages(spark):
    assert _same(X.pages_plus(spark, SF001), "html") == 0


LONG = 1_000_000
RUNS = {
    "dotted": "a.", "dashed": "a-", "slashed": "a/", "parents": "../", "words": "ab/", "names": "a_b.c", "absolute": "a.bc",
    "mixed": "a.b/", "queries": "a?", "one letter": "a", "slashes": "/", "backslashes": "\\/", "colons": "a:",
}


@pytest.mark.parametrize("name", RUNS)
@pytest.mark.parametrize("head", ["'", "'/", "'http://", "'a/b."])
def test_linear_on_long_runs(spark, name, head):
    run = RUNS[name] * (LONG // len(RUNS[name]))
    closed, open_ = head + run + "'", head + run
    rows = [(0, "https://m.test/", closed + ' "/ok/path" '), (1, "https://m.test/", closed[:-1] + "<' \"/ok/path\" "),
            (2, "https://m.test/", ' "/ok/path" ' + open_)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    t = time.time()
    got = L.extract_links(df).where(F.col("raw") == "/ok/path").count()
    assert got == 3 and time.time() - t < 12


@pytest.mark.parametrize("run", ["a.", "a-", "a", ".", "-.", "a-b."])
def test_domain_names_of_any_length(spark, run):
    text = run * (LONG // len(run))
    df = spark.createDataFrame([(0, text), (1, text + "com"), (2, text + "1")], "id int, s string")
    got = {r.id: r.d for r in df.select("id", U.is_domain_name(F.col("s")).alias("d")).collect()}
    assert got == {0: False, 1: run in ("a.", "-.", "a-b."), 2: False}


def test_long_dotted_run_through_edges(spark):
    html = "'" + "a." * 50_000 + "a' " + "'/" + "b" * 10 + "' '" + "x-y." * 20_000 + "org'"
    df = spark.createDataFrame([(1, "https://m.test/", html)], "page_id bigint, url string, html string")
    assert L.build_link_edges(df).where(F.col("dst_url").contains("bbbbbbbbbb")).count() == 1


def test_domain_name_equals_its_original_form(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aB9-..é ") for _ in range(rnd.randint(1, 9))) + rnd.choice(["", "com", ".Org", ".c", "\n"]) for _ in range(20000)]
    want = [re.fullmatch(r"(?:[a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}", w) is not None for w in words]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, s string")
    got = {r.id: r.d for r in df.select("id", U.is_domain_name(F.col("s")).alias("d")).collect()}
    assert sum(want) > 500 and all(got[i] == w for i, w in enumerate(want))
