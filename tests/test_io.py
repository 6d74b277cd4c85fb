import os
import tempfile


from webmine.operators import fetches as H
from webmine.operators import params as P
from webmine.sources import io as IO


def _tmp():
    return tempfile.mkdtemp(prefix="webmine-io-", dir="/tmp")


def test_result_lines_sink_appends(spark):
    f = spark.createDataFrame([(1, "http://x.test/a", 200, None), (2, "http://x.test/b", 404, None)],
                              "page_id bigint, url string, status_code int, location string")
    res = H.resolve_redirects(f)
    out = os.path.join(_tmp(), "results")
    IO.write_results(res, out)
    IO.write_results(res, out)  # append, not overwrite
    lines = sorted(r["value"] for r in spark.read.text(out).collect())
    assert lines == ["200 http://x.test/a", "200 http://x.test/a", "404 http://x.test/b", "404 http://x.test/b"]


def test_result_file_holds_first_results_of_kept_urls(spark):
    rows = [(2, "http://x.test/a.js", 404, False), (1, "http://x.test/a.js", 200, False), (3, "http://x.test/b.png", 200, False),
            (4, "http://x.test/c.js?v=1", 200, False), (5, "http://x.test/d.html", 500, True)]
    res = spark.createDataFrame(rows, "page_id bigint, request_url string, status_code int, is_catch_all boolean")
    out = _tmp()
    IO.write_results(res, os.path.join(out, "f"), hide_media_urls=True, exts=["js", "html", "png"])
    assert sorted(r["value"] for r in spark.read.text(os.path.join(out, "f")).collect()) == ["200 http://x.test/a.js", "500 http://x.test/d.html"]
    IO.write_results(res, os.path.join(out, "p"), fmt="parquet", hide_media_urls=True)
    assert sorted(r["page_id"] for r in spark.read.parquet(os.path.join(out, "p")).collect()) == [1, 4, 5]
    with open(os.path.join(out, "targets.txt"), "w") as f:
        f.write("a.test\nb.test, c.test\n")
    assert sorted(r["seed"] for r in IO.load_seeds(spark, path=os.path.join(out, "targets.txt")).collect()) == ["a.test", "b.test", "c.test"]


def test_params_json_sink(spark):
    pages = spark.createDataFrame([(1, "https://p.test/s?q=1", '<input name="who">')], "page_id bigint, url string, html string")
    out = os.path.join(_tmp(), "params")
    IO.write_params_json(P.mine_params(pages), out)
    got = {(r["name"], r["type"], r["certainty"]) for r in spark.read.json(out).collect()}
    assert got == {("q", "query", "high"), ("who", "form", "high")}


def test_pages_json_source_and_seed_lists(spark):
    d = _tmp()
    spark.createDataFrame([(7, "https://j.test/", "<a href='/x/y'>")], "page_id bigint, url string, html string") \
        .write.mode("overwrite").json(os.path.join(d, "pages"))
    p = IO.load_pages(spark, os.path.join(d, "pages"), fmt="json")
    assert p.columns == ["page_id", "url", "html"] and p.first()["page_id"] == 7
    seeds = IO.load_seeds(spark, targets="a.test, b.test,c.test")
    assert sorted(r["seed"] for r in seeds.collect()) == ["a.test", "b.test", "c.test"]
    prep = {r["seed"]: r["url"] for r in IO.prepare_seeds(spark.createDataFrame(
        [("e.test",), ("https://e.test:443/deep/path",), ("http://e.test:8080/p",)], "seed string")).collect()}
    assert prep == {"e.test": "https://e.test", "https://e.test:443/deep/path": "https://e.test",
                    "http://e.test:8080/p": "http://e.test:8080/p"}
    words = IO.load_wordlist(spark.createDataFrame([("package.json",), ("/api",), (".env",), (" admin ",), ("",), ("# note",)], "value string"))
    assert [r["path"] for r in words.collect()] == ["package.json", "/api", ".env", "admin"]
