from webmine.operators import links as L
from webmine.operators import report as R


def results(spark):
    rows = [(1, "http://r.test/a.js", 200, False), (2, "http://r.test/b.js?v=1", 200, False),
            (3, "http://r.test/c.png", 404, False), (4, "http://r.test/d", 302, True), (5, "http://r.test/d", 500, False),
            (6, "http://r.test/e", 404, False)]
    return spark.createDataFrame(rows, "page_id bigint, request_url string, status_code int, is_catch_all boolean")


def test_extension_filter_whole_url(spark):
    got = {r["page_id"] for r in R.filter_extension(results(spark), ["js"]).collect()}
    assert got == {1}  # a query string defeats the extension filter


def test_media_and_first_result(spark):
    got = {r["request_url"]: r["page_id"] for r in R.distinct_requests(R.hide_media(results(spark))).collect()}
    assert "http://r.test/c.png" not in got and got["http://r.test/d"] == 4


def test_status_filter_ignored_when_hidden(spark):
    assert R.filter_status(results(spark), [200], hide_status=True).count() == 6
    assert {r["page_id"] for r in R.filter_status(results(spark), [200, 500]).collect()} == {1, 2, 5}


def test_labels_and_verbosity(spark):
    lines = {r["line"] for r in R.report(results(spark), verbosity=0).collect()}
    assert "302* http://r.test/d" in lines and "404 http://r.test/e" not in lines
    lines2 = {r["line"] for r in R.report(results(spark), verbosity=2).collect()}
    assert "404 http://r.test/e" in lines2
    hidden = {r["line"] for r in R.report(results(spark), hide_status=True).collect()}
    assert "http://r.test/e" in hidden


def test_rollup_totals(spark):
    rows = {(r["host"], r["status_class"]): r["n"] for r in R.status_rollup(results(spark)).collect()}
    assert rows[(None, None)] == 6 and rows[("r.test", None)] == 6 and rows[("r.test", "4xx")] == 2


def test_degree_exact_and_approx(spark):
    edges = spark.createDataFrame([(1, "http://a.test/", "http://b.test/x"), (2, "http://a.test/y", "http://b.test/x"),
                                   (2, "http://a.test/y", "http://b.test/z")], "src_page_id bigint, src_url string, dst_url string")
    exact = {r["dst_url"]: r["indegree"] for r in L.url_indegree(edges).collect()}
    approx = {r["dst_url"]: r["indegree"] for r in L.url_indegree(edges, approx=True).collect()}
    assert exact == approx == {"http://b.test/x": 2, "http://b.test/z": 1}
    out = {r["host"]: (r["n_edges"], r["n_targets"]) for r in L.host_outdegree(edges).collect()}
    assert out == {"a.test": (3, 2)}
