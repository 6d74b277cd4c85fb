import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from webmine.operators import links as L
from webmine.operators import params as P
from webmine.plans.queries import REGISTRY
from webmine.streaming import jobs as S

PAGES = "page_id bigint, url string, html string"


class Files:
    """A folder that files are dropped into, read as a stream of one file per micro-batch."""

    def __init__(self, spark, fmt="parquet"):
        self.spark, self.fmt, self.n = spark, fmt, 0
        self.folder, self.out = tempfile.mkdtemp(prefix="webmine-in-", dir="/tmp"), tempfile.mkdtemp(prefix="webmine-out-", dir="/tmp")

    def drop(self, rows, schema):
        self.n += 1
        path = os.path.join(tempfile.mkdtemp(prefix="webmine-part-", dir="/tmp"), "p")
        writer = self.spark.createDataFrame(rows, schema).coalesce(1).write
        getattr(writer, self.fmt)(path)
        part = next(f for f in os.listdir(path) if f.startswith("part-"))
        os.link(os.path.join(path, part), os.path.join(self.folder, f"{self.n:03}-{part}"))

    def batches(self):
        return len([f for f in os.listdir(self.out + "/checkpoint/commits") if f.isdigit()])


def page(i):
    links = f'<a href="/p{i % 4}"></a><a href="/q{i}"></a><a href="/p{i % 4}/"></a>'
    return i, f"http://s{i % 3}.test/x.html?q{i % 5}=1&a={i}", f'{links}<input name="n{i % 6}"><textarea name="t{i % 2}"></textarea>'


def test_param_counts_over_three_batches_and_a_restart(spark):
    src, pages = Files(spark), [page(i) for i in range(40)]
    for lo in (0, 10, 20):
        src.drop(pages[lo : lo + 10], PAGES)

    def run():
        stream = S.stream_table(spark, src.folder, max_files_per_trigger=1)
        return {(r.certainty, r.name): r.n for r in S.run_counts(S.stream_param_counts(stream), "t", src.out).collect()}

    def batch(n):
        bag = P.mine_params(spark.createDataFrame(pages[:n], PAGES))
        return {(r.certainty, r.name): r.n for r in S.param_counts(bag).collect()}

    assert run() == batch(30) and src.batches() >= 3
    src.drop(pages[30:], PAGES)
    assert run() == batch(40) and src.batches() >= 4
    assert run() == batch(40)


def test_dedupe_over_three_batches_and_a_restart(spark):
    src = Files(spark)
    urls = [[f"http://S.test/a{i % 7}/" for i in range(20)], [f"http://s.test/a{i}" for i in range(10)], ["http://s.test/a9", "http://s.test/b"]]
    for part in urls:
        src.drop([(u,) for u in part], "url string")
    run = lambda: sorted(r.canonical_url for r in S.run_available(
        S.stream_dedupe_urls(S.stream_table(spark, src.folder, max_files_per_trigger=1)), "t", out=src.out).collect())
    want = sorted([f"http://s.test/a{i}" for i in range(10)] + ["http://s.test/b"])
    assert run() == want and src.batches() >= 3
    src.drop([("http://s.test/b/",), ("http://s.test/c",)], "url string")
    assert run() == sorted([*want, "http://s.test/c"])
    names = {f for _, _, files in os.walk(src.out + "/checkpoint/state") for f in files}
    assert any(f.endswith((".changelog", ".zip")) for f in names)  # RocksDB's, with changelogs
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != S.STATE_STORE["spark.sql.streaming.stateStore.providerClass"]


def test_seed_lines_over_three_batches_and_a_restart(spark):
    src = Files(spark, "text")
    for part in (["a.test", "b.test", "a.test"], ["b.test", "c.test"], ["a.test"]):
        src.drop([(line,) for line in part], "value string")
    run = lambda: sorted(r.seed for r in S.run_available(S.stream_seeds(spark, src.folder, max_files_per_trigger=1), "t", out=src.out).collect())
    assert run() == ["a.test", "b.test", "c.test"] and src.batches() >= 3
    src.drop([("c.test",), ("d.test",)], "value string")
    assert run() == ["a.test", "b.test", "c.test", "d.test"]


@pytest.mark.parametrize("kind", ["links", "params"])
def test_stateless_streams_equal_the_batch(spark, kind):
    src, pages = Files(spark), [page(i) for i in range(30)]
    for lo in (0, 10, 20):
        src.drop(pages[lo : lo + 10], PAGES)
    stream, table = S.stream_table(spark, src.folder, max_files_per_trigger=1), spark.createDataFrame(pages, PAGES)
    if kind == "links":
        cols = ["src_page_id", "src_url", "dst_url"]
        got, want = S.run_available(S.stream_links(stream), "t", out=src.out).select(*cols).distinct(), L.build_link_edges(table).select(*cols)
    else:
        cols = ["page_id", "name", "type", "source", "certainty", "url"]
        got, want = S.run_available(S.stream_params(stream), "t", out=src.out), P.mine_params(table).select(*cols)
    assert src.batches() >= 3 and sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.collect()))


def test_report_over_three_batches(spark):
    src = Files(spark)
    rows = [(i, f"http://s.test/{i % 12}" + (".png" if i % 12 == 5 else ""), 200, None) for i in range(30)]
    schema = "page_id bigint, url string, status_code int, location string"
    for lo in (0, 10, 20):
        src.drop(rows[lo : lo + 10], schema)
    out = S.run_available(S.stream_report(S.stream_table(spark, src.folder, max_files_per_trigger=1)), "t", out=src.out)
    assert src.batches() >= 3 and sorted(r.request_url for r in out.collect()) == sorted(f"http://s.test/{i}" for i in range(12) if i != 5)
    assert out.where(~F.col("line").startswith("200 ")).count() == 0


def test_stream_dedupe_within_watermark(spark):
    d = tempfile.mkdtemp(prefix="webmine-stream-", dir="/tmp")
    t0 = dt.datetime(2026, 1, 1, 0, 0, 0)
    rows = [("HTTP://S.TEST/a/", t0), ("http://s.test/a", t0 + dt.timedelta(minutes=5)),
            ("http://s.test/b?y=1&x=2", t0), ("http://s.test/b?x=2&y=1", t0 + dt.timedelta(minutes=1))]
    spark.createDataFrame(rows, "url string, ts timestamp").write.parquet(os.path.join(d, "in"))
    src = spark.readStream.schema("url string, ts timestamp").parquet(os.path.join(d, "in"))
    out = S.run_available(S.stream_dedupe_urls(src, "url", event_time="ts", delay="1 hour"), "wm-test")
    assert sorted(r["canonical_url"] for r in out.collect()) == ["http://s.test/a", "http://s.test/b?x=2&y=1"]


@pytest.mark.parametrize("name", ["stream_dedupe", "stream_links", "stream_params", "stream_report", "stream_param_counts"])
def test_a_table_of_several_files_gives_what_one_file_gives(spark, name):
    table = spark.createDataFrame([page(i) for i in range(24)], PAGES)
    one, many = Files(spark), tempfile.mkdtemp(prefix="webmine-in-", dir="/tmp")
    one.drop(table.collect(), PAGES)
    os.link(os.path.join(one.folder, os.listdir(one.folder)[0]), os.path.join(one.out, "pages.parquet"))
    table.repartition(3).write.parquet(os.path.join(many, "pages.parquet"))
    assert os.path.isfile(os.path.join(one.out, "pages.parquet")) and len(os.listdir(os.path.join(many, "pages.parquet"))) > 3
    rows = [sorted(map(str, REGISTRY[name](spark, sf).collect())) for sf in (one.out, many)]
    assert rows[0] == rows[1] and rows[0]
