"""F5 against a brute-force breadth-first crawl on sf0.001, and what its rounds write.

Edges, canonical keys and per-URL properties come from the DuckDB SQL of ``oracles.py`` (independent of the Spark
code); the loop itself is plain Python over those small tables.
"""

import itertools
import os

import duckdb
from pyspark.sql import functions as F

from tests.conftest import SF0001
from webmine.plans import oracles as O

LINKED = """SELECT p.page_id, p.url, concat(p.html, CASE WHEN a.url IS NULL THEN '' ELSE concat('<a href="', a.url, '"></a>') END,
 CASE WHEN b.url IS NULL THEN '' ELSE concat('<a href="', b.url, '"></a>') END) AS html
FROM pages p LEFT JOIN pages a ON a.page_id = 2 * p.page_id + 1 LEFT JOIN pages b ON b.page_id = 2 * p.page_id + 2"""


def brute_force(con, max_rounds=None):
    ctes = [("linked", LINKED)] + O.edges_ctes("linked")
    w = "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in ctes)
    edges = con.sql(w + f"\nSELECT src_page_id, pos, {O.clean_url('dst_url')} AS url FROM edges").fetchall()
    store = con.sql(
        "WITH linked AS (" + LINKED + ") " + O.canon(f"(SELECT page_id, {O.clean_url('url')} AS q FROM linked)", "q", "key", "page_id")
    ).fetchall()
    seed_url = con.sql(f"SELECT {O.clean_url('url')} FROM pages WHERE page_id = 0").fetchall()[0][0]
    urls = sorted({u for _, _, u in edges} | {seed_url})
    roots = con.sql("SELECT u, " + f"{O.scheme('u')} || '://' || {O.hostport('u')} || '/robots.txt' FROM (SELECT unnest(?) AS u) "
                    f"WHERE {O.upath('u')} IN ('', '/')", params=[urls]).fetchall()
    robots = dict(roots)
    urls = sorted(set(urls) | set(robots.values()))
    con.execute("CREATE OR REPLACE TEMP TABLE cu AS SELECT unnest(?) AS url", [urls])
    props_sql = (
        "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in O.alias_ctes("(SELECT 0 AS seq, url FROM cu)")) +
        f"\nSELECT t.url, lower({O.hostname('t.url')}) AS host, {O.is_trapped(O.upath('t.url'))} AS trapped, t.base, "
        "t._q <> '' AND t.fv IS NOT NULL AS aliasable, c.key FROM t JOIN (" + O.canon("cu", "url", "key", "url") + ") c USING (url)"
    )
    props = {r[0]: r[1:] for r in con.sql(props_sql).fetchall()}
    seed_host = props[seed_url][0]

    def in_scope(h):
        return "example" in h or h == seed_host or h.endswith("." + seed_host)

    depth = {seed_url: 0}
    frontier = {seed_url}
    for d in itertools.count(1) if max_rounds is None else range(1, max_rounds + 1):
        keys = {props[u][4] for u in frontier}
        pages = {pid for pid, key in store if key in keys}
        cand = {}
        for src, pos, u in edges:
            if src in pages:
                cand[u] = min(cand.get(u, (src, pos)), (src, pos))
        for u in frontier & robots.keys():
            cand[robots[u]] = (-1, 0)
        cand = {u: s for u, s in cand.items() if u not in depth and props[u][0] != "" and not props[u][1] and in_scope(props[u][0])}
        vbases = {props[v][2] for v in depth}
        admitted = set()
        for u, s in cand.items():
            host, trapped, base, aliasable, key = props[u]
            if aliasable and (base in vbases or any(props[w][2] == base and cand[w] < s for w in cand)):
                continue
            admitted.add(u)
        if not admitted:
            break
        for u in admitted:
            depth[u] = d
        frontier = admitted
    by_key = {}
    for pid, key in store:
        by_key.setdefault(key, []).append(pid)
    return sorted((u, d, pid) for u, d in depth.items() for pid in by_key.get(props[u][4], [None]))


def test_crawl_loop_matches_brute_force(spark):
    from __spark_entry__ import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{os.path.join(SF0001, 'pages.parquet')}')")
    want = brute_force(con)
    got = sorted(
        (r["url"], r["depth"], r["page_id"]) for r in queries()["frontier_rounds"](spark, SF0001).select("url", "depth", F.col("page_id")).collect()
    )
    assert len(want) > 1
    assert got == want


def test_each_round_writes_what_it_admits(spark, monkeypatch):
    from webmine.operators import frontier as FR

    roots = []
    made = FR.scratch_path
    monkeypatch.setattr(FR, "scratch_path", lambda s, name: roots.append(made(s, name)) or roots[-1])
    # A chain of pages; every page also links back to all earlier ones, with a query that makes it redundant, and out of scope.
    n = 6
    rows = [(i, f"http://c.test/p{i}.html", "".join(f'<a href="/p{j}.html?again={i}"></a>' for j in range(i)) +
             f'<a href="/p{i + 1}.html"></a><a href="http://other.example/x.html"></a>') for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    seeds = spark.createDataFrame([("http://c.test/p0.html",)], "seed string")
    rules = spark.createDataFrame([("exclude", "nothing.test")], "action string, pattern string")
    got = sorted((r.depth, r.url, r.page_id) for r in FR.expand_frontier(seeds, pages, rules).collect())
    assert got == [(i, f"http://c.test/p{i}.html", i if i < n else None) for i in range(n + 1)]
    parts = {d: spark.read.schema(FR._STATE).parquet(f"{roots[0]}/{d}").count() for d in os.listdir(roots[0])}
    assert parts == {f"depth={i}": 1 for i in range(n + 1)} | {f"depth={n + 1}": 0}
    assert sorted(r.depth for r in FR.expand_frontier(seeds, pages, rules, max_rounds=2).collect()) == [0, 1, 2]
