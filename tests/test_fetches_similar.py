import random

import pytest

from webmine.operators import fetches as H
from webmine.operators import frontier as FR
from webmine.operators import similar as N


def test_redirect_chain_limits(spark):
    rows = [(i, f"http://r.test/{i}", 301, f"http://r.test/{i + 1}") for i in range(0, 12)]
    rows += [(12, "http://r.test/12", 200, None), (20, "http://r.test/20", 302, "http://r.test/21"),
             (21, "http://r.test/21", 302, "http://r.test/20"), (30, "http://r.test/30", 0, None),
             (31, "http://r.test/31", 301, None)]
    f = spark.createDataFrame(rows, "page_id bigint, url string, status_code int, location string")
    res = {r["page_id"]: r for r in H.assemble_results(H.resolve_redirects(f)).collect()}
    assert res[3]["n_redirects"] == 9 and res[3]["status_code"] == 301 and res[3]["final_url"] == "http://r.test/12"
    assert 2 not in res  # ten redirects: no result
    assert res[20]["status_code"] == 0 and res[20]["error"] == "URL already visited"
    assert res[30]["status_code"] == 0 and 31 not in res
    assert res[12]["n_redirects"] == 0 and res[12]["status_code"] == 200


def follow(fetches, limit):
    """Requests one by one, hop by hop."""
    first, out = {}, {}
    for i, url, st, loc in sorted(fetches):
        first.setdefault(url, (st, loc))
    for i, url, st, loc in fetches:
        chain, cur, found = [], url, True
        for _ in range(limit):
            if cur in chain:
                out[i] = (cur, chain, 0, "URL already visited")
            elif not found:
                out[i] = (cur, chain, 0, "not fetched")
            elif st == 0:
                out[i] = (cur, chain, 0, "request failed")
            elif not 300 <= st <= 399:
                out[i] = (cur, chain, None, None)
            elif loc is not None:
                chain, cur = [*chain, cur], loc
                found = cur in first
                st, loc = first.get(cur, (None, None))
                continue
            break
    return out


@pytest.mark.parametrize("limit", [10, 4, 1])
def test_redirects_equal_hop_by_hop(spark, limit):
    rnd = random.Random(limit)
    rows, n = [], 900
    for i in range(n):
        st = rnd.choice((301, 302, 301, 302, 307, 200, 404, 0)) if rnd.random() < 0.6 else 301
        near = f"http://r.test/{(i + 1) % n}" if rnd.random() < 0.7 else f"http://r.test/{rnd.randrange(n + 20)}"
        rows.append((i, f"http://r.test/{i if rnd.random() < 0.95 else rnd.randrange(n)}", st, near if 300 <= st < 400 and rnd.random() < 0.97 else None))
    rows += [(n, "http://r.test/self", 301, "http://r.test/self"), (n + 1, "http://r.test/x", 301, "http://r.test/self")]
    f = spark.createDataFrame(rows, "page_id bigint, url string, status_code int, location string")
    want = follow(rows, limit)
    got = {r.page_id: (r.final_url, [h.url for h in r.redirect_chain], r.status_code, r.error) for r in H.resolve_redirects(f, limit).collect()}
    status = {i: st for i, _, st, _ in rows}
    assert got == {i: (cur, chain, status[i] if s is None else s, e) for i, (cur, chain, s, e) in want.items()}
    assert {e for _, _, _, e in got.values()} >= ({None, "request failed"} if limit == 1 else {None, "request failed", "not fetched", "URL already visited"})


def test_ten_requests_take_four_rounds(spark, monkeypatch):
    rounds = []
    cut = H.cut_lineage
    monkeypatch.setattr(H, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    nodes = spark.createDataFrame([(f"u{i}", 301, f"u{i + 1}") for i in range(40)], "url string, st int, loc string")
    paths = {r.url: r for r in H.redirect_paths(nodes, 10).collect()}
    assert len(rounds) == 1 + 4 and len(paths["u0"].path) == 16 and paths["u0"].end == "u16"


def test_similar_bodies_give_no_results(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(1, "http://s.test/a", 200, None, base), (2, "http://s.test/b", 301, "http://s.test/a", base + " more"), (3, "http://s.test/c", 302, "http://s.test/b", "moved"),
            (4, "http://t.test/d", 200, None, base), (5, "http://t.test/e", 200, None, None)]
    f = spark.createDataFrame(rows, "page_id bigint, url string, status_code int, location string, html string")
    got = {r.page_id: (r.final_url, r.n_redirects, r.status_code) for r in H.crawl_results(f.drop("html"), f.select("page_id", "url", "html")).collect()}
    assert got == {1: ("http://s.test/a", 0, 200), 3: ("http://s.test/a", 2, 302), 4: ("http://t.test/d", 0, 200), 5: ("http://t.test/e", 0, 200)}


def test_discovery(spark):
    hosts = spark.createDataFrame([("d.test",)], "host string")
    words = spark.createDataFrame([("robots.txt",), ("/admin",), ("backup.zip",)], "path string")
    got = {r["url"] for r in FR.discover_paths(hosts, words).collect()}
    assert len(got) >= 6 and "https://d.test/admin" in got and "http://d.test/backup.zip" in got


def test_discovery_with_a_long_wordlist(spark, monkeypatch):
    hosts = spark.createDataFrame([(f"h{i}.test",) for i in range(7)] + [("h1.test",)], "host string")
    words = spark.createDataFrame([(f"/w{i}",) for i in range(150)] + [("w3",)], "path string")
    visited = spark.createDataFrame([("https://h0.test/w0",), ("http://h6.test/w149",)], "url string")
    want = {f"{s}://h{i}.test/w{j}" for s in ("http", "https") for i in range(7) for j in range(150)} - {"https://h0.test/w0", "http://h6.test/w149"}
    for size in (FR.WORDLIST_BYTES, 100):
        monkeypatch.setattr(FR, "WORDLIST_BYTES", size)
        got = [r["url"] for r in FR.discover_paths(hosts, words, visited).collect()]
        assert len(got) == len(want) and set(got) == want
    assert FR.discover_paths(hosts, words.limit(0)).count() == 0


def test_similar_bodies(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(1, "http://s.test/a", base), (2, "http://s.test/b", base + " one more"), (3, "http://s.test/c", base),
            (4, "http://s.test/d", " ".join(f"w{i}" for i in range(200))), (5, "http://t.test/a", base)]
    b = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["similar_to"] for r in N.similar_bodies(b).collect()}
    assert got == {2: 1, 3: 1}
