import itertools
import random
from urllib.parse import parse_qsl

from pyspark.sql import functions as F

from webmine.operators import frontier as FR
from webmine.operators import urls as UO


def test_alias_global_empty_values(spark):
    rows = [(1, "http://a.test/?e=1"), (2, "http://b.test/?e=2"), (3, "http://c.test/?e"), (4, "http://d.test/?e&f"),
            (5, "http://e.test/?f=1"), (6, "http://f.test/?f"), (7, "http://g.test/?f=1&z=9"), (8, "http://g.test/?e=1")]
    df = spark.createDataFrame(rows, "seq bigint, url string")
    kept = sorted(r["seq"] for r in UO.collapse_query_aliases(df, "global").collect())
    # 4: seq 3 has e empty and no f; 6: seq 1 has no f; 8: seq 1 carries e=1; 7 has z=9 nobody else has
    assert kept == [1, 2, 3, 5, 7]


def test_alias_path_unparsable_earlier(spark):
    rows = [(1, "http://a.test/a?x;y"), (2, "http://a.test/a?p=1"), (3, "http://a.test/a?q=1"), (4, "http://a.test/a?z;w")]
    df = spark.createDataFrame(rows, "seq bigint, url string")
    assert sorted(r["seq"] for r in UO.collapse_query_aliases(df, "path").collect()) == [1, 2, 4]


def test_pagination_of_one_page(spark):
    links = "".join(f'<a href="/list?page={i}"></a>' for i in range(1, 31))
    rows = [(1, "http://p.test/start.html", links), (2, "http://p.test/robots.txt", "Disallow: /hidden\nAllow: /list?page=0")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(r["url"] for r in FR.next_frontier(pages).collect())
    assert got == ["http://p.test/hidden/", "http://p.test/list?page=1%2F"]  # the link rules end a path with a slash


def test_robots_of_root_page(spark):
    pages = spark.createDataFrame([(1, "http://p.test/", "")], "page_id bigint, url string, html string")
    assert [tuple(r) for r in FR.next_frontier(pages).collect()] == [("http://p.test/robots.txt", "p.test", 1, 0)]


def test_alias_path(spark):
    rows = [(1, "http://a.test/p?x=1"), (2, "http://a.test/p"), (3, "http://a.test/p?y=2"), (4, "http://a.test/q")]
    df = spark.createDataFrame(rows, "seq bigint, url string")
    kept = sorted(r["seq"] for r in UO.collapse_query_aliases(df, "path").collect())
    assert kept == [1, 2, 4]


def brute_global(rows):
    """Sequence numbers that stay: no earlier URL with the same base, and none whose query carries every pair."""
    parsed = []
    for seq, url in rows:
        base, _, query = url.partition("?")
        first = {}
        for k, v in parse_qsl(query, keep_blank_values=True):
            first.setdefault(k, v)
        parsed.append((seq, base, query, first))
    kept = []
    for seq, base, query, own in parsed:
        earlier = [p for p in parsed if p[0] < seq]
        covered = any(p[2] and all(p[3].get(k, "") == v for k, v in own.items()) for p in earlier)
        if not (query and (covered or any(p[1] == base for p in earlier))):
            kept.append(seq)
    return kept


def test_alias_global_equals_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for seq in range(700):
        names = rnd.sample("abcdef", rnd.randint(0, 4))
        query = "&".join(f"{k}={rnd.choice(['', '1', '2', '3'])}" for k in names)
        rows.append((seq, f"http://h{rnd.randint(0, 400)}.test/p{rnd.randint(0, 3)}" + (f"?{query}" if query else "")))
    rows += [(700 + i, f"http://x.test/{i}?utm=feed&id={i % 60}&e={'' if i % 2 else 'x'}") for i in range(120)]
    df = spark.createDataFrame(rows, "seq bigint, url string")
    got = sorted(r["seq"] for r in UO.collapse_query_aliases(df, "global").collect())
    assert got == brute_global(rows)


def maps_and_keys(df):
    keys = df.select(F.col("m").alias("_s"), F.array().cast("array<string>").alias("_e"), F.col("seq").alias("_kmin"))
    return keys, df.select(F.col("m").alias("_m"), F.col("seq").alias("_tmin"), F.transform("m", lambda p: F.substring_index(p, UO.SEP, 1)).alias("_nv"))


def test_facets_meet_few_supersets(spark):
    facets = [[f"{n}{UO.SEP}{v}" for n, v in zip("abc", c, strict=True)] for c in itertools.product(range(13), repeat=3)]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(facets)], "seq bigint, m array<string>")
    keys, maps = maps_and_keys(df)
    wanted = keys.select(F.col("_s")[0].alias("lo"), F.col("_s")[1].alias("hi"))
    met = keys.select(F.col("_s")[0].alias("lo"), F.col("_s")[1].alias("hi"), "_kmin").join(UO._maps_by_two_pairs(maps, wanted), ["lo", "hi"])
    assert met.where("_tmin < _kmin").count() == 2197 * 6  # 371,293 on one pair
    assert UO.superset_candidates(keys, maps).count() == 0


def test_a_popular_pair_multiplies_no_rows(spark):
    # 3,000 maps hold the popular pair, 500 keys ask for it alone with some empty name.
    rows = [(i, [f"id{UO.SEP}{i}", f"utm{UO.SEP}feed"]) for i in range(3000)]
    maps = maps_and_keys(spark.createDataFrame(rows, "seq bigint, m array<string>"))[1]
    keys = spark.createDataFrame([([f"utm{UO.SEP}feed"], [f"e{i}"], 10_000) for i in range(500)], "_s array<string>, _e array<string>, _kmin bigint")
    assert UO.superset_candidates(keys, maps).count() == 500
    assert {r["_best"] for r in UO.earlier_supersets(keys, maps).collect()} == {0}
