"""G1: verdicts of random rules on random hosts, and the size of the gram index."""

import random

from pyspark.sql import functions as F

from webmine.operators import scope as G


def brute(host, rules):
    def hit(pattern):
        p = pattern.strip().lower().removeprefix("*.").split(":")[0]
        return p != "" and ((host == p or host.endswith("." + p)) if "." in p else p in host)

    included = [p for a, p in rules if a == "include"]
    return (not included or any(map(hit, included))) and not any(hit(p) for a, p in rules if a == "exclude")


def test_verdicts_equal_brute_force(spark):
    rnd = random.Random(4)
    label = lambda n: "".join(rnd.choice("abc-1é") for _ in range(rnd.randint(1, n)))
    hosts = sorted({".".join(label(6) for _ in range(rnd.randint(1, 4))) for _ in range(500)} | {"a", "ab", "localhost"})
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    for n in (1, 6, 40):
        words = [rnd.choice((label(1), label(2), label(3), label(7), rnd.choice(hosts)[:5], "*." + label(2) + "." + label(2), "x" * 300)) for _ in range(n)]
        rules = [(rnd.choice(("include", "exclude")), w) for w in words]
        got = {r.host for r in G.filter_scope(df, spark.createDataFrame(rules, "action string, pattern string")).collect()}
        assert got == {h for h in hosts if brute(h, rules)}, rules


def test_rows_of_a_host_are_its_length(spark):
    host = "abcdefghij" * 25
    n = spark.createDataFrame([(host + ".test",)], "host string").select(F.explode(G._grams(F.col("host"), range(1, G.GRAM + 1)))).count()
    assert n <= G.GRAM * 255
    hosts = spark.createDataFrame([(f"h{i}.example.test",) for i in range(200)], "host string")
    words = spark.createDataFrame([("include", "example7"), ("exclude", "h17"), ("exclude", "")], "action string, pattern string")
    assert sorted(map(tuple, G.bare_matches(hosts, words.where("pattern <> ''")).collect())) == [("h17.example.test", "exclude"), *[(f"h17{i}.example.test", "exclude") for i in range(10)]]
