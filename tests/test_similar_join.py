"""N1's prefix-filter join: the rows of all pairs, and candidates of template pages that grow with their number only."""

import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webmine.operators import similar as N

SCHEMA = "page_id bigint, url string, html string"


def shingles(text):
    t = [w for w in re.split(r"[\t\n\f\r ]+", text.lower()) if w]
    return set(zip(t, t[1:], t[2:]))


def brute(rows, cut=97):
    """The smallest earlier body of the host that is equal or at least ``cut`` % similar."""
    sets, out = {i: shingles(t) for i, _, t in rows}, {}
    for i, url, text in rows:
        for j, other, earlier in sorted(rows):
            if j >= i or url.split("/")[2] != other.split("/")[2]:
                continue
            inter, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if text == earlier or (sets[i] and 100 * inter >= cut * union):
                out[i] = j
                break
    return out


def random_bodies(seed, n=160):
    """Families of bodies with edits, cut ends, and common templates of several lengths, on two hosts."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    templates = [[word() for _ in range(k)] for k in (30, 120, 400, 900)]
    rows = [(10_000, "https://a.test/", ""), (10_001, "https://a.test/", "one two"), (10_002, "https://b.test/", "one two"), (10_003, "https://a.test/", "one two")]
    for i in range(n):
        t = list(rnd.choice(templates))
        for _ in range(rnd.randint(0, max(1, len(t) // 60))):
            t[rnd.randrange(len(t))] = word()
        t += [word() for _ in range(rnd.choice((0, 0, 1, 3, 9)))]
        rows.append((rnd.choice((1, -1)) * i if i else 0, f"https://{rnd.choice('ab')}.test/{i}", " ".join(t)))
    return rows + [(20_000 + i, rows[-1 - i][1], rows[-1 - i][2]) for i in range(5)]


@pytest.mark.parametrize("cut", [97, 80])
def test_equals_all_pairs(spark, cut):
    rows = random_bodies(cut)
    want = brute(rows, cut)
    got = {r.page_id: r.similar_to for r in N.similar_bodies(spark.createDataFrame(rows, SCHEMA), cut=cut).collect()}
    assert len(want) > 25 and got == want


def template_sets(spark, n, own, shared=400):
    rnd = random.Random(n)
    common = [rnd.getrandbits(60) for _ in range(shared)]
    rows = [(i, "a.test", common + [rnd.getrandbits(60) for _ in range(own)]) for i in range(n)]
    return spark.createDataFrame(rows, "page_id bigint, grp string, sh array<bigint>")


def pairs_that_meet(rows):
    other = rows.select(*N._BUCKET, F.col("side").alias("want"), F.col("page_id").alias("x"))
    return rows.drop("side").join(other, [*N._BUCKET, "want"]).where("x < page_id").select("x", "page_id").distinct().count()


@pytest.mark.parametrize("own", [7, 11, 40])
def test_template_pages_do_not_meet(spark, own):
    # Similarity 400 / (400 + 2 own): below 97 % from 7 own shingles on.
    for n in (100, 400):
        assert pairs_that_meet(N.prefix_rows(template_sets(spark, n, own), 97)) == 0


def test_similar_template_pages_meet_their_leader_only(spark):
    for n in (100, 400):
        rows = N.prefix_rows(template_sets(spark, n, 5), 97)
        assert N._leader_pairs(rows).select("x", "y").distinct().count() == n - 1


def test_prefix_rows_are_fewer_than_shingles(spark):
    sets = template_sets(spark, 5, 100, shared=9000)
    assert N.prefix_rows(sets, 97).count() < 5 * 9100


def test_signatures_hold_a_slice_of_a_batch_only():
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(400)) for _ in range(3000)] + [None, "", "one two"]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array(["h"] * n), pa.array(["b"] * n), pa.array(texts)], ["page_id", "grp", "body_hash", "text"]
    )
    list(N._sign_slices(iter([batch.slice(0, 10)])))
    tracemalloc.start()
    rows, shingle_count = 0, 0
    for part in N._sign_slices(iter([batch])):
        rows += part.num_rows
        shingle_count += len(part.column("sh").flatten())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and shingle_count == sum(len(shingles(t or "")) for t in texts)
    assert peak < 8 * shingle_count  # the signatures of the whole batch take as much as plain numbers, as lists 5 times that
