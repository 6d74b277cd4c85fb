"""Nothing that grows with the input is broadcast through the driver, whatever Spark takes its size for."""

from collections import Counter

import numpy as np
import pytest

from webmine.llm import minhash, neighbours
from webmine.llm.graph import components


@pytest.fixture
def no_broadcasts(spark):
    """Any broadcast for a join ends its query."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_neighbours(spark, no_broadcasts, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    x = np.random.default_rng(3).normal(size=(60, 5))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(vectors, vectors.where("vec_id % 3 = 0"), k=2).collect()
    assert Counter(r.query_id for r in got) == {i: 2 for i in range(0, 60, 3)}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosines = unit @ unit.T - 2 * np.eye(60)
    assert all(r.vec_id == np.argsort(-cosines[r.query_id])[r["rank"] - 1] for r in got)


def test_components(spark, no_broadcasts):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 8], "a long, b long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, (i - 1) // 8 * 8 + 1) for i in range(1, 41)}


@pytest.mark.parametrize("rows_over", [16, 0])
def test_near_duplicates(spark, no_broadcasts, monkeypatch, rows_over):
    """Also with buckets that are compared in tiles."""
    monkeypatch.setattr(minhash, "ROWS_OVER", rows_over)
    monkeypatch.setattr(minhash, "TILE", 8)
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    texts = []
    for i in range(40):  # ten groups of four like texts, each more unlike the base
        group = base[: 120 - 10 * (i // 4)] + [f"g{i // 4}x{j}" for j in range(10 * (i // 4))]
        texts.append(" ".join([*group, f"end{i}"]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[5], None])], "doc_id long, text string")
    sets = [minhash.weighted_shingles([t.encode()])[:2] for t in texts]
    root = list(range(40))
    for i in range(40):
        for j in range(i):
            if minhash.probability_jaccard(*sets[i], *sets[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == dict(enumerate([*root, root[5], 41])) and 5 <= len(set(root)) < 40
    kept = [r.doc_id for r in minhash.drop_near_duplicates(docs).collect()]
    assert sorted(kept) == sorted({*root, 41})
