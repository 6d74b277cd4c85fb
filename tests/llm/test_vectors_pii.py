"""Vector codes, whitening and personal data against brute force, and on odd rows."""

import hashlib
import math
import re

import numpy as np
import pytest

from tests.conftest import SF0001
from webmine.llm import codes, pii, whitening

VECTORS = "vec_id long, embedding array<double>, label int, x string, part int, n long, code string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, 2, "c") for i, v, lab in rows], VECTORS)


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Repeated vectors, NULL ids and labels, unusable vectors, ties, clashing columns."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=16)], i % 5 if i % 7 else None) for i in range(300)]
    rows += [(900 + i, rows[4][1], 1) for i in range(150)] + [rows[9], rows[9], (None, rows[2][1], 3), (None, [0.25] * 16, None)]
    rows += [(1000, None, 1), (1001, [1.0, None] + [0.0] * 14, 1), (1002, [math.nan] + [0.0] * 15, 2), (1003, [math.inf] + [0.0] * 15, 2)]
    return rows


def usable(rows):
    return [(i, v, lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def brute_codes(rows, parts=8, entries=16, rounds=6):
    x = [[math.floor(4096 * c) for c in v] for _, v, _ in rows]
    first = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, x[r]))[:entries]
    w = len(x[0]) // parts
    code, error, books = [""] * len(x), [0] * len(x), []
    for p in range(parts):
        own = [v[p * w : p * w + w] for v in x]
        book = [own[r] for r in first]
        near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))  # noqa: B023, B905, E731
        for _ in range(rounds):
            at = [near(v)[1] for v in own]
            for e in range(len(book)):
                members = [v for v, k in zip(own, at) if k == e]
                if members:
                    book[e] = [sum(c) // len(members) for c in zip(*members)]
        for r, v in enumerate(own):
            d, k = near(v)
            code[r] += f"{k:02x}"
            error[r] += d
        books += [c for e in book for c in e]
    return code, error, hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()


@pytest.mark.parametrize("block", [3, codes.BLOCK])
def test_vector_codes(spark, odd_vectors, monkeypatch, block):
    monkeypatch.setattr(codes, "BLOCK", block)
    rows = usable(odd_vectors)
    code, error, sha = brute_codes(rows)
    totals = {lab: sum(e for e, (_, _, other) in zip(error, rows) if other == lab) for lab in {r[2] for r in rows}}
    want = sorted(zip([r[0] or -1 for r in rows], code, error, [totals[r[2]] for r in rows], [sha] * len(rows)))
    got = codes.encode_vectors(table_of(spark, odd_vectors)).collect()
    assert sorted((r.vec_id or -1, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == want


def test_vector_codes_of_few_and_wide_numbers(spark):
    rows = [(3, [1e9] * 8, 0), (1, [-1e9] * 8, 0), (2, [1e9 + 1] * 8, None)]
    code, error, sha = brute_codes(rows)
    got = codes.encode_vectors(table_of(spark, rows)).collect()
    assert sorted((r.vec_id, r.code, r.error, r.codebooks_sha256) for r in got) == sorted((r[0], c, e, sha) for r, c, e in zip(rows, code, error))
    assert codes.encode_vectors(table_of(spark, [])).count() == 0
    assert codes.encode_vectors(table_of(spark, [(1, None, 2)])).count() == 0


def test_trie_distances():
    rng = np.random.default_rng(4)
    parts = np.unique(rng.integers(-3, 4, (500, 5)), axis=0)
    entries = rng.integers(-3, 4, (7, 5))
    d = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    index, error = codes.nearest(parts, entries)
    assert (index == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def brute_whitening(rows, k=16):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), [int(c) for c in fit.sum(axis=0)]
    y = x - fit.mean(axis=0)
    centred = fit - fit.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    deviations = [sum((n * int(a) - b) ** 2 for a, b in zip(r, s)) for r in x]
    return n, deviations, np.abs(y @ v[:, :k] / np.sqrt(e[:k])), e[:k] / e.sum()


@pytest.mark.parametrize("least", [4, whitening.LEAST_STEPS])
def test_whitening(spark, odd_vectors, monkeypatch, least):
    monkeypatch.setattr(whitening, "LEAST_STEPS", least)
    if least == 4:  # several tasks, added up in two levels
        monkeypatch.setattr(whitening, "TASK_BYTES", 64)
        monkeypatch.setattr(whitening, "DIRECT_ROWS", 1)
    rows = usable(odd_vectors)
    n, deviations, whitened, explained = brute_whitening(rows)
    got = whitening.whiten_vectors(table_of(spark, odd_vectors)).collect()
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 17))
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviations)
    assert all(0 <= r.identity_error < 1e-9 for r in got)
    by_dev = dict(zip(deviations, whitened))
    for r in got:
        assert abs(r.whitened) == pytest.approx(by_dev[r.deviation][r.component - 1], abs=1e-8)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-10)
    sign = {r.component: np.sign(r.whitened) for r in got if r.vec_id == 11}
    y = {r.component: r.whitened for r in got if r.vec_id == 11}
    assert all(sign[c] * y[c] >= 0 for c in y)


def test_whitening_of_flat_and_equal_directions(spark):
    # Two equal variances, a constant and a repeated dimension: rank 3 of 6.
    square = [(float(a), float(b), float(c)) for a in (-4, 4) for b in (-4, 4) for c in (-1, 1)]
    rows = [(i, [a, b, c, c, 7.0, 0.0], None) for i, (a, b, c) in enumerate(square)]
    got = whitening.whiten_vectors(table_of(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3} and all(r.identity_error < 1e-9 for r in got)
    assert sum(r.explained for r in got if r.vec_id == 0) == pytest.approx(1)
    assert whitening.whiten_vectors(table_of(spark, [])).count() == 0
    assert whitening.whiten_vectors(table_of(spark, [(1, [2.0, 3.0], 0), (2, [2.0, 3.0], 0), (3, None, 0)])).count() == 0


def test_whitening_matches_eigenvectors_of_the_table(spark):
    table = spark.read.parquet(f"{SF0001}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table.collect()]
    n, deviations, whitened, explained = brute_whitening(rows)
    got = {(r.vec_id, r.component): r for r in whitening.whiten_vectors(table).collect()}
    for (i, _, _), d, w in zip(rows, deviations, whitened):
        assert got[i, 1].deviation == d and got[i, 1].n == n
        assert [abs(got[i, c].whitened) for c in range(1, 17)] == pytest.approx(list(w), abs=1e-7)


# Personal data

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == pii.IP and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == pii.CARD and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == pii.PHONE and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


PIECES = ["a@b.c", "x.y@", "@", "b-c.de", "_", ".", "-", " ", "1.2.3.4", "300.1", ".5", "4111 1111-1111 1111", "4111111111111111", "4", "12", "+", "+1",
          "(555)", " 201", "-3344", "é", "日本", "😀", "to", "\n", "0000", "256", "001.02.3.4", "%", "a.b@c.d_e@f.g"]


def test_base_spans_equal_regular_expressions(spark):
    rng = np.random.default_rng(6)
    texts = [None, ""] + ["".join(rng.choice(PIECES, rng.integers(1, 14))) for _ in range(6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.span_digest(df, pii.Model()).collect()}
    wants = [brute_base(t) for t in texts]
    assert sum(map(len, wants)) > 2000
    for i, want in enumerate(wants):
        assert got[i].spans == listed(want), texts[i]
        assert got[i].base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in want) for k in range(4)] and got[i].n_added == 0


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose with plain personal data, none of it disguised."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghilmnorstu"), rng.integers(2, 9)))
    prose = lambda: " ".join(word() for _ in range(rng.integers(5, 30)))

    def card():
        d = "4" + "".join(rng.choice(list("0123456789"), 14))
        return d + next(c for c in "0123456789" if luhn(d + c))

    make = [
        lambda: f"{word()}.{word()}{rng.integers(100)}@{word()}.example.com", lambda: ".".join(str(v) for v in rng.integers(1, 256, 4)), card,
        lambda: f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}",
    ]
    rows = [(i, f"{prose()}, {make[i % 4]()} {prose()}.") for i in range(1200)]
    return spark.createDataFrame(rows, "doc_id long, text string"), card()


@pytest.fixture(scope="module")
def model(corpus):
    return pii.fit_model(corpus[0], spans=250)


def test_model_adds_what_base_rules_miss(spark, corpus, model):
    card = corpus[1]
    grouped = ".".join(card[i : i + 4] for i in (0, 4, 8, 12))
    bad = card[:-1] + str((int(card[-1]) + 1) % 10)
    cases = [
        ("write to jane.doe22 [at] mail [dot] example [dot] com today", "email", "jane.doe22 [at] mail [dot] example [dot] com"),
        (f"reach +1 (269) 555-3296 {card} and more", "phone", "+1 (269) 555-3296"),
        (f"reach +1 (269) 555-3296 {card} and more", "card", card),
        (f"paid with {grouped} then", "card", grouped), ("phone me at (988) 555-2485 soon", "phone", "(988) 555-2485"),
        ("the host 10[.]20[.]30[.]40 answered", "ip", "10[.]20[.]30[.]40"),
    ]
    clean = ["", "we met at the old house. Then home", "version 1.2.3.4.5 was out", f"number {bad} here", "years 1999 2000 2001 2002", "1.5 2.5 3.5", "a-b 12-34-56"]
    df = spark.createDataFrame(list(enumerate([c[0] for c in cases] + clean)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.span_digest(df, model).collect()}
    for i, (text, kind, surface) in enumerate(cases):
        at = text.index(surface)
        assert f"{kind}:{at}:{at + len(surface)}" in got[i].spans.split(","), text
        assert set(listed(brute_base(text)).split(",")) - {""} <= set(got[i].spans.split(","))
    for i, text in enumerate(clean, len(cases)):
        assert got[i].spans == listed(brute_base(text)), text


def test_thresholds_hold_their_precision(model, corpus):
    rows = pii.training_proposals(corpus[0], spans=250).where("held_out")
    scored = rows.withColumn("s", model.score(rows.f)).toPandas()
    assert set(model.thresholds) == {0, 1, 2, 3} and len(model.trees) == pii.TREES
    for kind, least in model.thresholds.items():
        own = scored[scored.kind == kind]
        chosen = own[own.s >= least]
        assert chosen.label.mean() >= pii.PRECISION and chosen.label.sum() >= 0.8 * own.label.sum()


def test_personal_data_on_odd_rows(spark, model):
    schema = "doc_id long, text string, spans string, base_spans int, kind string, m int, start int"
    far = " ".join(f"user{i}@h.example.com" for i in range(20000))
    rows = [(1, None, "s", 1, "k", 2, 3), (None, "a@b.c", None, None, None, None, None), (1, "a@b.c", "s", 1, "k", 2, 3), (1, "a@b.c", "s", 1, "k", 2, 3),
            (4, far, "", 0, "", 0, 0), (5, "1" * 300_000 + " " + "a." * 200_000 + "@", "", 0, "", 0, 0), (6, "1." * 200_000 + "+1" + " " * 300_000, "", 0, "", 0, 0)]
    df = spark.createDataFrame(rows, schema)
    got = pii.span_digest(df, model).collect()
    assert len(got) == 7 and sum(r.n_email for r in got) == 3 + 20000
    assert next(r for r in got if r.doc_id == 4).base_sha256 == hashlib.sha256(listed(brute_base(far)).encode()).hexdigest()
    clean = pii.redact(df, model).where("doc_id is null or doc_id = 1").collect()
    assert sorted(str(r.text) for r in clean) == ["<email>", "<email>", "<email>", "None"]
    assert pii.redact(df, model).columns == df.columns
    text = "mail a@b.c or 1.2.3.4, call +1 (555) 201-3344."
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.redact(one, model).first().text == "mail <email> or <ip>, call <phone>."
    empty = df.limit(0)
    assert pii.span_digest(empty).count() == 0 and pii.fit_model(empty).thresholds == {}


def test_model_is_fitted_on_all_base_spans(spark):
    n = 1500
    rows = [(i, f"ask {chr(97 + i % 26)}{i} or user{i}@mail{i}.example.com for news") for i in range(n)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    right = pii.training_proposals(docs).where("label = 1").groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in right} == {pii.EMAIL: 5 * n}  # five right spellings of each different span
