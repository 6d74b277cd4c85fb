"""Each operator against a brute-force version, an exact round trip or planted cases, on small tables."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF0001
from webmine.llm import extraction, fingerprints, minhash, mixing, neighbours, packing, sharding, substrings, toxicity, warc
from webmine.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, key string, size string"


def words(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    long, near = words(3000, 1), words(200, 2)
    edited = near[:100] + ["changed"] + near[101:]
    texts = [None, "", " \t\n", "one", "a b c d", " ".join(long), " ".join(near), " ".join(edited), " ".join(near),
             " ".join(long[:40]), "ünï çödé   x", " ".join(words(50, 3)), " ".join(words(50, 3))]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), "x", "y", "z", "w") for i, t in enumerate(texts)]
    rows += [(None, "one", None, None, None, None, None, None, None), rows[6], rows[6], (3, "other text", "en", "s0", 10, "", "", "", "")]
    return spark.createDataFrame(rows, DOCS)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_near_duplicates(odd):
    got = {r["doc_id"]: r["class_id"] for r in rows_of(minhash.near_duplicates(odd))}
    assert got[6] == got[7] == got[8] == 6 and got[11] == got[12] == 11 and got[5] == 5 and got[0] == 0
    assert rows_of(minhash.near_duplicates(odd)).__len__() == odd.count()
    kept = rows_of(minhash.drop_near_duplicates(odd))
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] in (6, 7, 8, 11, 12)) == [6, 11]
    assert Counter(r["text"] for r in kept)[None] == 1 and set(kept[0]) == set(odd.columns)


def test_probability_jaccard_and_signatures():
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(1, 2**62, 400).astype(np.uint64))
    a, b = keys[:300], keys[50:]
    wa, wb = rng.integers(1, 5, len(a)), rng.integers(1, 5, len(b))
    x, y = dict(zip(a.tolist(), wa.tolist())), dict(zip(b.tolist(), wb.tolist()))
    exact = sum(1 / sum(max(x.get(k, 0) / x[d], y.get(k, 0) / y[d]) for k in x.keys() | y.keys()) for d in x.keys() & y.keys())
    assert minhash.probability_jaccard(a, wa, b, wb) == pytest.approx(exact)
    starts = np.array([0, len(a), len(a) + len(b), len(a) + len(b)])
    kept = minhash.prob_minhash(np.concatenate((a, b)), np.concatenate((wa, wb)), starts, 1600)
    assert (kept[0] == kept[1]).mean() == pytest.approx(exact, abs=0.06) and not kept[2].any()


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (4, 9), (20, 20)], "a long, b long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 1) for i in (1, 2, 3, 4, 9)} | {(10, 10), (11, 10), (20, 20)}


@pytest.mark.parametrize("split", [0, 512])
def test_large_buckets_are_compared_whole(spark, monkeypatch, split):
    import zstandard

    monkeypatch.setattr(minhash, "SPLIT_OVER", split)
    monkeypatch.setattr(minhash, "ROWS_OVER", 0)
    monkeypatch.setattr(minhash, "TILE", 8, raising=False)
    n = 60
    texts = [" ".join(words(100, 500 + i // 3 if i % 2 else 900 + i) + words(3, i)) for i in range(n)]
    keys, weights, starts = minhash.weighted_shingles([t.encode() for t in texts])
    sets = [(keys[a:b], weights[a:b]) for a, b in zip(starts, starts[1:])]
    near = [(i, j) for i in range(n) for j in range(i) if minhash.probability_jaccard(*sets[i], *sets[j]) >= 0.8]
    assert len(near) == 10
    # Band 5 is common to all texts and band 9 to many: no text shares a third band that would split them further.
    rows = [(i, [7 if b == 5 else 8 if b == 9 and i % 4 else 10**6 + 100 * i + b for b in range(32)], [0] * 10,
             zstandard.ZstdCompressor().compress(t.encode())) for i, t in enumerate(texts)]
    signed = spark.createDataFrame(rows, "node long, bands array<long>, registers array<long>, packed binary")
    got = {(r.node, r.root) for r in components(minhash.similar_links(signed, signed.select("node"))).collect() if r.node != r.root}
    assert got == set(near)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(120, 9))
    data = [(i, v.tolist()) for i, v in enumerate(base)] + [(200, base[3].tolist()), (201, (base[3] * 2.0**600).tolist())]
    odd_ = [(300, None), (301, []), (302, [0.0] * 9), (303, [math.nan] * 9), (304, [math.inf] + [1.0] * 8), (305, [None] + [1.0] * 8),
            (None, [1.0] * 9), (306, [1.0, 2.0]), (5, base[5].tolist())]
    df = spark.createDataFrame(data + odd_, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = neighbours.nearest_neighbours(df, df.where("vec_id % 50 = 0"), k=4).orderBy("query_id", "rank").collect()
    unit = {i: np.array(v) / np.abs(v).max() for i, v in data}
    for q in (0, 50, 100, 200):
        cos = {i: float(unit[q] @ v / np.sqrt((unit[q] @ unit[q]) * (v @ v))) for i, v in unit.items() if i != q}
        best = sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:4]
        mine = [r for r in got if r.query_id == q]
        assert [r.vec_id for r in mine] == best and [r["rank"] for r in mine] == [1, 2, 3, 4]
        assert [r.score for r in mine] == pytest.approx([cos[i] for i in best])
    assert not [r for r in got if r.query_id in (300, 302)]


def test_shards(odd):
    got = rows_of(sharding.assign_shards(odd, 5))
    assert len(got) == odd.count() and all(r["grown_shard"] in (r["shard"], 5) for r in got)
    for s in range(5):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["size"] == 8 and r["text_crc32"] == 0 for r in got if r["doc_id"] in (0, 1))
    heavy = Counter(r["shard"] for r in rows_of(sharding.assign_shards(odd.sparkSession.range(3000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text")), 3, weights=[2.0, 1.0, 1.0])))
    assert heavy[0] == pytest.approx(1500, abs=120)


def brute_passages(rows, window):
    seen, out = {}, []
    big = 2**63 - 1
    ordered = sorted(rows, key=lambda r: big if r["doc_id"] is None else r["doc_id"])
    for r in ordered:
        w = (r["text"] or "").encode().split()
        for j in range(len(w) - window + 1):
            seen.setdefault(tuple(w[j : j + window]), big if r["doc_id"] is None else r["doc_id"])
    for r in ordered:
        w = (r["text"] or "").encode().split()
        cover = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] < (big if r["doc_id"] is None else r["doc_id"]):
                cover[j : j + window] = [True] * window
        kept = b" ".join(x for x, c in zip(w, cover) if not c)
        out.append((r["doc_id"], len(w), sum(cover), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [2, 10**6])
def test_passages(spark, odd, hot):
    passage = words(30, 9)
    extra = [(100 + i, " ".join(words(5 + i, 50 + i) + passage[i % 4 :] + words(9, 80 + i))) for i in range(12)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = brute_passages(rows_of(docs), 13)
    assert sorted((tuple(r) for r in substrings.passage_digest(docs, hot_texts=hot).collect()), key=str) == want
    kept = {r["doc_id"]: r["text"] for r in rows_of(substrings.remove_repeated_passages(odd.where("doc_id in (0, 2, 5, 9)")))}
    assert kept[0] is None and kept[2] == " \t\n" and kept[9] == ""


@pytest.mark.parametrize("hot", [3, 10**6])
def test_passages_of_periodic_texts_with_other_middles(spark, hot):
    def lines(down, n=24):
        return " ".join(f"status of node is {'down' if i in down else 'ok'}" for i in range(n))

    texts = [lines(x) for x in ((), (12,), (15,), (12, 15), (11, 13), (9, 16, 17))]
    texts += [lines((5, 7), 40), lines((5, 9), 40), "begin " + lines((14,)) + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((tuple(r) for r in substrings.passage_digest(docs, hot_texts=hot).collect()), key=str)
    assert got == brute_passages(rows_of(docs), 13)
    # One fragment from the first recurring anchor to the last, whatever stands between: all of them differ.
    encoded = [t.encode() for t in texts]
    words, first = substrings.word_hashes(encoded)
    anchors = np.unique(substrings.window_anchors(words, first)[0])
    tokens = b" ".join(encoded).split()
    _, anchor, piece, lo, hi = substrings.fragments(words, first, anchors, 13)
    known = {}
    for key, a, b in zip(zip(anchor.tolist(), piece.tolist()), lo.tolist(), hi.tolist()):
        assert known.setdefault(key, tokens[a:b]) == tokens[a:b]


def test_passages_of_the_table(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    assert sorted((tuple(r) for r in substrings.passage_digest(docs).collect()), key=str) == brute_passages(rows_of(docs), 13)


def test_fm_index():
    rng = np.random.default_rng(1)
    for window in (2, 5, 13):
        pieces = [rng.integers(1, 4, size=window + int(rng.integers(0, 9))).astype(np.uint64) for _ in range(80)]
        owners = rng.integers(0, 50, size=80)
        first = {}
        for p, o in zip(pieces, owners):
            for i in range(len(p) - window + 1):
                k = tuple(p[i : i + window])
                first[k] = min(first.get(k, 99), o)
        for p, got in zip(pieces, substrings.first_owners(pieces, owners, window)):
            assert got.tolist() == [first[tuple(p[i : i + window])] for i in range(len(p) - window + 1)]


PAGE = """<html><head><title>T</title><script>var x="</p>";</script></head><body><header><h2>Site</h2></header>
<nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; line</h1>
<p>First <b>paragraph</b> of the text,\n with words.<p>Second one; it goes on, and on.<ul><li>An item.</li></ul></article>
<div class="side-bar"><p>Buy now, cheap.</p></div><form><label>Name</label></form><div id="comments"><p>Nice, thanks.</p></div>
<footer>&copy; me</footer></body></html>"""


def test_extraction(spark):
    df = spark.createDataFrame([(1, None, PAGE), (2, "u", None), (None, "u", ""), (4, "u", "<nav>menu</nav>"), (5, "u", "plain text")],
                               "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in rows_of(extraction.extract_text(df))}
    assert got[1]["text"] == "Head & line\n\nFirst paragraph of the text, with words.\n\nSecond one; it goes on, and on.\n\nAn item."
    assert got[1]["n_chars"] == len(got[1]["text"]) and got[5]["text"] == "plain text"
    assert got[2]["text"] == got[None]["text"] == got[4]["text"] == "" and len(got) == 5


def test_extraction_keeps_short_blocks_beside_long_paragraphs():
    long = "<p>" + "A sentence of the article, with words and marks; it goes on. " * 20 + "</p>"
    inside = """<h1>Head</h1><div class="lead"><p>Short lead of the text.</p></div>%s<table><tr><th>Year</th><td>1,204</td></tr>
    <tr><th>Town</th><td>Ulm</td></tr></table>%s<ul><li>first item</li><li>second</li></ul>
    <div class="figure"><img src=x><div class="caption">A caption</div></div>%s<div class="share"><p>Share this.</p></div>
    <ul class="more"><li><a href=/a>Another page</a></li><li><a href=/b>One more page</a></li></ul>""" % (long, long, long)
    want = ["Head", "Short lead of the text.", "Year", "1,204", "Town", "Ulm", "first item", "second", "A caption"]
    for page in (f"<body><nav>menu</nav><article>{inside}</article><div><p>Outside</p></div></body>",
                 f"<body><div class=top><a href=/>Home</a></div><main><div>{inside}</div></main><footer>x</footer></body>",
                 f"<body><div class=top><a href=/>Home</a></div><div class=text>{inside}</div><div class=low><p>Outside</p></div></body>"):
        got = extraction.content_blocks(page)
        assert [b for b in got if len(b) < 100] == want and len(got) == len(want) + 3


def test_toxicity(spark):
    plain = [" ".join(words(30, 1000 + i)) for i in range(300)]
    insults = ["moronic idiot", "stupid clown"]
    texts = [t + (f" {insults[i % 2]} " + " ".join(words(5, i)) if i % 3 == 0 else "") for i, t in enumerate(plain)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (None, "x"), (902, "you st*pid cl0wn")],
                                 "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = rows_of(toxicity.score_toxicity(docs, labels))
    assert len(got) == 304 and all(0 <= r["score"] <= 1 for r in got)
    tested = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert tested and all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in tested)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert [r["predicted"] for r in got if r["doc_id"] == 902] == [1]
    assert docs.where("doc_id = 7").count() == toxicity.drop_toxic(docs, labels).where("doc_id = 7").count()
    assert toxicity.score_toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_training_sample_has_one_text_per_id(spark):
    hot = next(i for i in range(3, 99) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(i % 3, f"text {i}") for i in range(60)] + [(hot, f"other {i}") for i in range(500)] + [(100, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ids = [0, 1, 2, hot, 100]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    learned = [i for i in ids if zlib.crc32(str(i).encode()) % 4 != 2 and i != 100]
    got = sorted((r["text"], r["toxic"]) for r in rows_of(toxicity.training_sample(docs, labels, 20)))
    assert len(got) == len(learned) and sum(t.startswith("other") for t, _ in got) == 1
    assert got == sorted((r["text"], r["toxic"]) for r in rows_of(toxicity.training_sample(docs.repartition(7), labels, 20)))


def test_deobfuscation():
    text = "you are a stupid clown and an idiot with words of many kinds " * 30
    x = toxicity.letter_codes(text)
    costs = toxicity.trigram_costs(np.bincount((x[:-2] * 64 + x[1:-1]) * 64 + x[2:], minlength=64**3))
    for hidden, plain in (("st*pid", "stupid"), ("cl0wn", "clown"), ("i d i o t", "idiot"), ("1d10t", "idiot"), ("idiooot", "idiot"), ("c.l.o.w.n", "clown")):
        assert toxicity.looks_disguised(hidden)
        assert toxicity.restored(hidden, lambda t: toxicity.restore_token(t, costs)) == plain
    assert not toxicity.looks_disguised("plain words, all of them.")


def test_every_disguise_is_restored():
    text = "you are a stupid clown and an idiot with words of many kinds moron " * 30
    x = toxicity.letter_codes(text)
    costs = toxicity.trigram_costs(np.bincount((x[:-2] * 64 + x[1:-1]) * 64 + x[2:], minlength=64**3))
    hidden = {"id.iot": "idiot", "st_upid": "stupid", "mo/ron": "moron", "i d 1 0 t": "idiot", "i.d.1.0.t": "idiot", "i  d  i  o  t": "idiot",
              "i - d - i - o - t": "idiot", "1 d 1 0 t": "idiot", "m\to\nr o n": "moron", "i'd'i'o't": "idiot"}
    for text, plain in hidden.items():
        assert toxicity.looks_disguised(text), text
        assert toxicity._restored_batch([f"so {text} then"], costs) == [f"so {plain} then".encode()], text
    rng = np.random.default_rng(8)
    signs = list("aidotж½01$*!.,-_/'|~ \u0301  ")
    for _ in range(3000):  # what restored() changes by its decoder passes
        t = "".join(rng.choice(signs, 12))
        if toxicity.restored(t, lambda token: f"<{token}>") != toxicity.restored(t, lambda token: token):
            assert toxicity.looks_disguised(t), t


def test_mixing(odd, spark):
    got = rows_of(mixing.mix_sources(odd))
    assert len(got) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in got)
    totals = {}
    for r in got:
        t = totals.setdefault(r["source"], [r["source_size"], r["target"], 0])
        t[2] += r["taken"]
    assert sum(t[1] for t in totals.values()) == pytest.approx(sum(r["size"] for r in got))
    assert all(t[1] <= 3 * t[0] + 1e-9 for t in totals.values())
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["taken"] for r in rows_of(mixing.mix_sources(odd.repartition(5)))}
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mix_sources(odd.limit(0)).count() == 0


def test_bin_patterns():
    rng = np.random.default_rng(3)
    for _ in range(5):
        histogram = {int(k): int(v) for k, v in Counter(rng.integers(1, 101, 3000).tolist()).items()}
        used, bins = Counter(), 0
        for pattern, times in packing.bin_patterns(histogram, 100):
            assert sum(k * n for k, n in pattern.items()) <= 100 and times > 0
            bins += times
            for k, n in pattern.items():
                used[k] += n * times
        gaps = []  # first fit, longest first
        for size in sorted(Counter(histogram).elements(), reverse=True):
            at = next((i for i, gap in enumerate(gaps) if gap >= size), None)
            if at is None:
                gaps.append(100 - size)
            else:
                gaps[at] -= size
        assert used == histogram and bins <= len(gaps) * 1.02


def test_packing(odd):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(path("byte_bpe_50k.json"))
    bpe.encode_special_tokens = True
    got = rows_of(packing.pack_documents(odd))
    want = Counter()
    for r in rows_of(odd):
        ids = [*bpe.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            want[r["doc_id"], k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], dtype="<u4").tobytes())] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 2048 and packing.pack_documents(odd.limit(0)).count() == 0


def test_packing_of_added_tokens(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"  {end}  \n\n {end}x", "<|endoftext|", "<|endoftext |>", f"ü{end}' ll{end}'ll", f"1{end[:5]}{end}2 "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: np.frombuffer(r["ids"], dtype="<u4").tolist() for r in rows_of(packing.tokenized_pieces(docs, with_ids=True))}
    assert got == {i: [*bpe.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    assert got[0] == [64, 220, 50256, 275, 0]


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "<p>ä</p>"), (2, "http://b/", "<p>ä</p>"), (3, None, None), (4, "u\r\nv", ""), (None, "n", "only"), (5, "z", "x" * 200_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    manifest = warc.archive_pages(df, folder=f"file://{tmp_path}/w")
    got = {r["page_id"]: r for r in rows_of(warc.read_archives(manifest))}
    assert (got[1]["record_type"], got[2]["record_type"], got[2]["refers_to"], got[4]["refers_to"]) == ("response", "revisit", 1, 3)
    assert bytes(got[1]["payload"]).decode() == "<p>ä</p>" and got[5]["payload_bytes"] == 200_000 and got[2]["payload_bytes"] == 9
    assert got[4]["url"] == "u%0D%0Av" and len(got) == 6 and got[None]["record_type"] == "response"
    path = manifest.first()["archive"].removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    with pytest.raises((ValueError, zlib.error)):
        data[len(data) // 2] ^= 1
        import io

        list(warc.read_archive(io.BytesIO(bytes(data))))


def test_fingerprints(odd):
    got = rows_of(fingerprints.compare_with_edits(odd.where("doc_id is not null and doc_id <> 3").dropDuplicates(["doc_id"])))
    docs = {r["doc_id"]: r["text"] or "" for r in rows_of(odd) if r["doc_id"] not in (None, 3)}
    ids = sorted(docs, reverse=True)
    for r in got:
        text, after = docs[r["doc_id"]], docs[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()

        def bag(t):
            w = t.encode().split()
            return Counter(w) + Counter(zip(w, w[1:]))

        for other, near in ((edited, r["near_edited"]), (after, r["near_next"])):
            a, b = bag(text), bag(other)
            real = sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0
            assert near == pytest.approx(real, abs=0.2)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (6, 8)}) == 1 and len(got) == len(docs)
    assert fingerprints.compare_with_edits(odd).count() == odd.count() and fingerprints.compare_with_edits(odd.limit(0)).count() == 0


def test_fingerprints_of_real_weights():
    """Samples of bags with fractional weights agree as often as the generalised Jaccard similarity says."""
    rng = np.random.default_rng(3)
    terms = np.sort(rng.integers(0, 2**63, 60).astype(np.uint64))
    a, b = rng.uniform(0.01, 3.0, 60), rng.uniform(0.01, 3.0, 60)
    bags = [(terms, a), (terms, b), (terms, a * 0.25), (terms[:30], a[:30]), (terms, a), (terms[:0], a[:0])]
    starts = np.cumsum([0] + [len(t) for t, _ in bags])
    sig = fingerprints.weighted_signatures(np.concatenate([t for t, _ in bags]), np.concatenate([w for _, w in bags]), starts, 4096)
    for i, real in ((1, np.minimum(a, b).sum() / np.maximum(a, b).sum()), (2, 0.25), (3, a[:30].sum() / a.sum())):
        assert (sig[0] == sig[i]).mean() == pytest.approx(real, abs=0.03)
    assert (sig[0] == sig[4]).all() and not sig[5].any()
    r, log_c, u = fingerprints.gamma_draws(rng.integers(0, 2**63, 200_000).astype(np.uint64), 5)
    for x, mean, var in ((r, 2, 2), (np.exp(log_c), 2, 2), (u, 0.5, 1 / 12)):
        assert x.mean() == pytest.approx(mean, rel=0.01) and x.var() == pytest.approx(var, rel=0.03)
    assert np.abs(np.corrcoef([r, log_c, u]) - np.eye(3)).max() < 0.01


def test_components_in_few_parts(spark, monkeypatch):
    """A chain, a hub and a ring, in as many parts as the links need."""
    from webmine.llm import graph

    rows = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(i, (i + 7) % 20) for i in range(20)]
    links = spark.createDataFrame(rows, "a long, b long").repartition(8)
    want = {i: 100 for i in range(100, 141)} | {i: 500 for i in range(500, 560)} | dict.fromkeys(range(20), 0)
    got = graph.components(links)
    assert {r["node"]: r["root"] for r in got.collect()} == want and got.count() == len(want)
    assert got.rdd.getNumPartitions() == 1
    monkeypatch.setattr(graph, "PART_LINKS", 50)
    assert {r["node"]: r["root"] for r in graph.components(links).collect()} == want
    assert graph.components(links.limit(0)).count() == 0


def test_tasks_hold_parts_of_a_batch(spark, monkeypatch):
    """Hashes and features are made of bounded parts, whatever a batch or shard holds, with the same results."""
    sizes = []

    def watched(make):
        return lambda encoded, *more: sizes.append((len(encoded), sum(map(len, encoded)))) or make(encoded, *more)

    texts = [" ".join(words(400, i)) for i in range(1500)] + ["", None]
    lexicon = toxicity.Lexicon.build(np.array([5], dtype=np.uint64), np.array([1.0]))
    costs = toxicity.trigram_costs(np.ones(64**3, dtype=np.int64))
    whole = toxicity.text_inputs(toxicity._restored_batch(texts, costs), lexicon)
    pieces = [t.encode() for t in texts[:-1]]
    hashes, at = substrings.word_hashes(pieces)
    monkeypatch.setattr(toxicity, "text_inputs", watched(toxicity.text_inputs))
    monkeypatch.setattr(substrings, "word_hashes", watched(substrings.word_hashes))
    assert (toxicity._inputs_of(texts, costs, lexicon) == whole).all()
    got = substrings._hashed(pieces)
    assert len(got) == len(pieces) and (np.concatenate(got) == hashes).all() and [len(g) for g in got] == np.diff(at).tolist()
    assert len(sizes) > 4 and max(b for _, b in sizes) <= 1 << 20
    assert substrings._hashed([]) == []


def test_fingerprints_draw_few_terms(monkeypatch):
    """Most terms are left out by the bound of their rank, and the samples are those of all ranks drawn."""
    rng = np.random.default_rng(6)
    sizes = [1, 2, 30, 400, 3000, 20_000, 3000]
    every = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    bags = [rng.choice(every, n, replace=False) for n in sizes]
    weights = [rng.choice(w, n).astype(float) for n, w in zip(sizes, ([7], [1], [1, 2], [1, 1, 9], [1], [1, 1, 40], [0.001, 0.3, 25.0]), strict=True)]
    starts = np.cumsum([0, *sizes])
    drawn = []
    draws = fingerprints.gamma_draws
    monkeypatch.setattr(fingerprints, "gamma_draws", lambda terms, sample: drawn.append(len(terms)) or draws(terms, sample))
    got = fingerprints.weighted_signatures(np.concatenate(bags), np.concatenate(weights), starts, 64)
    assert sum(drawn) < 0.3 * 64 * sum(sizes)
    for sample in range(64):
        low = np.array([fingerprints.sample_ranks(t, np.log(w), sample).min() for t, w in zip(bags, weights, strict=True)])
        assert (got[:, sample] == fingerprints.mix64(low.view(np.uint64)) >> np.uint64(48)).all()
    one = fingerprints.weighted_signatures(every[:3], np.array([1e-9, 1.0, 1e9]), np.array([0, 0, 3]), 64)
    assert not one[0].any() and one[1].any()


def test_fingerprints_draw_fewer_terms_of_like_bags(monkeypatch):
    """Bags as long as usual texts: a bag is seldom drawn whole, and no term with a rank below its limit is left out."""
    rng = np.random.default_rng(8)
    every = rng.integers(0, 2**63, 40_000).astype(np.uint64)
    bags = [rng.choice(every, 700, replace=False) for _ in range(100)]
    starts, drawn = np.arange(101) * 700, []
    draws = fingerprints.gamma_draws
    monkeypatch.setattr(fingerprints, "gamma_draws", lambda terms, sample: drawn.append(len(terms)) or draws(terms, sample))
    got = fingerprints.weighted_signatures(np.concatenate(bags), np.ones(70_000), starts, 64)
    assert sum(drawn) < 0.03 * 64 * 70_000
    for sample in (0, 31, 63):
        low = np.array([fingerprints.sample_ranks(t, np.zeros(700), sample).min() for t in bags])
        assert (got[:, sample] == fingerprints.mix64(low.view(np.uint64)) >> np.uint64(48)).all()
    terms = rng.integers(0, 2**63, 300_000).astype(np.uint64)
    for weight, limit in ((1.0, 1e-5), (1.0, 0.01), (3.0, 0.05), (1.0, 0.7), (0.2, 3.0)):
        found = fingerprints.LowRanks(terms, np.full(len(terms), limit * weight)).find(9)
        ranks = fingerprints.sample_ranks(terms, np.full(len(terms), np.log(weight)), 9)
        assert np.isin(np.flatnonzero(ranks < np.log(limit)), found).all()


def test_fingerprints_of_long_texts():
    rng = np.random.default_rng(4)
    long = [" ".join(map(str, rng.integers(0, 2**60, 100_000).tolist())) for _ in range(2)]
    half = long[0][: len(long[0]) // 2]
    often = " ".join(["one two three"] * 300 + ["four five"] * 100)
    less = " ".join(["one two three"] * 100 + ["four five"] * 300)
    sig = fingerprints.signatures([*long, half, often, less, ""], 1024)
    assert fingerprints.likeness(sig[0], sig[1], False, False) < 0.01
    assert fingerprints.likeness(sig[0], sig[2], False, False) == pytest.approx(0.5, abs=0.06)
    a, b = (Counter(w := t.split()) + Counter(zip(w, w[1:])) for t in (often, less))
    assert fingerprints.likeness(sig[3], sig[4], False, False) == pytest.approx(sum((a & b).values()) / sum((a | b).values()), abs=0.06)
    assert not sig[5].any()


@pytest.mark.parametrize("key", ["op2_nearest_neighbours", "op3_sharding", "op7_mixing", "op9_warc"])
def test_sql(spark, key):
    from webmine.llm.oracles import ORACLES
    from webmine.llm.queries import QUERIES

    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF0001}/{name}.parquet')")
    want = con.execute(ORACLES[key])
    names = [c[0] for c in want.description]

    def norm(rows):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in map(tuple, rows))

    got = QUERIES[key](spark, SF0001).select(*names).collect()
    assert sorted(map(str, norm(got))) == sorted(map(str, norm(want.fetchall())))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    stages = corpus_pipeline.STAGES
    toxic = {r["doc_id"] for r in rows_of(toxicity.score_toxicity(docs, spark.read.parquet(f"{SF0001}/labels.parquet"))) if r["predicted"]}
    clean = stages[0][1](spark, docs, SF0001)
    assert {r["doc_id"] for r in rows_of(clean)} == {r["doc_id"] for r in rows_of(docs)} - toxic
    kept = stages[1][1](spark, docs, SF0001)
    classes = rows_of(minhash.near_duplicates(docs))
    assert sorted(r["doc_id"] for r in rows_of(kept)) == sorted({r["class_id"] for r in classes})
    cut = {r["doc_id"]: r["text"] for r in rows_of(stages[2][1](spark, docs, SF0001))}
    for i, n, removed, digest in brute_passages(rows_of(docs), 13):
        if removed:
            assert hashlib.sha256(cut[i].encode()).hexdigest() == digest
    mixed = Counter(r["doc_id"] for r in rows_of(stages[3][1](spark, docs, SF0001)))
    assert mixed == Counter({r["doc_id"]: r["copies"] for r in rows_of(mixing.mix_sources(docs)) if r["copies"]})
    result = corpus_pipeline.run(spark, SF0001)
    assert result.count() > 0 and max(r["length"] for r in rows_of(result)) <= 2048


def test_empty(spark, odd):
    none = odd.limit(0)
    assert minhash.near_duplicates(none).count() == 0 and substrings.passage_digest(none).count() == 0
    assert sharding.assign_shards(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest_neighbours(vectors, vectors).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert extraction.extract_text(pages).count() == 0 and warc.read_archives(warc.archive_pages(pages)).count() == 0


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    """Every class of a table of one large group of unlike strength, copies and repeated words equals that of all pairs."""
    monkeypatch.setattr(minhash, "ROWS_OVER", 0)
    monkeypatch.setattr(minhash, "TILE", 16)
    rng = np.random.default_rng(11)
    base = words(120, 1)
    texts = []
    for i in range(70):
        text = list(base)
        for at in rng.choice(120, int(rng.integers(0, 7)), replace=False).tolist():
            text[at] = f"edit{i}x{at}"
        texts.append(" ".join(text))
    texts += [" ".join(words(80, 50 + i // 2) + ["again and again"] * (i % 5) * 3) for i in range(20)] + ["", "one two", "one two"]
    keys, weights, starts = minhash.weighted_shingles([t.lower().encode() for t in texts])
    sets = [(keys[a:b], weights[a:b]) for a, b in zip(starts, starts[1:])]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or (len(sets[i][0]) and minhash.probability_jaccard(*sets[i], *sets[j]) >= 0.8):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    for x in range(0, 90, 7):
        others = [y for y in range(90) if y != x]
        some = minhash.similar_of_many(dict(enumerate(sets)), x, others, 0.8)
        assert some == [y for y in others if minhash.probability_jaccard(*sets[x], *sets[y]) >= 0.8 - 1e-9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in rows_of(minhash.near_duplicates(docs))}
    assert got == dict(enumerate(root)) and 1 < len(set(root[:70])) < 70


def test_anchors_are_computed_and_moved_once(spark):
    from pyspark.sql import functions as F

    from webmine.llm import substrings

    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40)) + (" " + passage if i % 3 == 0 else "")) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    computed = spark.sparkContext.accumulator(0)
    original = substrings.anchor_rows

    def counted(*args):
        computed.add(1)
        return original(*args)

    substrings.anchor_rows = counted
    try:
        shared = substrings.shared_anchors(docs.coalesce(1)).collect()
    finally:
        substrings.anchor_rows = original
    assert computed.value == 1  # one task, one chunk of texts
    assert {r.t for r in shared} == {r.t for r in docs.where("doc_id % 3 = 0").select(F.xxhash64("text").alias("t")).collect()}
