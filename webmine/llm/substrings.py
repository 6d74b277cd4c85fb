"""Substring dedup: words inside passages that an earlier document has already, by FM-indexes of shards.

A window is ``WINDOW`` consecutive words. A window that also starts in a document with a smaller id is removed there,
and so every word that some removed window covers. Three steps keep the work near the passages that really repeat:

1. Anchors. In every window the 4-word shingle with the smallest hash is its anchor (a minimizer); equal windows have
   equal anchors. Anchors that only one text has are dropped, and with them nearly all of the corpus.
2. Shards. Around each shared anchor the run of windows that it leads is a fragment. Fragments are dealt to shards by
   their anchor. Equal fragments are one row, with the smallest id that has it, so a passage that many texts share is
   one row too; as its surroundings may still make very many fragments of one anchor, those of anchors with very many
   occurrences are cut into windows that are dealt by their own hash.
3. Search. A shard builds an FM-index of its fragments: suffixes sorted, their Burrows-Wheeler transform in a wavelet
   matrix of bits with rank counts. Every window of every fragment is searched backward; its interval names all
   occurrences in the shard, whose smallest id goes back to the documents.

Equal texts are one text throughout: later copies consist of windows of the first one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import id_or_last
from .words import byte_groups, chunks, mix64, window_hashes, word_hashes

WINDOW = 13
ANCHOR = 4
#: Bits of an anchor. Two shingles with one anchor only make more fragments, so it is as short as a corpus of 10 ** 13
#: distinct shingles allows.
ANCHOR_BITS = 48
#: The pieces of an anchor with more occurrences than this are dealt out window by window.
HOT_TEXTS = 200_000
#: Occurrences of anchors in a shard, about. What a shard takes of a worker's memory grows with its words, not its anchors.
SHARD_ROWS = 30_000
#: Bytes of pieces that are hashed at a time; hashing takes some 40 bytes for each.
HASH_BYTES = 1 << 20
_SALT = np.uint64(0x6A09E667F3BCC909)


# --- anchors and fragments --------------------------------------------------------------------------------------------


def window_anchors(words: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the window at each word of some texts, and whether that window lies in one text."""
    count = max(len(words) - window + 1, 0)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams = mix64(window_hashes(words, ANCHOR) ^ _SALT) >> np.uint64(64 - ANCHOR_BITS)
    anchors = grams[:count].copy()
    for i in range(1, window - ANCHOR + 1):
        np.minimum(anchors, grams[i : i + count], out=anchors)
    return anchors.view(np.int64), owner[:count] == owner[len(words) - count :]


def anchor_rows(keys: np.ndarray, words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, key of the text), a row per run of equal anchors."""
    anchors, whole = window_anchors(words, first, window)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(anchors)]
    new = whole.copy()
    new[1:] &= (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1]) | ~whole[:-1]
    return anchors[new], keys[owner[new]]


def fragments(words: np.ndarray, first: np.ndarray, shared: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, piece, first word, end) of the fragments of some texts: the runs of windows that have one
    ``shared`` anchor. ``piece`` is a hash of all windows of the fragment, each at its place, so of all its words: an
    anchor that recurs makes a run of any length, whose ends say nothing of its middle. Positions count from the first
    text on."""
    anchors, whole = window_anchors(words, first, window)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(anchors)]
    keep = whole & np.isin(anchors, shared)
    change = np.ones(len(anchors), dtype=bool)
    change[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1]) | (keep[1:] != keep[:-1])
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(anchors))
    starts, ends = starts[keep[starts]], ends[keep[starts]]
    lengths = ends - starts
    if not len(starts):
        return owner[starts], anchors[starts], np.zeros(0, dtype=np.int64), starts, ends
    begins = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(begins, lengths)
    full = window_hashes(words, window)[np.repeat(starts, lengths) + place]
    with np.errstate(over="ignore"):
        placed = mix64(full + mix64(place.astype(np.uint64)))
        piece = mix64(np.add.reduceat(placed, begins) ^ mix64(lengths.astype(np.uint64))).view(np.int64)
    return owner[starts], anchors[starts], piece, starts, ends + window - 1


# --- the FM-index -----------------------------------------------------------------------------------------------------


class BitVector:
    """Bits in 64-bit words, with the number of ones before each word: rank in two look-ups."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are set."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask).astype(np.int64)


class FMIndex:
    """Backward search over a text of small numbers (0 separates fragments), for patterns up to ``depth`` long.

    Suffixes are sorted by their first ``depth`` numbers, which orders all that a pattern of that length can tell
    apart. The transform is kept as a wavelet matrix: one bit vector per bit of the alphabet.
    """

    def __init__(self, text: np.ndarray, depth: int) -> None:
        n = len(text)
        rank, width = text.astype(np.int64), 1
        while width < depth:
            ahead = np.full(n, -1, dtype=np.int64)
            ahead[: n - width] = rank[width:]
            order = np.lexsort((ahead, rank))
            new = np.concatenate(([False], (rank[order[1:]] != rank[order[:-1]]) | (ahead[order[1:]] != ahead[order[:-1]])))
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(new)
            width *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        bwt = text[self.suffixes - 1]
        self.bits = max(1, int(text.max()).bit_length())
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=(1 << self.bits) + 1))))
        self.levels, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = ((bwt >> level) & 1).astype(np.uint8)
            self.levels.append(BitVector(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            bwt = np.concatenate((bwt[bit == 0], bwt[bit == 1]))
        self.base = self._descend(np.zeros(1 << self.bits, dtype=np.int64), np.arange(1 << self.bits))

    def _descend(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where position i of each symbol's path ends at the bottom of the matrix."""
        for level, zeros, shift in zip(self.levels, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            ones = level.ones(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the first i numbers of the transform."""
        return self._descend(i, symbol) - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of sorted suffixes that begin with each row of ``patterns``, or (-1, 0) as soon as only one is
        left: the text holds each pattern, so that one is the pattern's own place."""
        last = patterns[:, -1]
        lo, hi = self.starts[last], self.starts[last + 1]
        left, right = np.full(len(patterns), -1, dtype=np.int64), np.zeros(len(patterns), dtype=np.int64)
        open_ = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 2, -1, -1):
            more = hi - lo > 1
            open_, lo, hi = open_[more], lo[more], hi[more]
            symbol = patterns[open_, k]
            lo = self.starts[symbol] + self.rank(lo, symbol)
            hi = self.starts[symbol] + self.rank(hi, symbol)
        left[open_], right[open_] = lo, hi
        return left, right


def first_owners(pieces: list[np.ndarray], owners: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For every window of every piece, the smallest owner of a piece that holds it anywhere."""
    lengths = np.array([len(p) for p in pieces])
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))
    _, dense = np.unique(np.concatenate(pieces), return_inverse=True)
    text = np.zeros(starts[-1], dtype=np.int64)
    where = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, lengths, strict=False)])
    text[where] = dense + 1
    index = FMIndex(text, window)
    owner = np.repeat(owners, lengths + 1)[index.suffixes]
    counts = lengths - window + 1
    out = np.empty(int(counts.sum()), dtype=np.int64)
    at = np.concatenate([np.arange(s, s + c) for s, c in zip(starts, counts, strict=False)])
    view = np.lib.stride_tricks.sliding_window_view(text, window)
    own = np.repeat(owners, counts)
    for lo in range(0, len(at), 1 << 17):
        some = slice(lo, lo + (1 << 17))
        a, b = index.search(view[at[some]])
        out[some] = own[some]
        found = np.flatnonzero(a >= 0)
        if len(found):
            # Intervals of patterns of one length don't overlap, so one pass over their bounds gives all minima.
            left, inverse = np.unique(a[found], return_inverse=True)
            right = np.empty(len(left), dtype=np.int64)
            right[inverse] = b[found]
            bounds = np.column_stack((left, right)).ravel()
            inner = np.append(owner, np.iinfo(np.int64).max)
            out[lo + found] = np.minimum.reduceat(inner, bounds)[::2][inverse]
    return np.split(out, np.cumsum(counts)[:-1])


# --- Spark jobs -------------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """``(t, c, id, text)``: two hashes that stand for an equal text, and the id that sorts."""
    text = F.col("text")
    return docs.where(text.isNotNull()).select(
        F.xxhash64(text).alias("t"), F.crc32(text.cast("binary")).alias("c"), id_or_last("doc_id").alias("id"), text.alias("text")
    )


def _pack(text: Column) -> Column:
    """The compressed UTF-8 of a text; it moves through shuffles in half the space."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        import zstandard

        press = zstandard.ZstdCompressor(level=6)
        return texts.map(lambda t: press.compress(t.encode("utf-8", "surrogatepass")) if isinstance(t, str) else None)

    return pack(text)


def anchors_of(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(anchor, t)``: the anchors of each text, a row per run of windows, under the text's hash."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["t"].to_numpy(np.int64)
            for base, encoded in chunks(batch["text"].tolist()):
                words, first = word_hashes(encoded)
                anchor, t = anchor_rows(keys[base : base + len(encoded)], words, first, window)
                yield pd.DataFrame({"anchor": anchor, "t": t})

    return _keyed(docs).select("t", "text").mapInPandas(emit, "anchor long, t long")


def shared_anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(anchor, t, n)``: the rows of :func:`anchors_of` whose anchor more than one text has, with the number of the
    anchor's rows; checkpointed. Anchors are computed and moved once: their counts and what they are counted for read
    the same shuffle."""
    rows = anchors_of(docs, window).repartition("anchor")
    counted = rows.groupBy("anchor").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n"))
    return cut_lineage(rows.join(counted.where("lo <> hi").select("anchor", "n").hint("merge"), "anchor"))


def marked_texts(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """``(t, first, anchors, packed)``: a row per text in ``shared`` (anchor, t) with its anchors there, its smallest id
    and its compressed UTF-8; checkpointed."""
    marks = shared.groupBy("t").agg(F.collect_set("anchor").alias("anchors"))
    # One key for both sides, so that the texts move once; two texts with one 64-bit hash end the job, they don't mix.
    rows = _keyed(docs).select("t", "c", "id", _pack(F.col("text")).alias("packed"))
    one = rows.groupBy("t").agg(
        F.min("c").alias("c"), F.max("c").alias("c2"), F.min("id").alias("first"), F.any_value("packed").alias("packed"))
    one = one.where(F.assert_true(F.col("c") == F.col("c2"), F.lit("two texts have the same hash")).isNull())
    return cut_lineage(one.join(marks, "t").select("t", "first", "anchors", "packed"))


def _cut(marked: DataFrame, window: int, with_words: bool) -> DataFrame:
    """The fragments of ``marked`` texts: ``(anchor, piece, first, last, words)``, where equal fragments of a task are
    merged into one row with the smallest and largest id, or ``(anchor, piece, first, t, start)`` for each."""
    names = ["anchor", "piece", "first", *(["last", "words"] if with_words else ["t", "start"])]

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                texts = [unpack(p) for p in part["packed"]]
                words, at = word_hashes(texts)
                # Which anchors are shared doesn't depend on the text.
                shared = np.unique(np.concatenate([np.asarray(x, dtype=np.int64) for x in part["anchors"]]))
                yield part, texts, at, *fragments(words, at, shared, window)

    def occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, _, at, text, anchor, piece, start, _ in parts(batches):
            of = {n: part[n].to_numpy(np.int64)[text] for n in ("first", "t")}
            yield pd.DataFrame({"anchor": anchor, "piece": piece, **of, "start": start - at[text]})[names]

    def rows_of(known: dict[tuple[int, int], list]) -> Iterator[pd.DataFrame]:
        rows = iter(known.items())
        while part := [(*k, *v) for k, v in islice(rows, 10_000)]:
            yield pd.DataFrame(part, columns=names)

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[int, int], list] = {}
        for part, texts, _, text, anchor, piece, start, end in parts(batches):
            words = b" ".join(texts).split()
            ids = part["first"].to_numpy(np.int64)[text].tolist()
            for key, i, lo, hi in zip(zip(anchor.tolist(), piece.tolist(), strict=True), ids, start.tolist(), end.tolist(), strict=True):
                row = known.get(key)
                if row is None:
                    known[key] = [i, i, b" ".join(words[lo:hi])]
                else:
                    row[0], row[1] = min(row[0], i), max(row[1], i)
            if len(known) > 100_000:
                yield from rows_of(known)
                known = {}
        yield from rows_of(known)

    schema = "anchor long, piece long, first long, " + ("last long, words binary" if with_words else "t long, start long")
    return marked.select("first", "anchors", "packed", "t").mapInPandas(distinct if with_words else occurrences, schema)


def _hashed(pieces) -> list[np.ndarray]:
    """The word hashes of each piece, of some pieces at a time."""
    out = []
    for part in byte_groups(pieces, HASH_BYTES):
        words, at = word_hashes(part)
        out += np.split(words, at[1:-1])
    return out


def _searched(pieces: DataFrame, window: int, shards: int) -> DataFrame:
    """``pieces`` (route, anchor, piece, first, last, words) as ``(route, anchor, piece, owners)``: for each window of a
    piece the smallest ``first`` of the pieces of the same route that hold it. A shard is an FM-index over all pieces of
    some routes. Pieces of one text alone whose windows nobody has earlier take nothing from anyone and are left out."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        by = pdf.groupby(["route", "anchor", "piece"], sort=False)
        one = by.agg(first=("first", "min"), last=("last", "max"), words=("words", "first")).reset_index()
        firsts = one["first"].to_numpy(np.int64)
        owners = first_owners(_hashed(one["words"]), firsts, window)
        tells = (firsts < one["last"].to_numpy(np.int64)) | np.array([(o < f).any() for o, f in zip(owners, firsts, strict=True)], dtype=bool)
        return one.assign(owners=owners).loc[tells, ["route", "anchor", "piece", "owners"]]

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(search, "route long, anchor long, piece long, owners array<long>")


def _windows(hot: DataFrame, window: int) -> DataFrame:
    """Pieces of hot anchors cut into windows: ``(route, anchor, piece, at, words, first, last)``, the route being a hash
    of the window."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                words, hashes = row.words.split(), _hashed([row.words])[0]
                for at, route in enumerate(window_hashes(hashes, window).view(np.int64).tolist()):
                    out.append((route, row.anchor, row.piece, at, b" ".join(words[at : at + window]), row.first, row.last))
            yield pd.DataFrame(out, columns=["route", "anchor", "piece", "at", "words", "first", "last"])

    return hot.select("anchor", "piece", "words", "first", "last").mapInPandas(
        cut, "route long, anchor long, piece long, at int, words binary, first long, last long")


def piece_owners(pieces: DataFrame, hot: DataFrame, window: int, shards: int) -> DataFrame:
    """``(anchor, piece, at, owners)`` of the fragments ``pieces`` (anchor, piece, first, last, words): from window ``at``
    of the piece on, the smallest id of a text that has the window. ``hot``: the anchors whose pieces are cut."""
    usual = pieces.withColumn("route", F.col("anchor"))
    if hot.isEmpty():
        return _searched(usual, window, shards).select("anchor", "piece", F.lit(0).alias("at"), "owners")
    found = _searched(usual.join(hot, "anchor", "left_anti"), window, shards)
    single = cut_lineage(_windows(pieces.join(hot, "anchor", "left_semi"), window))
    # Equal windows are searched once, under their own hash, and given back to all their places.
    one = single.groupBy("route", "words").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    one = one.select("route", F.col("route").alias("anchor"), F.xxhash64("words").alias("piece"), "first", "last", "words")
    back = _searched(one, window, single.count() // SHARD_ROWS + 1).select("route", F.col("piece").alias("w"), "owners")
    places = single.select("route", F.xxhash64("words").alias("w"), "anchor", "piece", "at").distinct()
    cut = places.join(back, ["route", "w"]).select("anchor", "piece", "at", "owners")
    return found.select("anchor", "piece", F.lit(0).alias("at"), "owners").unionByName(cut)


def repeated_windows(docs: DataFrame, window: int = WINDOW, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """``(t, starts)``: the windows (by first word) of each text that also start in a document with a smaller id than the
    smallest one that has the text (``marked_texts`` has seen that no other text shares its ``t``)."""
    shared = shared_anchors(docs, window)
    anchors = cut_lineage(shared.groupBy("anchor").agg(F.any_value("n").alias("n")))
    shards = (anchors.agg(F.sum("n")).first()[0] or 0) // SHARD_ROWS + 1
    marked = marked_texts(docs, shared)
    hot = anchors.where(F.col("n") > hot_texts).select("anchor")
    owners = piece_owners(_cut(marked, window, True), hot, window, shards)
    taken = F.expr("filter(transform(owners, (o, i) -> if(o < first, start + at + i, null)), x -> x is not null)")
    hits = _cut(marked, window, False).join(owners, ["anchor", "piece"]).select("t", taken.alias("starts"))
    return hits.where(F.size("starts") > 0).groupBy("t").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def kept_words(packed: bytes | None, starts, copy: bool, window: int) -> tuple[list[bytes], int]:
    """(words that stay, number of words) of a compressed text whose windows ``starts`` are removed; of a later copy of an equal
    text all windows are."""
    import zstandard

    words = zstandard.ZstdDecompressor().decompress(packed).split() if packed is not None else []
    if copy and len(words) >= window:
        return [], len(words)
    if starts is None or not len(starts):
        return words, len(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.unique(np.asarray(starts, dtype=np.int64))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)], len(words)


def with_windows(docs: DataFrame, window: int = WINDOW, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """``docs`` (all columns, but ``text`` compressed as ``__packed``) with ``__starts`` (windows to remove, or NULL) and
    ``__copy`` (a later copy of a text)."""
    keyed = _keyed(docs)
    first = keyed.groupBy("t", "c").agg(F.min("id").alias("__first"), F.max("id").alias("hi")).where("__first < hi")
    starts = repeated_windows(docs, window, hot_texts)
    known = first.select("t", "c", "__first").join(starts, "t", "full").toDF("__t", "__c", "__first", "__starts")
    text = F.col("text")
    rows = docs.withColumn("__th", F.xxhash64(text)).withColumn("__ch", F.crc32(text.cast("binary")))
    rows = rows.withColumn("__null", text.isNull()).withColumn("__packed", _pack(text)).drop("text")
    out = rows.join(known, (F.col("__th") == F.col("__t")) & (F.col("__c").isNull() | (F.col("__ch") == F.col("__c"))) & ~F.col("__null"), "left")
    copy = F.coalesce(id_or_last("doc_id") > F.col("__first"), F.lit(False))
    return out.withColumn("__copy", copy).select(*[c for c in docs.columns if c != "text"], "__packed", "__starts", "__copy")


def passage_digest(docs: DataFrame, window: int = WINDOW, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every row: what stays of its words, joined by one space.

    NULL text: no words. Documents with equal ids don't remove from each other; NULL ids count as larger than all.
    Repeated rows have equal results. Texts shorter than a window keep all words. An empty table gives an empty
    result; extra columns are not read.
    """

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def digest(text: pd.Series, starts: pd.Series, copy: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(text, starts, copy, strict=True):
            kept, n = kept_words(*row, window)
            out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])

    rows = with_windows(docs.select("doc_id", "text"), window, hot_texts)
    return rows.select("doc_id", digest("__packed", "__starts", "__copy").alias("d")).select("doc_id", "d.*")


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (all columns) with the repeated words removed from ``text`` and ``n_chars`` brought up to date.

    Texts that lose nothing stay as they are; what others keep is joined by one space. NULL texts stay NULL. Rows
    stay, also with nothing left.
    """

    @F.pandas_udf("string")
    def keep(text: pd.Series, starts: pd.Series, copy: pd.Series) -> pd.Series:
        import zstandard

        out = []
        for t, s, c in zip(text, starts, copy, strict=True):
            kept, n = kept_words(t, s, c, window)
            whole = zstandard.ZstdDecompressor().decompress(t) if t is not None else None
            left = whole if len(kept) == n else b" ".join(kept)
            out.append(None if left is None else left.decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    rows = with_windows(docs, window).withColumn("text", keep("__packed", "__starts", "__copy"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
