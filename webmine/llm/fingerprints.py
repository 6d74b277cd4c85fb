"""Document fingerprints by consistent weighted sampling.

A text is a bag of weighted terms: its words and its pairs of adjacent words, each a 64-bit hash, weighing as often as
it occurs. Per sample, the hash of a term decides three numbers: r and c, drawn from Gamma(2, 1), and b, drawn from
[0, 1). A term of weight w has the step t = floor(ln w / r + b) and the rank ln c - r * (t - b + 1), and the sample is
the (term, step) of the smallest rank. Two texts agree in a sample with the probability of their generalised Jaccard
similarity, sum of minima over sum of maxima, whatever positive weights they have and however long they are. As the rank
is the same for equal (term, step) and else another one, a sample is kept as 16 bits of a hash of its rank; unequal ones
agree once in 65,536.

A bag of weight W has its smallest rank below ln(LEAST / W) with the probability 1 - exp(-LEAST). So a cheap lower bound
of the rank, from the same bits without logarithms, leaves out most terms before their numbers are drawn. A bag whose
smallest rank left is not below that limit has all its ranks drawn, so the sample is the same as without the bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks, mix64, window_hashes, word_hashes

SAMPLES = 128
#: Terms whose numbers are drawn at a time: so many that calls cost little beside the work, in arrays a cache holds.
BLOCK = 1 << 16
#: Texts whose terms are drawn together, in bytes; what they share is drawn once.
TEXT_BYTES = 1 << 22
#: A bag's smallest rank is looked for below ln(LEAST / weight of the bag) first.
LEAST = 6.0
_PAIR, _SHORT, _NEXT = np.uint64(0xA0761D6478BD642F), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_HALF, _TURN = np.uint64(32), np.uint64(17)
_TWICE = np.uint64(int(_SHORT) ** 2 % 2**64)
#: Half of the 32-bit numbers, and a little more than the errors of 32-bit floats, so that no uniform is too small.
_MIDDLE = np.float32(2.0**31 + 2.0**8)
_UNIT = np.float32(2.0**-64)


def weighted_terms(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, weight) of each text, and where each text's begin."""
    words, first = word_hashes(encoded)
    text_of = np.repeat(np.arange(len(encoded)), np.diff(first))
    pairs = window_hashes(words ^ _PAIR, 2)
    inside = text_of[:-1] == text_of[1:]
    terms = np.concatenate((words, pairs[inside]))
    texts = np.concatenate((text_of, text_of[:-1][inside]))
    number, distinct = pd.factorize(terms)
    bags = np.sort(texts << 32 | number)
    at = np.flatnonzero(np.diff(bags, prepend=-1))
    weights = np.diff(at, append=len(bags)).astype(np.float64)
    bags = bags[at]
    return distinct[bags & 0xFFFFFFFF], weights, np.searchsorted(bags >> 32, np.arange(len(encoded) + 1))


def gamma_draws(terms: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, ln c, b) of each term in one sample, from 32-bit uniforms: r and c are each the sum
    of two exponentials."""

    def scramble(x: np.ndarray) -> None:
        x ^= x >> _HALF
        x *= _SHORT
        x ^= x >> _HALF

    def uniforms(x: np.ndarray) -> np.ndarray:
        out = x.view(np.int32).astype(np.float64)
        out *= 2.0**-32
        out += 0.5 + 2.0**-33
        return out

    def two_logs(x: np.ndarray) -> np.ndarray:
        both = uniforms(x)
        out = both[0::2] * both[1::2]
        np.log(out, out=out)
        return np.negative(out, out=out)

    with np.errstate(over="ignore"):
        one = terms ^ mix64(np.array([sample], dtype=np.uint64) * _NEXT)
        scramble(one)
        scramble(one)
        two = one + _NEXT
        scramble(two)
        three = two ^ (one >> _TURN)
        scramble(three)
    log_c = two_logs(two)
    return two_logs(one), np.log(log_c, out=log_c), uniforms(three)[1::2]


def sample_ranks(terms: np.ndarray, log_weights: np.ndarray, sample: int, single: int = 0) -> np.ndarray:
    """The rank of each term at its weight in one sample. The first ``single`` terms weigh 1: their step is 0."""
    out = np.empty(len(terms))
    for lo in range(0, len(terms), BLOCK):
        hi = min(lo + BLOCK, len(terms))
        r, log_c, b = gamma_draws(terms[lo:hi], sample)
        b -= 1.0
        if hi > single:
            some = slice(max(single - lo, 0), None)
            b[some] -= np.floor(log_weights[lo:hi][some] / r[some] + (b[some] + 1.0))
        b *= r
        np.add(log_c, b, out=out[lo:hi])
    return out


class LowRanks:
    """Which of some terms may have a rank below the logarithm of their limit. The buffers serve all samples."""

    def __init__(self, terms: np.ndarray, limits: np.ndarray) -> None:
        self.folded = terms ^ (terms >> _HALF)
        # The bound is made of 32-bit floats, whose errors are far below this margin.
        self.quarters = ((limits * 1.0001 + 2e-5) * 2.0**62).astype(np.float32)
        size = min(len(terms), BLOCK)
        self.x, self.y = np.empty(size, dtype=np.uint64), np.empty(size, dtype=np.uint64)
        self.both = np.empty(2 * size, dtype=np.float32)
        self.p, self.q = np.empty(size, dtype=np.float32), np.empty(size, dtype=np.float32)
        self.low = np.empty(size, dtype=bool)

    def find(self, sample: int) -> np.ndarray:
        """Places of such terms in ``sample``, ascending.

        With p = exp(-r) and q = exp(-c), each a product of two uniforms of ``gamma_draws``, the rank of a term of weight
        w is at least ln c - r - ln w; a limit is given times w. With s the root of q, c is at least 4 * (1 - s) / (1 + s),
        so p * (1 - s) must be below a quarter of the limit times 1 + s, here as p - quarter < s * (p + quarter).
        """
        key = mix64(np.array([sample], dtype=np.uint64) * _NEXT)
        key ^= key >> _HALF

        def fold(x: np.ndarray, y: np.ndarray) -> None:
            np.right_shift(x, _HALF, y)
            np.bitwise_xor(x, y, x)

        def product(x: np.ndarray, both: np.ndarray, out: np.ndarray) -> None:
            np.copyto(both, x.view(np.int32), casting="same_kind")
            np.add(both, _MIDDLE, both)
            np.multiply(both[0::2], both[1::2], out)

        found = []
        with np.errstate(over="ignore"):
            for lo in range(0, len(self.folded), BLOCK):
                n = min(BLOCK, len(self.folded) - lo)
                x, y, p, q, low = self.x[:n], self.y[:n], self.p[:n], self.q[:n], self.low[:n]
                # Two folds in a row are none, so two scrambles multiply by the square.
                np.bitwise_xor(self.folded[lo : lo + n], key, x)
                np.multiply(x, _TWICE, x)
                fold(x, y)
                product(x, self.both[: 2 * n], p)
                np.add(x, _NEXT, x)
                fold(x, y)
                np.multiply(x, _SHORT, x)
                fold(x, y)
                product(x, self.both[: 2 * n], q)
                np.multiply(q, _UNIT, q)
                s = np.sqrt(q, q)
                quarter = self.quarters[lo : lo + n]
                sums = np.add(p, quarter, self.both[:n])
                np.multiply(s, sums, s)
                np.subtract(p, quarter, p)
                np.less(p, s, low)
                found.append(np.flatnonzero(low) + lo)
        return np.concatenate(found)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each of ``starts`` on, as many as ``counts`` says, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def weighted_signatures(terms: np.ndarray, weights: np.ndarray, starts: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """A row of ``samples`` 16-bit numbers per bag (from each of ``starts`` on, one entry more than bags); zeros for an
    empty bag. Weights are positive numbers, whole or not. What is equal in term and weight is drawn once for all bags."""
    out = np.zeros((len(starts) - 1, samples), dtype=np.uint16)
    full = np.flatnonzero(np.diff(starts))
    if not len(full):
        return out
    with np.errstate(over="ignore"):
        where, distinct = pd.factorize(mix64(terms + mix64(weights.view(np.uint64))))
    at = np.empty(len(distinct), dtype=np.intp)
    at[where[::-1]] = np.arange(len(where))[::-1]
    # Those that weigh 1 first, else by where a term comes first, so that a bag reads neighbouring ranks.
    order = np.argsort(weights[at] != 1.0, kind="stable")
    place = np.empty(len(order), dtype=np.intp)
    place[order] = np.arange(len(order))
    first, sizes = np.asarray(starts)[full], np.diff(starts)[full]
    limit = LEAST / np.add.reduceat(weights, first)
    where, terms, weights = place[where], terms[at[order]], weights[at[order]]
    log_weights, single = np.log(weights), int(np.count_nonzero(weights == 1.0))
    # The bags of each term, and the largest limit among them.
    bags = np.sort(where << 32 | np.repeat(np.arange(len(full)), sizes)) & 0xFFFFFFFF
    uses = np.bincount(where, minlength=len(terms))
    begins = np.cumsum(uses) - uses
    low_ranks = LowRanks(terms, np.maximum.reduceat(limit[bags], begins) * weights)
    log_limit = np.log(limit)
    useful = np.maximum.reduceat(log_limit[bags], begins)
    for sample in range(samples):
        some = low_ranks.find(sample)
        ranks = sample_ranks(terms[some], log_weights[some], sample, int(np.searchsorted(some, single)))
        # The others settle no bag.
        kept = np.flatnonzero(ranks < useful[some])
        some, ranks = some[kept], ranks[kept]
        low = np.full(len(full), np.inf)
        np.minimum.at(low, bags[_ranges(begins[some], uses[some])], np.repeat(ranks, uses[some]))
        open_ = np.flatnonzero(~(low < log_limit))
        if len(open_):
            every = where[_ranges(first[open_], sizes[open_])]
            ranks = sample_ranks(terms[every], log_weights[every], sample)
            low[open_] = np.minimum.reduceat(ranks, np.cumsum(sizes[open_]) - sizes[open_])
        out[full, sample] = mix64(low.view(np.uint64)) >> np.uint64(48)
    return out


def signatures(texts: list[str], samples: int = SAMPLES) -> np.ndarray:
    """A row of ``samples`` 16-bit numbers per text; zeros for a text without words."""
    out = np.zeros((len(texts), samples), dtype=np.uint16)
    for base, encoded in chunks(texts, limit=TEXT_BYTES):
        out[base : base + len(encoded)] = weighted_signatures(*weighted_terms(encoded), samples)
    return out


def likeness(a: np.ndarray, b: np.ndarray, a_empty: bool, b_empty: bool) -> float:
    """The share of equal samples; texts without words are like each other only."""
    return float(a_empty and b_empty) if a_empty or b_empty else float((a == b).mean())


def _has_words(text: str) -> bool:
    return bool(text.encode("utf-8", "surrogatepass").strip())


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``(doc_id, fingerprint)``: the signature of every whole text as hex (4 digits a sample). NULL text: as empty."""

    @F.pandas_udf("string")
    def sign(texts: pd.Series) -> pd.Series:
        sig = signatures([t if isinstance(t, str) else "" for t in texts], samples)
        return pd.Series([row.astype(">u2").tobytes().hex() for row in sig])

    return docs.select("doc_id", sign("text").alias("fingerprint"))


def with_successors(docs: DataFrame, parts_per_task: int = 2) -> DataFrame:
    """Documents dealt so that a task can stream them next to their successors: ``(__part, __tail, doc_id, text)``
    sorted inside each part by descending doc_id.

    The parts are ranges of doc_id, cut at its quantiles. Each part ends with a copy of the first document of the next
    part (``__tail`` 1; the last part's is the first document of all). So every text moves once, and what the driver
    sees is one narrow row per part. NULL doc_ids come after all others; equal doc_ids are ordered by a hash of the
    text. Rows that share one doc_id share a part.
    """
    spark = docs.sparkSession
    n = parts_per_task * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    text = F.coalesce(F.col("text"), F.lit(""))
    share = [i / n for i in range(1, n)]
    cuts = docs.agg(F.percentile_approx(key, share, 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    above = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c >= key)) if cuts else F.lit(0)
    rows = docs.select(
        above.alias("__part"), key.alias("__key"), F.xxhash64(text).alias("__hash"),
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
    )
    first = F.max(F.struct("__key", (-F.col("__hash").cast("decimal(20)")).alias("h")))
    heads = rows.groupBy("__part").agg(first.alias("f")).orderBy("__part").collect()  # a row per part
    if not heads:
        return rows.withColumn("__tail", F.lit(0))
    after = [(heads[(i + 1) % len(heads)]["f"], h["__part"]) for i, h in enumerate(heads)]
    named = [(f["__key"], int(-f["h"]), part) for f, part in after]
    goes_to = spark.createDataFrame(named, "__k long, __h long, __to int")
    found = rows.join(F.broadcast(goes_to), (F.col("__key") == F.col("__k")) & (F.col("__hash") == F.col("__h")))
    tails = found.dropDuplicates(["__to"]).select(
        F.col("__to").alias("__part"), "__key", "__hash", "doc_id", "text", F.lit(1).alias("__tail")
    )
    dealt = rows.withColumn("__tail", F.lit(0)).unionByName(tails).repartition(n, "__part")
    return dealt.sortWithinPartitions("__part", "__tail", F.col("__key").desc(), "__hash")


def compare_with_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has the last floor(n_chars / 3) code points replaced by as many of the next document's first ones
    (all, if it has fewer); next is by descending doc_id, and the first after the last. ``near_*``: likeness of the
    fingerprint to the edited text's and to the next document's. NULL text: as empty. Texts without words are like
    each other (1) and unlike all others (0). One row per input row, also for repeated and NULL ids. An empty table
    gives an empty result; extra columns are not read.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple] = []  # the last row so far: part, tail, doc_id, text, signature
        for batch in batches:
            texts = batch["text"].tolist()
            ids = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
            rows = kept + [(*row, None) for row in zip(batch["__part"], batch["__tail"], ids, texts, strict=True)]
            # A text stands beside its edited text, so that what they share is drawn once.
            work, text_at, edit_at = [], {}, {}
            for i, x in enumerate(rows):
                if i >= len(kept):
                    text_at[i] = len(work)
                    work.append(x[3])
                if i + 1 < len(rows) and not x[1]:
                    edit_at[i] = len(work)
                    n = len(x[3]) // 3
                    work.append(x[3][: len(x[3]) - n] + rows[i + 1][3][:n])
            sigs = signatures(work, samples)
            rows = [(*x[:4], sigs[text_at[i]] if i in text_at else x[4]) for i, x in enumerate(rows)]
            kept = rows[-1:]
            out = []
            for i, at in edit_at.items():
                x, y, edit, sig = rows[i], rows[i + 1], work[at], sigs[at]
                empty = not _has_words(x[3])
                out.append((
                    None if x[2] is None else str(x[2]), len(x[3]),
                    hashlib.sha256(edit.encode("utf-8", "surrogatepass")).hexdigest(),
                    x[4].astype(">u2").tobytes().hex(), sig.astype(">u2").tobytes().hex(),
                    likeness(x[4], sig, empty, not _has_words(edit)), likeness(x[4], y[4], empty, not _has_words(y[3])),
                ))
            yield pd.DataFrame(out, columns=names)

    schema = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    dealt = with_successors(docs).select("__part", "__tail", F.col("doc_id").cast("string").alias("doc_id"), "text")
    return dealt.mapInPandas(compare, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
