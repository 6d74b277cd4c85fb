"""Toxicity of texts behind a noisy channel.

Writers hide insults by leetspeak (``1d10t``), masks (``id*ot``), spacing (``i d i o t``, ``i.d.i.o.t``) and
repetition (``idiooot``). The channel model lists the letters that each sign may stand for, which makes a disguised
token a lattice; the Viterbi path under a character trigram model (counted over the whole corpus) restores it. The
restored text is then scored: words and word beginnings that labelled toxic texts use far more often than clean ones
form a weighted lexicon, and a logistic regression turns what a text holds of it into a probability.

Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import byte_groups, mix64

#: At most so many labelled texts fit the lexicon and the regression (the first by md5 of the id).
TRAINING_ROWS = 20_000
#: At most so many lexicon entries, the most telling ones.
LEXICON = 4_096
THRESHOLD = 0.3
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 4, 2

#: The letters of the character model: 0 stands for everything else.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
_BASE = 64
#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a",
    "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": LETTERS, "#": LETTERS,
}
#: Signs that stand for any letter.
MASKS = frozenset(k for k, v in LEET.items() if v == LETTERS)
SPACERS = " .-_~,/\\'\"`^"
#: Costs of the channel, in nats: reading a sign as a letter, dropping one of a pair of equal signs or of a longer
#: run, keeping a letter after two of its kind.
LEET_COST, DROP_OF_PAIR, DROP_OF_RUN, KEEP_TRIPLE = 0.5, 4.0, 1.0, 4.0
#: Lengths (bytes) of the word beginnings that are features.
STEMS = (4, 5, 6)
#: Texts that are restored at a time, and bytes whose features are made at a time; these take some 60 bytes for each.
SLICE, SLICE_BYTES = 512, 1 << 19
_STEM_SALT = np.uint64(0x51ED270B7A1F4E6D)


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels are never learned from; rows without an id count as crc32 of the empty text."""
    name = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(name) % HELD_OUT_MODULUS == HELD_OUT_REMAINDER


# --- the character model ---------------------------------------------------------------------------------------------


def letter_codes(text: str) -> np.ndarray:
    """Codes of the lower-cased text's characters, 0 before and after it and for what is no letter."""
    table = np.zeros(0x180, dtype=np.int64)
    table[[ord(c) for c in LETTERS]] = np.arange(1, len(LETTERS) + 1)
    points = np.frombuffer(f"\n\n{text.lower()}\n".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return table[np.where(points < len(table), points, 0)]


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each letter triple (with 0 for the ends of words) occurs in all texts: a table of 64 ** 3 cells."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_BASE**3, dtype=np.int64)
        for batch in batches:
            texts = [t for t in batch["text"] if isinstance(t, str)]
            for lo in range(0, len(texts), 256):
                x = letter_codes("\n\n".join(texts[lo : lo + 256]))
                grams = (x[:-2] * _BASE + x[1:-1]) * _BASE + x[2:]
                total += np.bincount(grams[(x[1:-1] > 0) | (x[2:] > 0)], minlength=_BASE**3)
        gram = np.flatnonzero(total)
        yield pd.DataFrame({"gram": gram.astype(np.int32), "n": total[gram]})

    counted = docs.select(F.col(text).alias("text")).mapInPandas(count, "gram int, n long")
    out = np.zeros(_BASE**3, dtype=np.int64)
    for r in counted.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # 64 ** 3 rows at most
        out[r["gram"]] = r["n"]
    return out


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """-ln P(c | a, b), interpolated with the bigram and unigram estimates, as a [64, 64, 64] table."""
    c3 = counts.reshape(_BASE, _BASE, _BASE).astype(np.float64)
    c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
    p1 = (c1 + 1) / (c1 + 1).sum()
    p2 = (c2 + 5 * p1[None, :]) / (c2.sum(axis=1, keepdims=True) + 5)
    p3 = (c3 + 5 * p2[None, :, :]) / (c3.sum(axis=2, keepdims=True) + 5)
    return (-np.log(p3)).astype(np.float32)


# --- the channel -----------------------------------------------------------------------------------------------------


def restore_token(token: str, costs: np.ndarray) -> str:
    """The letters that a lower-case token most likely stands for: Viterbi over (last two letters, run of the last)."""
    best: dict[tuple[int, int, int], tuple[float, str]] = {(0, 0, 0): (0.0, "")}
    number = {c: i + 1 for i, c in enumerate(LETTERS)}
    signs = [c for c in token if c not in SPACERS]
    runs = [n for _, run in itertools.groupby(signs) for n in [len(list(run))] for _ in range(n)]
    if any(c in MASKS for c in signs):
        return _restore_masked(signs, runs, costs)
    before = ""
    for sign, length in zip(signs, runs, strict=True):
        choices = [(sign, 0.0)] if sign not in LEET else [(c, LEET_COST) for c in LEET[sign]]
        step: dict[tuple[int, int, int], tuple[float, str]] = {}
        for (a, b, run), (cost, text) in best.items():
            if sign == before:  # a repeated sign may mean nothing
                _keep(step, (a, b, min(run + 1, 3)), cost + (DROP_OF_PAIR if length == 2 else DROP_OF_RUN), text)
            for c, extra in choices:
                n = number.get(c, 0)
                again = n == b and sign == before
                more = extra + float(costs[a, b, n]) + (KEEP_TRIPLE if again and run >= 2 else 0.0)
                _keep(step, (b, n, min(run + 1, 3) if again else 1), cost + more, text + c)
        best, before = step, sign
    return min(((cost + float(costs[a, b, 0]), text) for (a, b, _), (cost, text) in best.items()), default=(0.0, ""))[1]


def _restore_masked(signs: list[str], runs: list[int], costs: np.ndarray) -> str:
    """``restore_token`` where a sign may be any letter: the same search with a step as minima over tables of all states
    (last two letters, run of the last), so that a mask of any length costs its length."""
    number = {c: i + 1 for i, c in enumerate(LETTERS)}
    by_before = np.ascontiguousarray(costs.transpose(1, 2, 0), dtype=np.float64)  # [last, next, last but one]
    shape = (_BASE, _BASE, 4)
    flat = np.arange(np.prod(shape), dtype=np.int32).reshape(shape)
    best = np.full(shape, np.inf)
    best[0, 0, 0] = 0.0
    steps: list[tuple[str, np.ndarray, np.ndarray]] = []
    before = ""
    for sign, length in zip(signs, runs, strict=True):
        choices, extra = (LEET[sign], LEET_COST) if sign in LEET else (sign, 0.0)
        n = np.array([number.get(c, 0) for c in choices])
        part = slice(1, len(LETTERS) + 1) if choices == LETTERS else n
        again = sign == before
        new, source, letter = np.full(shape, np.inf), np.zeros(shape, dtype=np.int32), np.full(shape, -1, dtype=np.int16)
        run_of = best.argmin(axis=2)
        total = by_before[:, part] + best.min(axis=2).T[:, None, :]
        a = total.argmin(axis=2)
        b = np.arange(_BASE)[:, None]
        value = np.take_along_axis(total, a[:, :, None], axis=2)[:, :, 0] + extra
        if again:
            value[n, np.arange(len(n))] = np.inf  # the same letter once more goes on with its run, below
        new[:, n, 1] = value
        source[:, n, 1] = flat[a, b, run_of[a, b]]
        letter[:, n, 1] = np.arange(len(n))
        if again:
            drop = DROP_OF_PAIR if length == 2 else DROP_OF_RUN
            for run in range(4):
                to = min(run + 1, 3)
                more = best[:, n, run].T + by_before[n, n] + extra + (KEEP_TRIPLE if run >= 2 else 0.0)
                a = more.argmin(axis=1)
                value = more[np.arange(len(n)), a]
                better = value < new[n, n, to]
                at = n[better]
                new[at, at, to], source[at, at, to], letter[at, at, to] = value[better], flat[a[better], at, run], np.flatnonzero(better)
                value = best[:, :, run] + drop
                better = value < new[:, :, to]
                new[:, :, to][better], source[:, :, to][better], letter[:, :, to][better] = value[better], flat[:, :, run][better], -1
        steps.append((choices, source, letter))
        best, before = new, sign
    state = int((best + costs[:, :, :1]).argmin())
    out: list[str] = []
    for choices, source, letter in reversed(steps):
        if (at := int(letter.ravel()[state])) >= 0:
            out.append(choices[at])
        state = int(source.ravel()[state])
    return "".join(reversed(out))


def _keep(step: dict, state: tuple[int, int, int], cost: float, text: str) -> None:
    if state not in step or (cost, text) < step[state]:
        step[state] = (cost, text)


_EDGE = re.compile(r"^[^\w@$!|+(€£¡*#]+|[^\w@$|+(€£*#]+$")
_TAIL = re.compile(r"([@$!|+(€£¡*#%&=])\1+$|^([@$!|+(€£¡*#%&=])\2+")
_MIXED = re.compile(r"[^\W\d_]")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")


def token_parts(token: str) -> tuple[str, str, tuple[tuple[str, bool], ...]]:
    """What a lower-case token is: ``("single", sign, ())`` for one letter or sign of ``LEET``, ``("spacer", "", ())`` for
    spacers alone, or ``("word", "", parts)`` with each part and whether it has to be decoded."""
    core = _TAIL.sub("", _EDGE.sub("", token))
    if len(core) == 1 and (core.isalpha() or core in LEET):
        return "single", core, ()
    if not core and all(c in SPACERS for c in token):
        return "spacer", "", ()
    if core.isalpha() and not _TRIPLE.search(core):
        return "word", "", ((core, False),)
    if len(core) > 1 and _MIXED.search(core):
        parts = core.split("-") if "-" in core else [core]
        if all(len(p) > 1 for p in parts):  # words that a hyphen joins are words of their own
            return "word", "", tuple((p, not p.isalpha() or bool(_TRIPLE.search(p))) for p in parts)
        return "word", "", ((core, True),)
    return "word", "", ((core, False),)


def restored(text: str, decode, parts_of=token_parts) -> str:
    """The lower-cased text with its disguised tokens restored by ``decode``. Letters and signs that stand alone, three
    or more in a row with white space or spacers between them, are one token."""
    out: list[str] = []
    single: list[str] = []

    def flush() -> None:
        if len(single) >= 3:
            out.append(decode("".join(single)))
        else:
            out.extend(single)
        single.clear()

    for token in text.lower().split():
        kind, sign, parts = parts_of(token)
        if kind == "single":
            single.append(sign)
        elif kind == "word":
            if single:
                flush()
            for part, disguised in parts:
                out.append(decode(part) if disguised else part)
    flush()
    return " ".join(out)


def looks_disguised(text: str) -> bool:
    """Whether ``restored`` has anything of a text decoded."""
    seen: list[str] = []
    restored(text, lambda token: seen.append(token) or token)
    return bool(seen)


# --- features --------------------------------------------------------------------------------------------------------


def _byte_kinds() -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte of lower-case UTF-8 belongs to a word, and its random value."""
    word = np.zeros(256, dtype=bool)
    word[ord("a") : ord("z") + 1] = True
    word[128:] = True
    return word, mix64(np.arange(256, dtype=np.uint64) + np.uint64(5000))


def word_features(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes ``[words, 1 + stems]`` of each word and of its beginnings (0 where it is no longer than that), and where
    each text's words begin. Words are runs of letters."""
    word, values = _byte_kinds()
    data = np.frombuffer(b" ".join(encoded) + b" ", dtype=np.uint8)
    at = np.flatnonzero(word[data])
    ends = np.cumsum(np.fromiter((len(b) + 1 for b in encoded), dtype=np.int64, count=len(encoded)))
    if not len(at):
        return np.zeros((0, 1 + len(STEMS)), dtype=np.uint64), np.zeros(len(encoded) + 1, dtype=np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(first, append=len(at))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(lengths.max()), np.uint64(0x2545F4914F6CDD1D), dtype=np.uint64))
        inside = np.arange(len(at)) - np.repeat(first, lengths)
        value = values[data[at]] * power[inside]
        out = [mix64(np.add.reduceat(value, first))]
        for n in STEMS:
            stem = mix64(np.add.reduceat(np.where(inside < n, value, np.uint64(0)), first) + _STEM_SALT * np.uint64(n))
            out.append(np.where(lengths > n, stem, np.uint64(0)))
    return np.stack(out, axis=1), np.concatenate(([0], np.searchsorted(at[first], ends))).astype(np.int64)


@dataclass
class Lexicon:
    """Weights of 64-bit features: sorted, behind a bitmap of their first bits that rules out nearly all words."""

    keys: np.ndarray
    weights: np.ndarray
    bitmap: np.ndarray

    @staticmethod
    def build(features: np.ndarray, weights: np.ndarray) -> Lexicon:
        order = np.argsort(features)
        bitmap = np.zeros(1 << 20, dtype=bool)
        bitmap[(features >> np.uint64(44)).astype(np.int64)] = True
        return Lexicon(features[order], weights[order].astype(np.float32), bitmap)

    def word_weights(self, features: np.ndarray) -> np.ndarray:
        """The largest weight among each word's features, 0 for words without any."""
        out = np.zeros(features.shape, dtype=np.float32)
        maybe = np.nonzero(self.bitmap[(features >> np.uint64(44)).astype(np.int64)])
        if len(self.keys) and len(maybe[0]):
            found = features[maybe]
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            out[maybe] = np.where((self.keys[at] == found) & (found != 0), self.weights[at], 0)
        return out.max(axis=1, initial=0)


def text_inputs(encoded: list[bytes], lexicon: Lexicon) -> np.ndarray:
    """What the regression sees of each text: kinds and number of lexicon words, their weights, share and length."""
    features, first = word_features(encoded)
    weight = lexicon.word_weights(features)
    hit = np.flatnonzero(weight > 0)
    owner = np.searchsorted(first, hit, "right") - 1
    out = np.zeros((len(encoded), 7))
    for text, lo, hi in zip(*_runs(owner), strict=True):
        kinds, at = np.unique(features[hit[lo:hi], 0], return_index=True)
        w = np.sort(weight[hit[lo:hi]][at])[::-1]
        words = first[text + 1] - first[text]
        out[text] = (len(kinds) >= 1, len(kinds) >= 2, w[0], w[1] if len(w) > 1 else 0.0, math.log1p(w.sum()), math.log1p(hi - lo), (hi - lo) / words)
    return out


def _runs(owner: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    return owner[starts].tolist(), starts.tolist(), np.append(starts[1:], len(owner)).tolist() if len(owner) else []


# --- the model -------------------------------------------------------------------------------------------------------


@dataclass
class ToxicityModel:
    costs: np.ndarray
    lexicon: Lexicon
    coefficients: np.ndarray
    scale: np.ndarray
    intercept: float

    def scores(self, inputs: np.ndarray) -> np.ndarray:
        z = inputs / self.scale @ self.coefficients + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _restored_batch(texts: list[str | None], costs: np.ndarray) -> list[bytes]:
    """The restored text of each, as UTF-8. Every text is restored: no test on its characters comes before."""
    decode = lru_cache(maxsize=50_000)(lambda token: restore_token(token, costs))
    parts_of = lru_cache(maxsize=200_000)(token_parts)
    return [restored(t if isinstance(t, str) else "", decode, parts_of).encode("utf-8", "surrogatepass") for t in texts]


def _restored_parts(texts: list[str | None], costs: np.ndarray) -> Iterator[list[bytes]]:
    """The restored texts as UTF-8, some at a time, so that a task never holds the features of a whole batch."""
    for lo in range(0, len(texts), SLICE):
        yield from byte_groups(_restored_batch(texts[lo : lo + SLICE], costs), SLICE_BYTES)


def _inputs_of(texts: list[str | None], costs: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """What the regression sees of each text."""
    return np.concatenate([np.zeros((0, 7)), *(text_inputs(part, lexicon) for part in _restored_parts(texts, costs))])


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; returns (coefficients, intercept)."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge * max(len(x), 1))
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + penalty * w
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """``(text, toxic)`` of at most ``rows`` labelled documents that aren't held out, checkpointed.

    Labels without an id or value are not used; a document with several labels is toxic if one says so. Of the rows that
    share an id one text is taken, the one with the smallest hash.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(rows)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    # The limit bounds the broadcast side: an id and a bit for each of `rows` labels.
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id")
    one = found.agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    return cut_lineage(one.select("text", (F.col("toxic") > 0).alias("toxic")))


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> ToxicityModel:
    """Count the character model over all of ``docs`` and fit lexicon and regression on a bounded training sample."""
    costs = trigram_costs(count_trigrams(docs))
    sample = training_sample(docs, labels, rows)

    def presence(only: np.ndarray | None):
        """How many toxic and clean texts have each feature (of ``only``, if given), per task."""

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for toxic, part in batch.groupby("toxic"):
                    for encoded in _restored_parts(part["text"].tolist(), costs):
                        features, first = word_features(encoded)
                        owner = np.repeat(np.arange(len(encoded)), np.diff(first))
                        kept = features != 0
                        if only is not None:
                            kept &= np.isin(features, only)
                        one = np.unique(np.column_stack([np.broadcast_to(owner[:, None], features.shape)[kept].astype(np.uint64), features[kept]]), axis=0)
                        f, n = np.unique(one[:, 1], return_counts=True)
                        yield pd.DataFrame({"feature": f.view(np.int64), "toxic": bool(toxic), "n": n})

        return count

    schema = "feature long, toxic boolean, n long"
    toxic = sample.where("toxic").mapInPandas(presence(None), schema).groupBy("feature").agg(F.sum("n").alias("n"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    # Features of at least three toxic texts; the sample's size bounds them.
    rows1 = toxic.where("n >= 3").toPandas()
    features = np.sort(rows1["feature"].to_numpy(np.int64).view(np.uint64))
    count1 = rows1.set_index("feature")["n"]
    rows0 = sample.where("not toxic").mapInPandas(presence(features), schema).groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    table = pd.DataFrame({"n1": count1, "n0": rows0.set_index("feature")["n"]}).fillna(0) if len(rows1) else pd.DataFrame({"n1": [], "n0": []})
    share1, share0 = (table["n1"] + 0.1) / (n1 + 1), (table["n0"] + 0.5) / (n0 + 1)
    weight = np.log(share1 / share0)
    telling = table["n1"] * weight
    # A feature of the lexicon says "toxic" more often than not, and far more often than chance.
    chosen = telling[(weight > 2.0) & (table["n1"] > table["n0"])].nlargest(LEXICON).index
    lexicon = Lexicon.build(np.array(chosen, dtype=np.int64).view(np.uint64), weight[chosen].to_numpy())

    def inputs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _inputs_of(batch["text"].tolist(), costs, lexicon)
            yield pd.DataFrame({"x": list(x), "toxic": batch["toxic"].to_numpy()})

    seen = sample.mapInPandas(inputs, "x array<double>, toxic boolean").toPandas()
    x = np.array(seen["x"].tolist(), dtype=np.float64).reshape(len(seen), -1) if len(seen) else np.zeros((0, 7))
    scale = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(7)
    coefficients, intercept = _fit_logistic(x / scale, seen["toxic"].to_numpy(np.float64) if len(seen) else np.zeros(0))
    return ToxicityModel(costs, lexicon, coefficients, scale, intercept)


def toxicity_score(model: ToxicityModel):
    """A Column function: the probability (0 to 1) that a whole text is toxic; NULL and empty texts get one too."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        values = texts.tolist()
        for lo in range(0, len(values), SLICE):
            out[lo : lo + SLICE] = model.scores(_inputs_of(values[lo : lo + SLICE], model.costs, model.lexicon))
        return pd.Series(out)

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    NULL text: scored as empty. Repeated and NULL ids are scored row by row. Without labels, or with labels of one
    kind, all texts get the base rate. An empty table gives an empty result; extra columns are not read.
    """
    score = toxicity_score(fit_toxicity(docs, labels))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text scores below ``threshold``."""
    score = toxicity_score(fit_toxicity(docs, labels))
    return docs.where(score(F.col("text")) < threshold)
