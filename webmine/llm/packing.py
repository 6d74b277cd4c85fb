"""Best-fit packing of tokenised documents by best-two-fit.

Only the lengths of documents matter for the packing, and there are at most ``capacity`` of them. So the packing is
decided on the histogram of lengths (a table whose size the data cannot change), as a list of bin patterns with the
number of bins of each; then every piece finds its place from its rank among the pieces of its length. Ranks are
counted in hash buckets, so no task holds all pieces of a length.

A bin is filled greedily: the longest piece that is left, then again and again the longest that fits. Then, as long as
a gap remains, its smallest piece is taken out and replaced by the two unpacked pieces that together fill the grown
gap best, if that is tighter. As greedy choices depend only on which lengths are left, the same pattern repeats until
one of its lengths runs short.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import hash_bucket, process_cache, rank_in_group

CAPACITY = 2048
#: Ends each document.
END_ID = 0
#: White space from this length on is cut out before the split pattern runs.
LONG_RUN = 100_000


def byte_bpe(path: str, pattern: str, added: dict[str, int]):
    """The byte-level BPE of a rank file (base64 token, rank) with some added tokens, as tiktoken runs it."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def default_vocabulary() -> tuple[str, str, dict[str, int]]:
    """Path, split pattern and added tokens of the byte-level BPE with 50,257 ids (the ids of ``byte_bpe_50k.json``)."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added


#: White space as the split pattern understands it.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def token_ids(bpe, text: str, added: dict[str, int]) -> list[int]:
    """The ids of a text, with its literal added tokens as their own ids.

    The split pattern can't take very long runs of white space (its engine's stack ends), so they are cut out. By the
    pattern a run is one piece but for its last character, which goes with what follows, or a whole piece at the end.
    """
    if len(text) < LONG_RUN or not any(m.end() - m.start() >= LONG_RUN for m in re.finditer(_SPACE, text)):
        holds = any(t in text for t in added)
        return bpe.encode(text, allowed_special="all", disallowed_special=()) if holds else bpe.encode_ordinary(text)
    ids: list[int] = []
    for part in re.split("(" + "|".join(map(re.escape, added)) + ")", text) if added else [text]:
        if part in added:
            ids.append(added[part])
            continue
        at = 0
        for m in re.finditer(_SPACE, part):
            if m.end() - m.start() >= LONG_RUN:
                end = m.end() if m.end() == len(part) else m.end() - 1
                ids += bpe.encode_ordinary(part[at : m.start()]) + bpe._encode_single_piece(part[m.start() : end])
                at = end
        ids += bpe.encode_ordinary(part[at:])
    return ids


def tokenized_pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: tuple[str, str, dict[str, int]] | None = None, with_ids: bool = False
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: the documents' ids, each ended by id 0, in pieces.

    Documents of more than ``capacity`` ids are cut into pieces of that length, of which the first may be shorter.
    ``ids``: little-endian unsigned 32-bit ids. Added tokens of the vocabulary that a text holds literally
    are cut out and have their own ids, as in ``tokenizers``.
    NULL text: as empty (the id 0 alone). NULL and repeated doc_ids are kept as they are.
    """
    path, pattern, added = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = process_cache(f"bpe:{path}:{pattern}:{sorted(added.items())}", lambda: byte_bpe(path, pattern, added))
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text if isinstance(text, str) else ""
                ids = np.asarray([*token_ids(bpe, text, added), END_ID], dtype="<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids), capacity), len(ids)]
                for k in range(len(cuts) - 1):
                    part = ids[cuts[k] : cuts[k + 1]].tobytes()
                    row = (doc_id, k, cuts[k], cuts[k + 1] - cuts[k], zlib.crc32(part))
                    out.append((*row, part) if with_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            frame = pd.DataFrame(out, columns=names)
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, schema)


def bin_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """([length -> pieces in a bin], number of such bins), best-two-fit over the histogram {length: count}."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)

    def largest(limit: int, left: np.ndarray) -> int:
        """Index of the largest length up to ``limit`` of which some are left, or -1."""
        at = np.flatnonzero(left[: int(np.searchsorted(lengths, limit, "right"))] > 0)
        return int(at[-1]) if len(at) else -1

    def best_two(limit: int, left: np.ndarray) -> tuple[int, int, int]:
        """(sum, index, index) of the two unpacked pieces with the largest sum up to ``limit``."""
        at = np.flatnonzero(left > 0)
        at = at[lengths[at] < limit]
        if not len(at):
            return 0, -1, -1
        partner = np.searchsorted(lengths[at], limit - lengths[at], "right") - 1
        same = (partner >= 0) & (at[partner] == at) & (left[at] < 2)
        partner = np.where(same, partner - 1, partner)
        total = np.where(partner >= 0, lengths[at] + lengths[at[np.maximum(partner, 0)]], 0)
        k = int(np.argmax(total))
        return (int(total[k]), int(at[k]), int(at[partner[k]])) if total[k] else (0, -1, -1)

    out: list[tuple[dict[int, int], int]] = []
    while (first := largest(capacity, counts)) >= 0:
        left, bin_, gap = counts.copy(), [], capacity
        while (k := first if not bin_ else largest(gap, left)) >= 0:
            bin_.append(k)
            left[k] -= 1
            gap -= int(lengths[k])
            if not gap:
                break
        while gap:
            small = min(bin_)
            total, a, b = best_two(gap + int(lengths[small]), left)
            if total <= lengths[small]:
                break
            bin_.remove(small)
            left[small] += 1
            left[[a]] -= 1
            left[[b]] -= 1
            bin_ += [a, b]
            gap += int(lengths[small]) - total
        used = Counter(bin_)
        times = min(int(counts[k]) // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= n * times
        out.append(({int(lengths[k]): n for k, n in sorted(used.items(), reverse=True)}, times))
    return out


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, with ``doc_id, piece, start, length, ids_crc32``) plus ``sequence_id`` and ``offset``.

    Sequences hold at most ``capacity`` tokens, gapless from offset 0. Ties (equal lengths) go by md5 bucket, doc_id,
    piece. The rows must be the same at each reading (checkpoint them first).
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece"), F.col("ids_crc32"))
    rows = pieces.withColumn("__bucket", hash_bucket(F.md5(key)))
    ranked = rank_in_group(rows, "length", "__bucket", [F.col("doc_id").asc_nulls_last(), "piece", "ids_crc32"], "__rank")
    # At most `capacity` rows come to the driver, however large the data is.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    uses, bins, used = [], 0, Counter()
    for pattern, times in bin_patterns(histogram, capacity):
        at = 0
        for length, n in pattern.items():
            uses.append((length, used[length], n, bins, at))
            used[length] += n * times
            at += length * n
        bins += times
    uses.sort()
    lengths, firsts, ns, starts, ats = (np.array(x, dtype=np.int64) for x in (zip(*uses) if uses else [()] * 5))
    # One number orders (length, rank): lengths are at most `capacity`, ranks are below 2^48.
    keys = (lengths << 48) + firsts

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        k = np.searchsorted(keys, (size << 48) + r, "right") - 1
        inside = r - firsts[k]
        return pd.DataFrame({"sequence_id": starts[k] + inside // ns[k], "offset": ats[k] + inside % ns[k] * size})

    placed = ranked.withColumn("__place", place("length", "__rank"))
    return placed.select(*pieces.columns, "__place.sequence_id", "__place.offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: tuple[str, str, dict[str, int]] | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``: where each piece of each document lies.

    Empty tables give an empty result; NULL texts are documents of one token. Extra columns are not read. Tokens are
    made once; only narrow rows are checkpointed, ranked and placed. Ids to fill the sequences with come from
    ``tokenized_pieces(with_ids=True)`` joined on (doc_id, piece, ids_crc32).
    """
    return place_pieces(cut_lineage(tokenized_pieces(docs, capacity, vocabulary)), capacity)
