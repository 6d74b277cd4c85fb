"""Words of many texts as 64-bit hashes, with numpy over the bytes of a whole batch (runs in Python workers)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x2545F4914F6CDD1D)
CHUNK_BYTES = 1 << 21


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    return mix64(np.arange(256, dtype=np.uint64) + np.uint64(1000))


def _separators() -> np.ndarray:
    sep = np.zeros(256, dtype=bool)
    sep[[0x20, *range(0x09, 0x0E)]] = True
    return sep


def chunks(texts: list[str | None], lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 of some texts), each chunk of about ``limit`` bytes; a longer text stands alone."""
    first, part, size = 0, [], 0
    for i, t in enumerate(texts):
        b = ((t.lower() if lower else t) if t else "").encode("utf-8", "surrogatepass")
        if part and size + len(b) > limit:
            yield first, part
            first, part, size = i, [], 0
        part.append(b)
        size += len(b)
    if part:
        yield first, part


def byte_groups(encoded: Iterable[bytes], limit: int) -> Iterator[list[bytes]]:
    """Consecutive ones of about ``limit`` bytes together; a longer one stands alone."""
    part, size = [], 0
    for b in encoded:
        if part and size + len(b) > limit:
            yield part
            part, size = [], 0
        part.append(b)
        size += len(b)
    if part:
        yield part


def word_hashes(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one entry more than texts)."""
    data = np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)
    at = np.flatnonzero(~_separators()[data])
    ends = np.cumsum(np.fromiter((len(b) + 1 for b in encoded), dtype=np.int64, count=len(encoded)))
    if not len(at):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(encoded) + 1, dtype=np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(first, append=len(at))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(lengths.max()), _BASE, dtype=np.uint64))
        inside = np.arange(len(at)) - np.repeat(first, lengths)
        hashes = mix64(np.add.reduceat(_byte_values()[data[at]] * power[inside], first) + lengths.astype(np.uint64))
    return hashes, np.concatenate(([0], np.searchsorted(at[first], ends))).astype(np.int64)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (positions run on over texts; the caller masks the seams)."""
    count = max(len(words) - n + 1, 0)
    out = np.zeros(count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * _BASE + words[i : i + count]
    return mix64(out)
