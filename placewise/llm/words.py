"""Words of Arrow text columns as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5
_WORD_FACTORS = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def byte_set(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


WORD_BYTES = ~byte_set(WHITE)
LINE_BYTES = ~byte_set(b"\n")
SAME_CASE = np.arange(256, dtype=np.uint64)
LOWER_ASCII = SAME_CASE.copy()
LOWER_ASCII[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@dataclass
class Runs:
    """Words (or lines) of several texts: their hashes, byte ranges, and where each text's words begin."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the texts' offsets in them; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(column: pa.Array, inside: np.ndarray = WORD_BYTES, fold: np.ndarray = SAME_CASE) -> Runs:
    """Maximal runs of ``inside`` bytes within each text; ``fold`` maps bytes before they are hashed."""
    data, offsets = utf8(column)
    size, begin, found = len(data), 0, []
    while begin < size:
        end = min(begin + _PIECE, size)
        if end < size:  # cut where a run ends
            outside = np.flatnonzero(~inside[data[begin:end]])
            cuts = offsets[np.searchsorted(offsets, begin, "right") : np.searchsorted(offsets, end, "right")]
            last = max(begin + outside[-1] + 1 if len(outside) else begin, cuts[-1] if len(cuts) else begin)
            while last == begin and end < size:  # a run longer than a piece
                end = min(end + _PIECE, size)
                outside = np.flatnonzero(~inside[data[begin:end]])
                cuts = offsets[np.searchsorted(offsets, begin, "right") : np.searchsorted(offsets, end, "right")]
                last = min([begin + outside[0] + 1] * bool(len(outside)) + [cuts[0]] * bool(len(cuts)) or [begin])
            end = last if last > begin else end
        found.append(_runs(data[begin:end], offsets, begin, inside, fold))
        begin = end
    if found:
        hashes, starts, ends = (np.concatenate(x) for x in zip(*found))
    else:
        hashes, starts, ends = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return Runs(hashes, starts, ends, np.searchsorted(starts, offsets), data, offsets)


def _runs(data, offsets, begin, inside, fold):
    member = inside[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, begin + len(data), "right")] - begin] = True
    opens, closes = member.copy(), member.copy()
    opens[1:] &= ~member[:-1] | border[1:-1]
    closes[:-1] &= ~member[1:] | border[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _powers(_PIECE + 1 if len(data) <= _PIECE else 1 << (len(data) + 1).bit_length())
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((fold[data] + np.uint64(1)) * up[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_WORD_FACTORS[0]))
    return hashes, starts + begin, ends + begin


def shingles(words: Runs, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): all ``k``-word windows of each text in order; a text with fewer words is one window as a whole."""
    counts = words.counts
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], made)
    padded = np.concatenate([words.hashes, np.zeros(k, np.uint64)])
    value = np.zeros(len(at), np.uint64)
    for j in range(k):
        value += padded[at + j] * np.uint64(_WORD_FACTORS[j])
    for text in np.flatnonzero((counts < k) & (counts > 0)):  # short texts: only their own words
        own = words.hashes[words.first[text] : words.first[text + 1]]
        value[first[text]] = sum((int(h) * f for h, f in zip(own, _WORD_FACTORS)), len(own)) & (2**64 - 1)
    return mix(value), first
