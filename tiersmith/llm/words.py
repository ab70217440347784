"""Words of UTF-8 texts as 64-bit hashes, computed over the bytes of many rows at once.

Letters A-Z are lower-cased. A word is a longest run of bytes outside a set of
separators, all of them below 0x80, so that characters are never cut. Hashes of
different words agree with a chance of 2**-64 for each pair.
"""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Separators of the pattern ``[^\x20\x09-\x0D]+``.
BLANKS = np.zeros(256, bool)
BLANKS[[32, *range(9, 14)]] = True
#: Separators of the pattern ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, to be used after lower-casing.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_CYCLE = 4096
_POWERS = np.ones(_CYCLE, np.uint64)
_POWERS[1:] = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.multiply.accumulate(_POWERS)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_PIECE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_ranges(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word; ``data`` is lower-cased, words don't cross rows."""
    inside = ~separators[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < len(data)]
    opens[first] = inside[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    closes[last] = inside[last]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def hash_ranges(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range of bytes; the ranges are in order and don't overlap. Long inputs go in pieces."""
    out = np.empty(len(begins), np.uint64)
    lo = 0
    while lo < len(begins):
        hi = max(lo + 1, int(np.searchsorted(begins, begins[lo] + _PIECE)))
        start, size = begins[lo:hi], ends[lo:hi] - begins[lo:hi]
        offset = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(offset, size)
        raw = data[place + np.repeat(start, size)].astype(np.uint64) + np.uint64(1)
        weight = _POWERS[place & (_CYCLE - 1)]
        if int(size.max()) > _CYCLE:
            weight = weight + (place >> 12).astype(np.uint64) * _STEP
        out[lo:hi] = mix(np.add.reduceat(raw * weight, offset) ^ (size.astype(np.uint64) * _STEP))
        lo = hi
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the offsets of the rows in them."""
    low = LOWER[data]
    begins, ends = word_ranges(low, offsets, separators)
    return hash_ranges(low, begins, ends), np.searchsorted(begins, offsets)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of ``width`` neighbouring words; windows may cross rows, which callers sort out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(0x2545F4914F6CDD1D)
        out += hashes[k:k + n]
    return mix(out ^ np.uint64(width))
