"""Vectorised word hashing over the bytes of an Arrow string column.

A word's hash is a polynomial in seeded random byte values modulo 2**64, read off one running
sum for a whole batch and then mixed; no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import slices, utf8

#: Bytes hashed at a time; longer texts are cut at a separator.
PIECE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are runs of anything but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of ASCII letters, digits and bytes of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Words:
    """Words of rows lo..hi: ``row`` counts from lo, ``key`` is the 64-bit hash."""

    lo: int
    hi: int
    row: np.ndarray
    key: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = PIECE + (PIECE >> 2)
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
    return values[LOWER], powers, np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, up, down = _tables()
    if n < len(up):
        return values, up, down
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    more = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b)]), dtype=np.uint64)
    return values, more(_BASE), more(inverse)


def _spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word; rows begin at ``starts`` and end at ``ends``."""
    inside = word[raw]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[starts] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[ends - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _hashes(raw: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    values, up, down = _powers(len(raw))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values[raw] * up[: len(raw)], dtype=np.uint64, out=total[1:])
    return mix((total[end] - total[at]) * down[at] + (end - at).astype(np.uint64))


def _long(raw: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of one long row, hashed piece by piece; a piece ends at a separator."""
    out, lo = [], 0
    while lo < len(raw):
        hi = lo + PIECE
        if hi < len(raw):
            gaps = np.flatnonzero(~word[raw[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(~word[raw[hi:]])
                hi = hi + int(rest[0]) + 1 if len(rest) else len(raw)
        part = raw[lo:hi]
        at, end = _spans(part, np.array([0]), np.array([len(part)]), word)
        out.append(_hashes(part, at, end))
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def hashed_words(column: pa.Array, word: np.ndarray) -> Iterator[Words]:
    """Word hashes of every row, A-Z lower-cased, in row ranges of bounded bytes."""
    raw, offsets = utf8(column)
    for lo, hi in slices(offsets, PIECE):
        part = raw[offsets[lo] : offsets[hi]]
        if len(part) == 0:
            yield Words(lo, hi, np.zeros(0, np.int64), np.zeros(0, np.uint64))
        elif len(part) > PIECE:
            key = _long(part, word)
            yield Words(lo, hi, np.zeros(len(key), np.int64), key)
        else:
            begin = offsets[lo : hi + 1] - offsets[lo]
            full = begin[1:] > begin[:-1]
            at, end = _spans(part, begin[:-1][full], begin[1:][full], word)
            yield Words(lo, hi, np.searchsorted(begin[1:], at, "right"), _hashes(part, at, end))
