"""Vectorised features of raw UTF-8 bytes, for the operators that run numpy in workers."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: An odd multiplier and its inverse modulo 2^64.
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    if n:
        out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


class _Tables:
    """Powers of the multiplier and its inverse, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << max(16, (n - 1).bit_length())
            self.up, self.down = _powers(n, _MUL), _powers(n, _INV)
        return self.up, self.down


_tables = _Tables()


def words(view, offsets: list[int], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows in order, and the n + 1 bounds of the rows among them.

    A word is a run of bytes other than 0x20 and 0x09 to 0x0D; A-Z count as a-z. A word's hash is a
    polynomial in its bytes modulo 2^64 (from prefix sums, whatever its place), mixed; equal words
    have equal hashes.
    """
    data = np.frombuffer(view, dtype=np.uint8)
    bounds = np.asarray(offsets, dtype=np.int64)
    if not len(data):
        return np.empty(0, dtype=np.uint64), np.zeros(len(bounds), dtype=np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = _tables.get(len(data) + 1)
    terms = (_LOWER[data] if lower else data).astype(np.uint64)
    terms += np.uint64(1)
    terms *= up[: len(data)]
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(terms, out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, bounds)


def shape_of(data: np.ndarray, word_hashes: np.ndarray) -> np.ndarray:
    """Shares that tell prose from junk: upper case, digits, symbols, bars, lines, distinct words, the commonest word, immediate repeats."""
    n = max(1, len(data))
    counts = np.bincount(data, minlength=256)
    upper, digits = counts[65:91].sum(), counts[48:58].sum()
    letters = counts[97:123].sum() + counts[128:].sum()
    symbols = n - upper - digits - letters - counts[[32, 9, 10, 11, 12, 13]].sum() - counts[[44, 46, 39, 45]].sum()
    w = max(1, len(word_hashes))
    _, per = np.unique(word_hashes, return_counts=True)
    most = per.max() if len(per) else 0
    repeats = int((word_hashes[1:] == word_hashes[:-1]).sum())
    return np.array([upper / n, digits / n, symbols / n, counts[124] / n, counts[10] / n, len(per) / w, most / w, repeats / w], dtype=np.float32)


SHAPES = 8
