"""Words of UTF-8 byte buffers in numpy: where they are, 64-bit hashes of words and of word runs.

All word classes used here are decided by single bytes (bytes from 0x80 always belong to words or
always to letters), so no decoding is needed. Hashes are a polynomial over random byte values modulo
2**64, finished by a 64-bit mix with the length; buffers are worked through in pieces of bounded size.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 18
MULT = 0x9E3779B97F4A7C15 | 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words parted by ASCII white space: [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Words of letters and digits, for lower-cased text: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

BYTE_VALUES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Tokenizer:
    """Word spans and hashes of row buffers, for one word class, lower-casing A-Z or not."""

    def __init__(self, is_word: np.ndarray, lower: bool):
        self.is_word, self.lower = is_word, lower
        self.values = BYTE_VALUES[LOWER] if lower else BYTE_VALUES
        self.cached = (powers(1, MULT), powers(1, MULT))

    def _powers(self, n: int):
        if len(self.cached[0]) < n:
            self.cached = (powers(n, MULT), powers(n, pow(MULT, -1, 2**64)))
        return self.cached

    def spans(self, data: np.ndarray, offsets: np.ndarray):
        """Byte starts and ends of all words, in order; no word crosses a row."""
        w = (self.is_word[LOWER] if self.lower else self.is_word)[data]
        if not len(w):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = w.copy()
        first[1:] &= ~w[:-1]
        edges = offsets[(offsets > 0) & (offsets < len(w))]
        first[edges] = w[edges]
        last = w.copy()
        last[:-1] &= ~w[1:]
        last[edges - 1] = w[edges - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte spans, which are in order and do not overlap."""
        out = np.empty(len(starts), np.uint64)
        i, n = 0, len(starts)
        while i < n:
            base = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, base + PIECE, "right")))
            s, e = starts[i:j] - base, ends[i:j] - base
            size = int(e[-1])
            up, down = self._powers(max(size, 1))
            run = np.zeros(size + 1, np.uint64)
            np.cumsum(self.values[data[base:base + size]] * up[:size], out=run[1:])
            out[i:j] = (run[e] - run[s]) * down[s]
            i = j
        return mix(out ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    def words(self, data: np.ndarray, offsets: np.ndarray):
        """(row, start, end, hash) of all words, and the first word number of every row (n + 1 values)."""
        starts, ends = self.spans(data, offsets)
        bounds = np.searchsorted(starts, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        return row, starts, ends, self.hashes(data, starts, ends), bounds


FACTORS = [pow(0xC2B2AE3D27D4EB4F, k + 1, 2**64) | 1 for k in range(64)]


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words (rows not regarded): len - k + 1 values, or none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j:j + n] * np.uint64(FACTORS[j])
    return mix(out + np.uint64(k))


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] values), first[1], ..."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Remembered:
    """Id lists of byte spans by their hash; of at most ``limit`` distinct spans at a time."""

    def __init__(self, encode, limit: int = 300_000):
        self.encode, self.limit = encode, limit
        self.row: dict[int, int] = {}
        self.ids, self.size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]

    def look_up(self, data, starts, ends, hashes):
        """(ids of all spans one after another, number of ids of each). ``encode(data, starts, ends)`` gives both for new ones."""
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.row) + len(unique) > self.limit:
            self.row, self.ids, self.size = {}, [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        rows = np.fromiter((self.row.get(u, -1) for u in unique.tolist()), np.int64, len(unique))
        new = np.flatnonzero(rows < 0)
        if len(new):
            ids, size = self.encode(data, starts[first[new]], ends[first[new]])
            rows[new] = np.arange(len(self.row), len(self.row) + len(new))
            self.row.update(zip(unique[new].tolist(), rows[new].tolist(), strict=True))
            self.ids, self.size = [np.concatenate([*self.ids, ids])], [np.concatenate([*self.size, size])]
        begin = (np.cumsum(self.size[0]) - self.size[0])[rows][which]
        size = self.size[0][rows][which]
        return self.ids[0][ranges(begin, size)], size
