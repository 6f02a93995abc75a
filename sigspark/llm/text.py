"""Vectorised word and shingle hashing over Arrow text columns.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lowered.
All functions work on the UTF-8 buffer of a whole Arrow column at once, so no
Python string is made per word.  Work goes chunk by chunk (``row_chunks``), so
the temporaries stay near ``CHUNK_BYTES`` x 60 whatever the batch holds; one
document longer than a chunk is a chunk of its own, never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)
_G = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` seeded 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20)) * _G)


_multipliers = stream(256, 11) | np.uint64(1)


def multipliers(n: int) -> np.ndarray:
    global _multipliers
    if n > len(_multipliers):
        _multipliers = stream(max(n, 2 * len(_multipliers)), 11) | np.uint64(1)
    return _multipliers


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a text column; a null row has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offs


def row_chunks(offs: np.ndarray, limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes and ``rows`` rows at most, at least one row each."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n, lo + rows)
        yield lo, hi
        lo = hi


class Words:
    """Words of rows ``lo..hi``: hash, byte span in the buffer, and per-row word ranges."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lo: int, hi: int, space: np.ndarray = SPACE, fold: np.ndarray = LOWER):
        self.fold = fold  # what each byte counts as in a hash
        base, end = int(offs[lo]), int(offs[hi])
        self.base, self.bytes = base, data[base:end]
        self.rows = hi - lo
        rel = offs[lo : hi + 1] - base
        solid = ~space[self.bytes]
        edge = np.zeros(len(solid) + 1, bool)  # a row begins here
        edge[rel] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:-1]
        self.start = np.flatnonzero(first)
        self.stop = np.flatnonzero(last) + 1
        self.first_word = np.searchsorted(self.start, rel)  # word range of row r: first_word[r] .. first_word[r + 1]
        self.n_words = np.diff(self.first_word)
        self.lens = self.stop - self.start
        self._solid = solid
        self._prod = None

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, lower-cased."""
        if not len(self):
            return np.zeros(0, np.uint64)
        at, _, prod = self._products()
        with np.errstate(over="ignore"):
            return mix(np.add.reduceat(prod, at) + self.lens.astype(np.uint64) * _G)

    def prefix_hashes(self, k: int) -> np.ndarray:
        """Hash of the first ``k`` bytes of each word (of the whole word, where it is shorter)."""
        if not len(self):
            return np.zeros(0, np.uint64)
        at, pos, prod = self._products()
        with np.errstate(over="ignore"):
            return mix(np.add.reduceat(np.where(pos < k, prod, np.uint64(0)), at) + np.uint64(k))

    def proper_prefixes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(words of more than ``k`` bytes, hash of the first ``k`` bytes of each)."""
        longer = np.flatnonzero(self.lens > k)
        if not len(longer):
            return longer, np.zeros(0, np.uint64)
        at, _, prod = self._products()
        with np.errstate(over="ignore"):
            return longer, mix(prod[at[longer][:, None] + np.arange(k)].sum(1, dtype=np.uint64) + np.uint64(k))

    def _products(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._prod is None:
            chars = self.fold[self.bytes[self._solid]]
            at = np.cumsum(self.lens) - self.lens
            pos = np.arange(len(chars)) - np.repeat(at, self.lens)
            with np.errstate(over="ignore"):
                self._prod = at, pos, multipliers(int(self.lens.max()))[pos] * (chars.astype(np.uint64) + np.uint64(1))
        return self._prod


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, by its first word (length len(h) - k + 1; rows are not yet told apart)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mult = stream(k, 23) | np.uint64(1)
    with np.errstate(over="ignore"):
        out = h[:n] * mult[0]
        for j in range(1, k):
            out += h[j : j + n] * mult[j]
    return mix(out)


def sequence_hash(h: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence, apart from any shingle's."""
    with np.errstate(over="ignore"):
        return mix(np.array([np.sum(h * (stream(len(h), 29) | np.uint64(1))) + np.uint64(len(h)) * _G], np.uint64))[0]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
