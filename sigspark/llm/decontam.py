"""Benchmark decontamination by SimHash over item-sized windows.

Every benchmark item of L words gets a window size of about SIZE x L words, from
a geometric series, so that a few sizes serve all items.  All windows of that
size inside the item are fingerprinted (SimHash of the window's words, BITS
bits).  In a document, windows of the size are taken at a stride that is at
most L - size + 1 for every item of that size, so wherever a document holds an
item, one of its windows equals one of the item's.

Fingerprints are compared through a multi-index (Norouzi, Punjani, Fleet: "Fast search in
Hamming space with multi-index hashing", 2012): BITS bits are cut into blocks; within
RADIUS bits of each other, two fingerprints differ by at most RADIUS div BLOCKS bits in
some block, so looking up every block with that many flipped bits finds all
fingerprints within RADIUS.

A pair found is verified exactly: the item against the words of the document
at that place, by the weighted similarity of their five-word shingles (sum of
the smaller counts over the sum of the larger), the best of a few shifts.

The documents are read once and nothing is shuffled.  The item index travels
to the executors; it is made of MAX_ITEMS items at most, and a larger benchmark
is searched in several passes.

Defined results: items without words match nothing; an item of fewer words than a
shingle has its whole sequence as its one shingle; null and empty documents
match nothing; items with equal text are all reported; repeated rows are
reported row by row; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, buffers, row_chunks, sequence_hash, shingles

#: Words of a shingle; least similarity; items of a pass.
WORDS, LEAST, MAX_ITEMS = 5, 0.8, 20_000
#: Fingerprint bits, blocks of the index, radius; window size as a share of the item, ratio of the sizes.
BITS, BLOCKS, RADIUS, SIZE, RATIO = 64, 4, 7, 0.7, 1.25
#: Bytes of text worked on at once, and shifts of a found passage that are tried.
CHUNK, SHIFTS = 1 << 18, (0, -1, 1, -2, 2)


def window_size(n: int) -> int:
    """The largest size of the series that is at most SIZE x n words (n itself up to four words)."""
    if n <= 4:
        return n
    size, x = 1, 1.0
    while int(x) <= SIZE * n:
        size, x = int(x), x * RATIO
    return size


def one_bits(h: np.ndarray) -> np.ndarray:
    """(words + 1, BITS): ones among the bits of all words before each, modulo 2^16."""
    out = np.zeros((len(h) + 1, BITS), np.uint16)
    np.cumsum(np.unpackbits(h.view(np.uint8)).reshape(len(h), BITS), axis=0, dtype=np.uint16, out=out[1:])
    return out


def fingerprints(ones: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    return np.packbits((ones[start + size] - ones[start]) * 2 > size, axis=1).view(np.uint64)[:, 0] if len(start) else np.zeros(0, np.uint64)


def weights(h: np.ndarray) -> Counter:
    """Shingles of a word sequence with their counts."""
    s = shingles(h, WORDS) if len(h) >= WORDS else np.array([sequence_hash(h)])
    return Counter(s.tolist())


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class Index:
    """Item fingerprints by window size, each with a table from block values to fingerprints."""

    def __init__(self, ids: list[int], texts: pa.Array):
        data, offs = buffers(texts)
        self.ids, self.words = ids, []
        prints: dict[int, list[tuple[int, int, np.ndarray]]] = defaultdict(list)
        self.stride: dict[int, int] = {}
        for r in range(len(ids)):
            h = Words(data, offs, r, r + 1).hashes()
            self.words.append(h)
            if not len(h):
                continue
            size = window_size(len(h))
            at = np.arange(len(h) - size + 1)
            prints[size].append((r, size, fingerprints(one_bits(h), at, size)))
            self.stride[size] = min(self.stride.get(size, 1 << 30), len(at))
        self.shingles = [weights(h) if len(h) else Counter() for h in self.words]
        self.tables = {size: self._table(found) for size, found in prints.items()}

    @staticmethod
    def _table(found):
        """(fingerprint, item, offset) arrays and, for each block, first and last entry of each value and the entries."""
        fp = np.concatenate([f for _, _, f in found])
        item = np.concatenate([np.full(len(f), r) for r, _, f in found])
        offset = np.concatenate([np.arange(len(f)) for _, _, f in found])
        width = BITS // BLOCKS
        flips = [sum(1 << b for b in bits) for k in range(RADIUS // BLOCKS + 1) for bits in combinations(range(width), k)]
        blocks = []
        for k in range(BLOCKS):
            value = (fp >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
            keys = (value[:, None] ^ np.array(flips, np.uint64)[None]).astype(np.int64).ravel()
            order = np.argsort(keys, kind="stable")
            blocks.append((np.searchsorted(keys[order], np.arange((1 << width) + 1)).astype(np.int32), (order // len(flips)).astype(np.int32)))
        return fp, item, offset, blocks

    def lookup(self, size: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, offset) of all pairs within RADIUS."""
        own, item, offset, blocks = self.tables[size]
        width, out = BITS // BLOCKS, []
        for k, (first, entry) in enumerate(blocks):
            value = ((fp >> np.uint64(k * width)) & np.uint64((1 << width) - 1)).astype(np.int64)
            lo, n = first[value], first[value + 1] - first[value]
            hit = np.flatnonzero(n)
            lo, n = lo[hit], n[hit]
            window = np.repeat(hit, n)
            e = entry[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(window))]
            near = np.bitwise_count(fp[window] ^ own[e]) <= RADIUS
            out.append((window[near].astype(np.int64) << 32) | e[near])
        pairs = np.unique(np.concatenate(out))
        e = pairs & 0xFFFFFFFF
        return pairs >> 32, item[e], offset[e]

    def search(self, data: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> dict[tuple[int, int], dict[int, float]]:
        """{(row, item): {first word: similarity}} of verified passages in rows lo..hi."""
        w = Words(data, offs, lo, hi)
        if not len(w):
            return {}
        h = w.hashes()
        ones = one_bits(h)
        row = np.repeat(np.arange(w.rows), w.n_words)
        place, end = np.arange(len(h)) - w.first_word[row], w.first_word[row + 1]
        found: dict[tuple[int, int], dict[int, float]] = defaultdict(dict)
        tried = set()
        for size, stride in self.stride.items():
            start = np.flatnonzero((place % stride == 0) & (np.arange(len(h)) + size <= end))
            for window, item, offset in zip(*self.lookup(size, fingerprints(ones, start, size)), strict=True):
                r = row[start[window]]
                at, a, z = int(start[window] - offset), int(w.first_word[r]), int(w.first_word[r + 1])
                if (at, int(item)) in tried:
                    continue
                tried.add((at, int(item)))
                n, best = len(self.words[item]), (0.0, 0)
                for shift in SHIFTS:
                    p, q = max(a, at + shift), min(z, at + shift + n)
                    if p < q:
                        best = max(best, (similarity(self.shingles[item], weights(h[p:q])), a - p))
                    if best[0] == 1:
                        break
                if best[0] >= LEAST:
                    found[int(r) + lo, int(item)][-best[1]] = best[0]
        return found


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item found in it: id, item, first_word, n_passages, similarity (of the best)."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    n = items.count()
    passes = max(1, -(-n // MAX_ITEMS))
    schema = f"`{id_col}` long, `{item_col}` long, first_word long, n_passages long, similarity double"
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text).alias("t"))
    out = None
    for k in range(passes):
        part = items if passes == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k)
        table = part.orderBy("i", "t").toArrow()
        index = docs.sparkSession.sparkContext.broadcast(Index(table.column("i").to_pylist(), table.column("t")))
        found = rows.mapInArrow(_search(index, id_col, item_col), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _search(index, id_col: str, item_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = buffers(b.column(1))
            ids, out = b.column(0).to_pylist(), []
            for lo, hi in row_chunks(offs, CHUNK):
                for (row, item), places in index.value.search(data, offs, lo, hi).items():
                    best = max(places, key=lambda p: (places[p], -p))
                    out.append((ids[row], index.value.ids[item], best, len(places), places[best]))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[id_col, item_col, "first_word", "n_passages", "similarity"])

    return run
