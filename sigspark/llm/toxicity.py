"""Toxicity scores from a factorization machine over hashed terms.

Terms are the letter runs of a text, lower-cased, and the beginnings of four
to eight bytes of longer ones, hashed to 2^20 slots; a term that a text has twice or more
counts as a second term beside it.  A text is the set of its slots.  Besides
a weight, every slot has a short vector; the dot product of two slots' vectors
is the weight of meeting both in one text (an insult beside the mention of a
group), which a sum of single weights cannot tell.

The machine is fitted on the driver from a bounded sample of labelled rows
(MAX_POSITIVE and MAX_NEGATIVE, chosen by a hash of the id).  It keeps every slot whose
labels in the sample are less likely to be chance than CHANCE says; the weaker a slot's evidence, the
more its weight and vector are held back.  The model's size follows the sample, not the
corpus.  Scoring reads every whole text where it lies, without a shuffle.

Defined results: null and empty texts get the score of a text without any
term; without labelled rows of both kinds every score is the share of ones
(0 without any label).  Repeated rows are scored row by row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import fresh
from .text import Words, buffers, mix, row_chunks

#: Bounds on the labelled rows that the machine is fitted on, by label.
MAX_POSITIVE, MAX_NEGATIVE = 1500, 3000
#: Hash slots (as a power of two), bytes of the beginnings, least sample rows a slot needs, and length of the vectors.
SLOT_BITS, BEGINNINGS, LEAST_ROWS, FACTORS = 20, (4, 5, 6, 7, 8), 2, 8
#: Likelihood ratio (twice its logarithm) of a slot's labels to chance at which it is kept, and at which its decay has halved.
CHANCE, DOUBT = 5.0, 40.0
SEED = 29
#: Weight decay, over the number of ones in the sample.
DECAY = 0.15
#: (text, slot) pairs whose vectors are gathered at once.
AT_ONCE = 1 << 16

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_GAP = ~_LETTER


def terms(data: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every term, each once a row, and of every term that a row has twice or more, as a term of its own."""
    w = Words(data, offs, lo, hi, _GAP)
    row = np.repeat(np.arange(w.rows), w.n_words)
    kinds = [(np.arange(len(w)), w.hashes())] + [w.proper_prefixes(k) for k in BEGINNINGS]
    slot = np.concatenate([mix(h + np.uint64(i)) >> np.uint64(64 - SLOT_BITS) for i, (_, h) in enumerate(kinds)]).astype(np.int64)
    pairs, n = np.unique((np.concatenate([row[at] for at, _ in kinds]) << SLOT_BITS) | slot, return_counts=True)
    row, slot = pairs >> SLOT_BITS, pairs & ((1 << SLOT_BITS) - 1)
    again = n > 1
    more = (mix(slot[again].astype(np.uint64) + np.uint64(1 << SLOT_BITS)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    return np.concatenate([row, row[again]]), np.concatenate([slot, more])


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of slots of each text, packed."""
    for b in batches:
        data, offs = buffers(b.column(1))
        out = []
        for lo, hi in row_chunks(offs):
            row, slot = terms(data, offs, lo, hi)
            pairs = np.unique((row << SLOT_BITS) | slot)
            cut = np.searchsorted(pairs, np.arange(hi - lo + 1) << SLOT_BITS)
            kept = (pairs & ((1 << SLOT_BITS) - 1)).astype("<u4")
            out += [kept[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], names=["i", "y", "x"])


@dataclass
class Model:
    bias: float
    place: np.ndarray  # slot -> index of a kept slot, or -1
    weight: np.ndarray
    factor: np.ndarray  # (kept slots, FACTORS)

    def score(self, rows: int, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability of label 1 from (row, kept slot) pairs without repeats."""
        return _sigmoid(_raw(self, rows, row, at)[0])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sums(values: Iterable[np.ndarray], row: np.ndarray, rows: int) -> np.ndarray:
    """Sums by row of each factor's values, one factor after the other: pairs x factors never exist as one array."""
    return np.stack([np.bincount(row, v, rows) for v in values], axis=1)


def _raw(m: Model, rows: int, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = _sums((v[at] for v in m.factor.T), row, rows)
    squares = np.empty(len(at))
    for lo in range(0, len(at), AT_ONCE):
        squares[lo : lo + AT_ONCE] = (m.factor[at[lo : lo + AT_ONCE]] ** 2).sum(1)
    square = np.bincount(row, squares, rows)
    return m.bias + np.bincount(row, m.weight[at], rows) + 0.5 * ((total**2).sum(1) - square), total


def fit(sets: list[np.ndarray], y: np.ndarray, share: float, steps: int = 80) -> Model:
    """Adam on the logistic loss over texts, each the set of its slots; ``share`` is the share of ones that the scores are to be calibrated to."""
    size, rows = 1 << SLOT_BITS, len(sets)
    ones, zeros = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for x, label in zip(sets, y, strict=True):  # text by text: the driver never holds all slots as one array
        (ones if label == 1 else zeros)[x] += 1
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    met, rate = ones + zeros, n1 / (n1 + n0)
    often = np.flatnonzero(met >= LEAST_ROWS)
    with np.errstate(divide="ignore", invalid="ignore"):
        tells = 2 * sum(np.where(k > 0, k * np.log(k / (met[often] * r)), 0.0) for k, r in ((ones[often], rate), (zeros[often], 1 - rate)))
    kept, tells = often[tells >= CHANCE], tells[tells >= CHANCE]
    del ones, zeros, met, often
    place = np.full(size, -1, np.int32)
    place[kept] = np.arange(len(kept))
    known = [place[x][place[x] >= 0] for x in sets]
    row, at = np.repeat(np.arange(rows), [len(x) for x in known]), np.concatenate(known)
    rng = np.random.default_rng(SEED)
    m = Model(float(np.log(n1 / n0)), place, np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), FACTORS)))
    state = [np.zeros_like(m.weight), np.zeros_like(m.weight), np.zeros_like(m.factor), np.zeros_like(m.factor)]
    decay = DECAY / n1 * (1 + DOUBT / tells)  # what may be chance is held back
    for i in range(1, steps + 1):
        z, total = _raw(m, rows, row, at)
        g = (_sigmoid(z) - y) / rows
        gr = g[row]
        gw = np.bincount(at, gr, len(kept)) + decay * m.weight
        gv = _sums((gr * (t[row] - v[at]) for t, v in zip(total.T, m.factor.T, strict=True)), at, len(kept)) + decay[:, None] * m.factor
        for x, grad, a, b in ((m.weight, gw, state[0], state[1]), (m.factor, gv, state[2], state[3])):
            a += 0.1 * (grad - a)
            b += 0.01 * (grad**2 - b)
            x -= 0.05 * (a / (1 - 0.9**i)) / (np.sqrt(b / (1 - 0.99**i)) + 1e-9)
        m.bias -= 0.5 * g.sum()
    share = min(max(share, 1e-6), 1 - 1e-6)
    m.bias += float(np.log(share / (1 - share)) - np.log(n1 / n0))  # the sample holds ones and zeros at other rates than the rows
    return m


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | float:
    """Fit on a bounded sample of ``labels``; the share of ones where only one label (or none) is there."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        return share
    odds = F.when(F.col("y") == 1, min(1.0, MAX_POSITIVE / n[1])).otherwise(min(1.0, MAX_NEGATIVE / n[0]))
    chance = F.pmod(F.xxhash64(F.col("i"), F.lit(SEED)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = known.where(chance <= odds).orderBy(F.xxhash64("i"), "i", "y").limit(2 * (MAX_POSITIVE + MAX_NEGATIVE))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")).join(F.broadcast(picked), "i").select("i", "t", "y")  # 9,000 ids at most
    found = texts.mapInArrow(_slots, "i long, y int, x binary")
    sample = found.orderBy(F.xxhash64("i", "x"), "i", "y", "x").limit(2 * (MAX_POSITIVE + MAX_NEGATIVE)).toArrow()  # an id may stand in many rows
    y = np.asarray(sample.column("y").to_pylist(), float)
    if len(set(y)) < 2:
        return share
    sets = [np.frombuffer(x.as_buffer(), "<u4") for x in sample.column("x")]
    return fit(sets, y, share)


def score(docs: DataFrame, model: Model | float, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",), out_col: str = "score") -> DataFrame:
    """``keep`` columns with ``out_col``, the probability of label 1."""
    rows = docs.select(*keep)
    if not isinstance(model, Model):
        return rows.withColumn(out_col, F.lit(float(model)))
    schema = rows.withColumn(out_col, F.lit(0.0)).schema
    rows = docs.select(*keep, F.col(text).alias(fresh(rows.columns, "__text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, offs = buffers(b.column(b.num_columns - 1))
            out = []
            for lo, hi in row_chunks(offs):
                row, slot = terms(data, offs, lo, hi)
                at = m.place[slot]
                known = at >= 0
                pairs = np.unique((row[known] << 32) | at[known])
                out.append(m.score(hi - lo, pairs >> 32, pairs & 0xFFFFFFFF))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(out) if out else np.zeros(0))], names=schema.names)

    return rows.mapInArrow(run, schema)
