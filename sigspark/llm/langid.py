"""Language identification with error-correcting output codes.

Every language gets a codeword of bits.  For each bit, a binary classifier over
hashed byte n-grams (two and four bytes inside and across words, lower-cased,
everything but letters read as one space) learns to tell the languages with a
1 from those with a 0.  A text is given to the language whose codeword is
nearest in loss-weighted decoding: the loss of each bit's margin, weighted by
how well that bit's classifier does on that language.  Where the two nearest
codewords are about as near, the row is flagged as ambiguous.

The classifiers are fitted on the driver from a bounded sample of labelled
rows (``SAMPLE_ROWS`` in all, even over languages, chosen by a hash of the
id); scoring reads every whole text where it lies, without a shuffle.

Defined results: a null text, or one without letters, is ``und`` with score 0;
without any labelled row all texts are ``und``.  Repeated rows are scored row
by row, ties of two languages go to the first by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import buffers, row_chunks

#: Bound on the rows that the classifiers are fitted on (their whole texts).
SAMPLE_ROWS = 2400
#: Hashed n-gram features, and rows worked on at once.
FEATURES, ROWS = 1 << 13, 256
SEED = 17
PAIR = np.dtype([("slot", "<u2"), ("value", "<f2")])
#: Below this distance between the two best probabilities a text is ambiguous.
AMBIGUOUS = 0.2

_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def features(data: np.ndarray, offs: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """(rows, FEATURES) float32: square roots of n-gram counts, rows of length one."""
    base, end = int(offs[lo]), int(offs[hi])
    c = _CLASS[data[base:end]]
    n = hi - lo
    row = np.repeat(np.arange(n), np.diff(offs[lo : hi + 1]))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (row[1:] != row[:-1])  # one space for a run of them
    c, row = c[keep].astype(np.uint32), row[keep]
    x = np.zeros(n * FEATURES, np.float32)
    for k in (2, 4):
        m = len(c) - k + 1
        if m <= 0:
            continue
        code = c[:m].copy()
        for j in range(1, k):
            code = (code << np.uint32(8)) | c[j : j + m]
        slot = ((code * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(19)).astype(np.int64)
        same = row[:m] == row[k - 1 :]
        x += np.bincount((row[:m] * FEATURES + slot)[same], minlength=n * FEATURES)
    x = np.sqrt(x.reshape(n, FEATURES))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def codebook(n: int) -> np.ndarray:
    """(n, bits) of -1 and 1: all splits of up to 7 languages, else the best spread of 200 seeded random codes."""
    if n <= 7:
        half = np.arange(1, 1 << max(n - 1, 0))
        bits = (half[None, :] >> np.arange(n - 1)[:, None]) & 1 if n > 1 else np.zeros((0, 0), int)
        return np.vstack([np.zeros((1, bits.shape[1]), int), bits]) * 2 - 1
    rng = np.random.default_rng(SEED)
    width, best, spread = 12 * int(np.ceil(np.log2(n))), None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n, width)) * 2 - 1
        near = (code @ code.T - 2 * width * np.eye(n, dtype=int)).max()
        if (width - near) / 2 > spread and (np.abs(code.sum(0)) < n).all():
            best, spread = code, (width - near) / 2
    return best if best is not None else code


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # (languages, bits)
    weight: np.ndarray  # (FEATURES, bits)
    bias: np.ndarray
    trust: np.ndarray  # (languages, bits), rows add up to 1

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, its probability, and whether it is ambiguous."""
        if len(self.langs) == 1:
            n = len(margins)
            return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
        loss = np.logaddexp(0, -self.code[None] * margins[:, None])  # (rows, languages, bits)
        far = (loss * self.trust[None]).sum(2)
        p = np.exp(-5 * (far - far.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        two = np.sort(p, axis=1)[:, -2:]
        return far.argmin(1), two[:, 1], two[:, 1] - two[:, 0] < AMBIGUOUS


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], steps: int = 120) -> Model:
    """Logistic regression for all bits at once, with even weight for each language."""
    code = codebook(len(langs))
    t = (code[y] > 0).astype(np.float32)
    share = (1 / np.maximum(np.bincount(y, minlength=len(langs)), 1))[y].astype(np.float32)[:, None] / len(langs)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, steps + 1):
        g = (1 / (1 + np.exp(-(x @ w + b))) - t) * share
        gw = x.T @ g + 1e-6 * w
        b -= 0.5 * g.sum(0)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        w -= 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    right = ((x @ w + b) * code[y] > 0).astype(float)
    trust = np.array([right[y == k].mean(0) if (y == k).any() else np.ones(code.shape[1]) for k in range(len(langs))]) + 1e-3
    return Model(langs, code, w, b, trust / trust.sum(1, keepdims=True))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of whole texts as packed (slot, value) pairs, FEATURES of them at most."""
    for b in batches:
        data, offs = buffers(b.column(1))
        out = []
        for lo, hi in row_chunks(offs, rows=ROWS):
            for row in features(data, offs, lo, hi):
                slot = np.flatnonzero(row)
                pairs = np.zeros(len(slot), PAIR)
                pairs["slot"], pairs["value"] = slot, row[slot]
                out.append(pairs.tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], names=["i", "l", "x"])


def train(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Fit on a bounded, hash-chosen sample of rows that have a label; None without any."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null")
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return None
    langs = sorted(sizes)
    each = max(1, SAMPLE_ROWS // len(langs))
    odds = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, each / sizes[k]))])
    chance = F.pmod(F.xxhash64(F.col("i"), F.lit(SEED)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = rows.where(chance <= odds[F.col("l")])
    sample = picked.mapInArrow(_sparse, "i long, l string, x binary").orderBy(F.xxhash64("i"), "i", "l").limit(2 * SAMPLE_ROWS).toArrow()
    if not len(sample):
        return None
    x = np.zeros((len(sample), FEATURES), np.float32)
    for row, packed in zip(x, sample.column("x").to_pylist(), strict=True):
        pairs = np.frombuffer(packed, PAIR)
        row[pairs["slot"]] = pairs["value"]
    y = np.array([langs.index(v) for v in sample.column("l").to_pylist()])
    return fit(x, y, langs)


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred, score (0 to 1) and ambiguous."""
    rows = docs.select(*keep, F.col(text).alias("__text"))
    if model is None:
        return rows.drop("__text").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "ambiguous": F.lit(True)})
    schema = rows.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "ambiguous": F.lit(True)}).drop("__text").schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x bits, whatever the corpus
    rows = rows.withColumn("__letters", F.coalesce(F.col("__text").rlike(r"\p{L}"), F.lit(False)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array([*m.langs, "und"])
        for b in batches:
            data, offs = buffers(b.column(b.num_columns - 2))
            known = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            found = [m.decode(features(data, offs, lo, hi) @ m.weight + m.bias) for lo, hi in row_chunks(offs, rows=ROWS)]
            best, p, unsure = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0), np.zeros(0, bool))
            lang = names.take(pa.array(np.where(known, best, len(m.langs))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], lang, pa.array(np.where(known, p, 0.0)), pa.array(unsure | ~known)], names=schema.names)

    return rows.mapInArrow(score, schema)
