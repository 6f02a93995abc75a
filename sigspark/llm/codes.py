"""Product codes of vectors, learned and assigned in exact whole numbers.

A vector is scaled (floor of ``scale`` times each component) and cut into
equal consecutive parts; each part position has a codebook, refined by rounds
of nearest-entry assignment and floored means.  Every step is exact, so any
cluster gives the same codes bit for bit.

Distances come from matrix products of double precision, which are exact only
below 2^53.  So the whole numbers are split into limbs that are narrow enough
for each limb product, summed over a part, to stay below that; the limb
products are shifted and added in 64-bit integers, and the first minimum wins.

Only the codebooks (parts x entries x width numbers, whatever the table holds)
and, for a round, their sums pass through the driver.  Vectors are read where
they lie, once a round; a task adds up its rows before anything is shuffled.

Defined results: rows without a vector, or with a null or non-finite component,
are dropped, as is a vector whose length is not that of the first kept one
(by id, null ids last, then by content).  Rows that share an id are rows of
their own.  With fewer kept rows than entries the codebook is shorter; an
empty table gives an empty one.  A length that does not divide by the parts,
or a component over ``LARGEST`` after scaling (whose squares would leave 64
bits), is an error.  A sum of errors beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import fresh

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bits that a double holds exactly, and vectors compared at once.
EXACT_BITS, CHUNK = 53, 1024
#: Largest scaled component: the squared distance of two vectors of up to 2^10 components fits into 64 bits.
LARGEST = 1 << 25
#: Labels with the most rows whose sums travel to every task; the others are joined by a shuffle.
HOT_LABELS = 4096


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Doubles l_0, l_1, ... with x = sum of l_i 2^(i bits): the last one is signed, those before lie in [0, 2^bits)."""
    out = []
    while x.size and max(int(x.max()), -int(x.min()) - 1) >> bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of 64-bit integers (stacked matrices too) by double-precision products of limbs, recombined modulo 2^64."""
    depth = max(1, a.shape[-1])
    bits = (EXACT_BITS - 1 - (depth - 1).bit_length()) // 2
    left, right = limbs(a, bits), limbs(b, bits)
    out = np.zeros((*a.shape[:-1], b.shape[-1]), np.int64)
    for i, p in enumerate(left):
        for j, q in enumerate(right):
            if bits * (i + j) < 64:
                out += (p @ q).astype(np.int64) << np.int64(bits * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the first nearest entry; x is (parts, rows, width), book is (parts, entries, width)."""
    score = (book * book).sum(-1)[:, None, :] - 2 * exact_products(x, book.transpose(0, 2, 1))
    at = score.argmin(-1)
    return at, np.take_along_axis(score, at[..., None], -1)[..., 0] + (x * x).sum(-1)


@dataclass
class Codebooks:
    entries: np.ndarray  # (parts, entries, width), whole numbers
    length: int  # of a vector

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _matrix(col: pa.Array, length: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their scaled components) of a column of lists."""
    col = col.cast(pa.large_list(pa.float64()))
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(col.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    good = np.concatenate([[0], np.cumsum(np.isfinite(flat))])
    kept = np.flatnonzero((size == length) & (good[begin + size] - good[begin] == size))
    if not len(kept):
        return kept, np.zeros((0, length), np.int64)
    scaled = np.floor(flat[begin[kept][:, None] + np.arange(length)] * scale)
    if np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component is over {LARGEST / scale} in size")
    return kept, scaled.astype(np.int64)


def _chunks(b: pa.RecordBatch, column: int, length: int, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for lo in range(0, b.num_rows, CHUNK):
        kept, x = _matrix(b.column(column).slice(lo, CHUNK), length, scale)
        if len(kept):
            yield lo, kept, x


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def first_vectors(vectors: DataFrame, n: int, id_col: str = "vec_id", vector: str = "embedding") -> list[list[float]]:
    """The ``n`` first usable vectors by id (null ids last), then content, that are as long as the very first."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("i"), F.col(vector).cast("array<double>").alias("v"))
    usable = rows.where((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    by = [F.col("i").asc_nulls_last(), v]
    first = usable.orderBy(*by).limit(1).collect()
    if not first:
        return []
    alike = usable.where(F.size(v) == len(first[0].v))
    return [r.v for r in alike.orderBy(*by).limit(n).collect()]


def train(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all rows; None where no row is usable."""
    start = first_vectors(vectors, entries, id_col, vector)
    if not start:
        return None
    length = len(start[0])
    if length % parts:
        raise ValueError(f"a vector of {length} components cannot be cut into {parts} equal parts")
    _, x = _matrix(pa.array(start, pa.large_list(pa.float64())), length, scale)
    book = Codebooks(_parts(x, parts), length)
    for _ in range(rounds):
        book = _round(vectors.select(vector), book, scale)
    return book


def _round(vectors: DataFrame, book: Codebooks, scale: int) -> Codebooks:
    """Every entry becomes the floored mean of the parts that are nearest to it; an entry without any stays."""
    parts, entries, width = book.entries.shape
    sums = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            for _, _, x in _chunks(b, 0, book.length, scale):
                px = _parts(x, parts)
                at = (nearest(px, book.entries)[0] + np.arange(parts)[:, None] * entries).ravel()
                np.add.at(total, at, px.reshape(-1, width))
                count += np.bincount(at, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *[pa.array(total[used, i]) for i in range(width)]], names=["k", "n", *sums])

    partial = vectors.mapInArrow(run, ", ".join(f"{c} long" for c in ["k", "n", *sums]))
    whole = partial.groupBy("k").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ["n", *sums]])
    new = book.entries.reshape(-1, width).copy()
    for r in whole.collect():  # parts x entries rows at most
        new[r.k] = [int(r[c]) // int(r.n) for c in sums]
    return Codebooks(new.reshape(parts, entries, width), book.length)


def encode(
    vectors: DataFrame, book: Codebooks, vector: str = "embedding", keep: tuple[str | Column, ...] = ("vec_id",), scale: int = SCALE,
) -> DataFrame:
    """``keep`` columns of each usable row with ``code`` (two hex digits a part) and ``error`` (squared distances summed over parts)."""
    rows = vectors.select(*keep)
    if not {"code", "error"}.isdisjoint(c.lower() for c in rows.columns):
        raise ValueError("code and error are columns of the result")
    schema = rows.withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema
    rows = vectors.select(*keep, F.col(vector).alias(fresh(rows.columns, "__vector")))
    parts = len(book.entries)
    hexed = np.array([f"{i:02x}" for i in range(book.entries.shape[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, kept, x in _chunks(b, b.num_columns - 1, book.length, scale):
                at, far = nearest(_parts(x, parts), book.entries)
                code = pc.binary_join_element_wise(*[pa.array(hexed[a]) for a in at], "")
                head = b.slice(lo, CHUNK).take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([*head.columns[:-1], code, pa.array(far.sum(0))], names=schema.names)

    return rows.mapInArrow(run, schema)


def with_group_error(coded: DataFrame, label: str = "label", error: str = "error", out_col: str = "label_error") -> DataFrame:
    """``coded`` with the sum of ``error`` over the rows of the same label (nulls are one label).

    Sums are small rows, but a label may hold any share of all rows: the
    HOT_LABELS labels with most rows are met without moving a row, and only
    rows of the others (none of which can hold more than one row in
    HOT_LABELS) are shuffled to their sum.  ``coded`` is read three times, so
    hand in a checkpoint or a table.
    """
    k, out, here = (fresh([*coded.columns, out_col], c) for c in ("__k", "__sum", "__hot"))
    sums = coded.groupBy(F.col(label).alias(k)).agg(F.try_sum(error).alias(out), F.count(F.lit(1)).alias(here))
    hot = sums.orderBy(F.desc(here), F.col(k).asc_nulls_first()).limit(HOT_LABELS + 1).collect()
    few = len(hot) <= HOT_LABELS
    table = coded.sparkSession.createDataFrame([tuple(r) for r in hot[:HOT_LABELS]], sums.schema).withColumn(here, F.lit(True))
    met = coded.join(F.broadcast(table), F.col(label).eqNullSafe(F.col(k)), "left")
    near = met.where(here).select(*coded.columns, F.col(out).alias(out_col))
    if few:
        return near
    rest = met.where(F.col(here).isNull()).select(*coded.columns)  # a null label among them is not hot
    return near.unionByName(rest.join(sums.drop(here), F.col(label).eqNullSafe(F.col(k))).select(*coded.columns, F.col(out).alias(out_col)))
