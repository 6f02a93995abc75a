"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector passes it where its inner product with the
direction exceeds ALPHA, that is, where it lies in the cap around the
direction.  The directions form a random product code (Becker, Ducas, Gama,
Laarhoven: "New directions in nearest neighbor searching with applications to
lattice sieving", 2016): the space, turned by a random rotation, is cut into
two halves, each half has B random unit vectors, and every pair of one from
each half is a direction, B^2 in all.  List decoding finds the directions a
vector exceeds from the 2 B inner products of its halves: only first halves that
could reach ALPHA with the best second half are looked at.

Vectors are joined on the filters they share, and every pair that meets is
verified by its cosine in double precision.  A pair that shares several
filters counts in the first of them only, so links are counted where they are
found and no table of pairs is made: a task hands on one row per vector (links
found, smallest vector linked within the task).

One large code whose caps are wide enough for nearly every pair would give each vector
hundreds of directions, since a pair's luck with the two halves varies; so there
are REPEATS independent codes with narrow caps, each of which brings a pair at the least cosine
together with a chance of HIT (ALPHA is that quantile over simulated pairs), and all of
them miss it with a chance of (1 - HIT)^REPEATS = 0.0018.  B follows the number of
vectors, so that a filter holds about BUCKET of them whatever the corpus.  The
index holds every vector; none of it is learned from data.  A filter with more than
CHUNK vectors (a large group of near copies) is cut into chunks, and each pair of chunks is a
group of its own.  Equal vectors are one class and are compared once.

Defined results: vectors that are null, empty, zero, or hold a null or a
non-finite component, and rows without id, link with nothing; vectors of
different lengths do not link; rows that share an id are one node; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.session import cut_lineage

from .components import components, lowest
from .groups import runs_of

#: Cosine of a link; vectors that a filter is to hold; vectors of a chunk.
LEAST, BUCKET, CHUNK = 0.9, 64, 1024
#: Codes, and the chance that one of them brings a pair at that cosine together.
REPEATS, HIT = 22, 0.25
#: Vectors decoded at once (each gives some dozens of rows that carry it).
BATCH = 256
#: Simulated pairs, and directions of a half looked at for each.
PAIRS, TOP = 4000, 48
#: Filters that hold more than CHUNK vectors travel to all executors up to this number of them.
MAX_BROADCAST_FILTERS = 200_000
SEED = 53


class Code:
    """The product codes of one vector length for about ``n`` vectors."""

    def __init__(self, dim: int, n: int, least: float):
        rng = np.random.default_rng([SEED, dim])
        self.size = max(4, int(np.ceil(np.sqrt(max(1, n) / BUCKET))))
        self.cut = (dim + 1) // 2
        self.turns = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(REPEATS)]
        self.halves = [[self._unit(rng.normal(size=(self.size, d))) if d else np.zeros((1, 0)) for d in (self.cut, dim - self.cut)] for _ in range(REPEATS)]
        self.filters = len(self.halves[0][0]) * len(self.halves[0][1])
        x = self._unit(rng.normal(size=(PAIRS, dim)))
        z = rng.normal(size=(PAIRS, dim))
        z -= (z * x).sum(1, keepdims=True) * x
        y = least * x + np.sqrt(1 - least**2) * (self._unit(z) if dim > 1 else 0)
        best = []
        for k, (a, b) in enumerate(zip(np.array_split(x, 2 * REPEATS), np.array_split(y, 2 * REPEATS), strict=True)):
            (a1, a2), (b1, b2) = self.scores(a, k // 2), self.scores(b, k // 2)
            i, j = (np.argsort(-np.minimum(p, q), axis=1)[:, :TOP] for p, q in ((a1, b1), (a2, b2)))
            take = np.take_along_axis
            meet = np.minimum(take(a1, i, 1)[:, :, None] + take(a2, j, 1)[:, None], take(b1, i, 1)[:, :, None] + take(b2, j, 1)[:, None])
            best.append(meet.max((1, 2)))
        self.alpha = float(np.quantile(np.concatenate(best), 1 - HIT))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def scores(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        x = x @ self.turns[k]
        return x[:, : self.cut] @ self.halves[k][0].T, x[:, self.cut :] @ self.halves[k][1].T

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter), in order, for every direction of every code that a unit vector exceeds."""
        rows, filters = [], []
        for c in range(REPEATS):
            first, second = self.scores(x, c)
            row, i = np.nonzero(first >= (self.alpha - second.max(1))[:, None])
            k, j = np.nonzero(second[row] >= (self.alpha - first[row, i])[:, None])
            rows.append(row[k])
            filters.append(i[k] * np.int64(len(self.halves[c][1])) + j + np.int64(c) * self.filters)
        rows, filters = np.concatenate(rows), np.concatenate(filters)
        order = np.lexsort((filters, rows))
        return rows[order], filters[order]


@cache
def code(dim: int, n: int, least: float) -> Code:
    return Code(dim, n, least)


def units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return Code._unit(x / np.abs(x).max(1, keepdims=True))


def _decoded(batches: Iterator[pa.RecordBatch], n: int, least: float, kind: str) -> Iterator[tuple]:
    """(length, places in the batch, vectors, row, filter) of BATCH vectors of one length at a time; vectors are the first column."""
    for b in batches:
        values, ends = b.column(0).flatten().to_numpy(), np.cumsum([0, *pc.list_value_length(b.column(0)).to_pylist()])
        dims = np.diff(ends)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            for lo in range(0, len(at), BATCH):
                part = at[lo : lo + BATCH]
                raw = np.stack([values[ends[i] : ends[i + 1]] for i in part]).astype(kind)
                yield b, int(dim), part, raw, *code(int(dim), n, least).decode(units(raw))


def filter_sizes(classes: DataFrame, n: int, least: float, kind: str) -> DataFrame:
    """dim, filter, n: how many vectors each filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, dim, _, _, row, filters in _decoded(batches, n, least, kind):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), dim, np.int32)), pa.array(filters)], names=["dim", "filter"])

    return classes.select("v").mapInArrow(run, "dim int, filter long").groupBy("dim", "filter").agg(F.count("*").alias("n"))


def assign(classes: DataFrame, n: int, least: float, kind: str) -> DataFrame:
    """A row for each class and filter: dim, filter, id, copies, vec (packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, dim, part, raw, row, filters in _decoded(batches, n, least, kind):
            vec = [x.tobytes() for x in raw]
            at = pa.array(row)
            cols = [pa.array(np.full(len(row), dim, np.int32)), pa.array(filters), *(b.column(k).take(pa.array(part)).take(at) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(vec, pa.binary()).take(at)], names=["dim", "filter", "id", "copies", "vec"])

    return classes.select("v", "id", "copies").mapInArrow(run, "dim int, filter long, id long, copies long, vec binary")


def _verify(n: int, least: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for (dim, at, one, two), b in runs_of(batches, ["dim", "filter", "one", "two"]):
            if b.num_rows < 2:
                continue
            x = units(np.frombuffer(b"".join(b.column(7).to_pylist()), kind).reshape(b.num_rows, dim))
            side = b.column(4).to_numpy()
            near = x @ x.T >= least
            np.fill_diagonal(near, False)
            if one != two:
                near &= side[:, None] != side[None]
            hit = np.flatnonzero(near.any(1))
            if not len(hit):
                continue
            near = near[np.ix_(hit, hit)]
            ids, copies = b.column(5).to_numpy()[hit], b.column(6).to_numpy()[hit]
            low = lowest(near, ids)
            row, flat = code(dim, n, least).decode(x[hit])  # all filters of the linked ones
            row, flat = row[flat < at], flat[flat < at]
            names, col = np.unique(flat, return_inverse=True)
            earlier = np.zeros((len(hit), len(names)), np.float32)
            earlier[row, col] = 1
            fresh = near & (earlier @ earlier.T == 0)
            out.append((ids, fresh @ copies, low))
            size += len(ids)
            if size >= 10_000:
                yield _found(out)
                out, size = [], 0
        if out:
            yield _found(out)

    return run


def _found(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)], names=["id", "links", "low"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", least: float = LEAST) -> DataFrame:
    """id, n_links (other vectors linked directly), component_id (smallest id reachable) and kept of each row."""
    kind = "f4" if dict(vectors.dtypes)[vector] == "array<float>" else "f8"
    v = F.col(vector) if kind == "f4" else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.coalesce(F.col("id").isNotNull() & ~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fit", fit).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(SEED), F.col("v")))
    classes = rows.where("fit").groupBy("h1", "h2").agg(F.min(F.struct("id", "v")).alias("m"), F.count("*").alias("copies"))
    classes = cut_lineage(classes.select("h1", "h2", "m.id", "m.v", "copies"))
    n = classes.count()
    met = assign(classes, n, least, kind)
    large = cut_lineage(filter_sizes(classes, n, least, kind).where(F.col("n") > CHUNK).select("dim", "filter", F.ceil(F.col("n") / CHUNK).alias("chunks")))
    met = met.join(F.broadcast(large) if large.count() <= MAX_BROADCAST_FILTERS else large, ["dim", "filter"], "left")
    met = met.withColumn("chunks", F.coalesce("chunks", F.lit(1)).cast("int"))
    met = met.withColumn("side", F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("chunks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("dim", "filter", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"), "side", "id", "copies", "vec")
    key = ["dim", "filter", "one", "two"]
    found = met.repartition(*key).sortWithinPartitions(*key).mapInArrow(_verify(n, least, kind), "id long, links long, low long")
    found = cut_lineage(found)
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = cut_lineage(components(found, "id", "low"))
    named = classes.select("h1", "h2", "id", "copies").join(linked, "id", "left").join(comp, F.col("id") == F.col("node"), "left")
    named = named.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("c"), F.lit(True).alias("fit"))
    out = rows.select("id", "fit", "h1", "h2").join(named, ["h1", "h2", "fit"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
