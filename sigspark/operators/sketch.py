"""Weighted quantile sketch per group: a mergeable summary with a known rank error.

A summary holds some of a group's values, in order; of each it knows the weight at
the value and bounds of the weight below it (``low``) and up to it (``high``).  Summaries are
exact until they hold more than SIZE values; then they are pruned to the values whose ranks lie
next to SIZE equally spaced ones, which widens what is known between two values by total / SIZE.
Merging adds bounds and widens nothing (Greenwald and Khanna, 2001; the weighted form is that of
Chen and Guestrin's "XGBoost", 2016, appendix).  So the error follows the number of prunings
on the way, the logarithm of the rows, and :func:`rank_error` reads what it has come to off the summary.

As a grouped aggregate: each task summarises the rows it holds, group by group
(buffers of BUFFER rows, merged in pairs of equal height), and only summaries are shuffled; they are merged
in two steps, first those of every FAN-th task, so no task merges more than a bounded number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a pruned summary, rows of a buffer, and groups of summaries in the first merge.
SIZE, BUFFER, FAN = 2048, 1 << 16, 256

Summary = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # value, weight, low, high


def exact(value: np.ndarray, weight: np.ndarray) -> Summary:
    v, at = np.unique(value, return_inverse=True)
    w = np.bincount(at, weight, len(v))
    high = np.cumsum(w)
    return v, w, high - w, high


def merge(a: Summary, b: Summary) -> Summary:
    if not len(a[0]) or not len(b[0]):
        return b if not len(a[0]) else a
    v = np.union1d(a[0], b[0])
    w, low, high = np.zeros(len(v)), np.zeros(len(v)), np.zeros(len(v))
    for value, weight, lo, hi in (a, b):
        at = np.searchsorted(value, v)
        there = np.zeros(len(v), bool)
        inside = at < len(value)
        there[inside] = value[at[inside]] == v[inside]
        # a value that this summary does not hold lies between two that it holds
        below = np.where(at > 0, (lo + weight)[np.maximum(at - 1, 0)], 0.0)
        above = np.where(inside, (hi - weight)[np.minimum(at, len(value) - 1)], hi[-1])
        k = np.minimum(at, len(value) - 1)
        w += np.where(there, weight[k], 0.0)
        low += np.where(there, lo[k], below)
        high += np.where(there, hi[k], above)
    return v, w, low, high


def prune(s: Summary, size: int = SIZE) -> Summary:
    """At most ``size`` + 1 values: the ends, and those next to equally spaced ranks."""
    v, w, low, high = s
    if len(v) <= size + 1:
        return s
    middle = low + high  # twice the rank
    at = np.searchsorted(middle, 2 * high[-1] * np.arange(1, size) / size)
    at = np.minimum(at, len(v) - 1)
    back = np.maximum(at - 1, 0)
    want = 2 * high[-1] * np.arange(1, size) / size
    at = np.where(np.abs(middle[back] - want) <= np.abs(middle[at] - want), back, at)
    keep = np.unique(np.concatenate([[0], at, [len(v) - 1]]))
    return tuple(x[keep] for x in s)


def rank_error(s: Summary) -> float:
    """Share of the total weight by which the rank of any value may be off (0 for an exact summary)."""
    v, w, low, high = s
    if not len(v):
        return 0.0
    gap = np.append(high[1:] - w[1:], high[-1]) - (low + w)  # of ranks between a value and the next
    inner = high - low - w  # of a value's own rank
    return float(max(0.0, gap.max(), inner.max()) / high[-1])


class Sketch:
    """Summaries of one group's rows inside a task, merged in pairs of equal height."""

    def __init__(self, size: int):
        self.size, self.held, self.n, self.levels = size, [], 0, []

    def add(self, value: np.ndarray, weight: np.ndarray) -> None:
        self.held.append((value, weight))
        self.n += len(value)
        if self.n >= BUFFER:
            self._flush()

    def _flush(self) -> None:
        if not self.held:
            return
        s = prune(exact(*(np.concatenate(x) for x in zip(*self.held, strict=True))), self.size)
        self.held, self.n, k = [], 0, 0
        while k < len(self.levels) and self.levels[k] is not None:
            s, self.levels[k] = prune(merge(self.levels[k], s), self.size), None
            k += 1
        self.levels[k : k + 1] = [s]

    def summary(self) -> Summary:
        self._flush()
        return prune(_all([s for s in self.levels if s is not None]), self.size)


def _all(parts: list[Summary]) -> Summary:
    """Merge of many summaries, in pairs."""
    while len(parts) > 1:
        parts = [merge(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else (np.zeros(0),) * 4


FIELDS = ("v", "w", "lo", "hi")


def summaries(rows: DataFrame, keys: Sequence[str], value: str = "value", weight: str = "weight", size: int = SIZE) -> DataFrame:
    """One row per group: keys and its summary as arrays v, w, lo, hi.

    Rows without a value, or without a positive weight, are left out; a NULL key is a group of its own.
    """
    keys = list(keys)
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    known = rows.where(v.isNotNull() & ~F.isnan(v) & (w > 0)).select(*keys, v.alias("v"), w.alias("w"), F.spark_partition_id().alias("part"))
    lists = ", ".join(f"{c} array<double>" for c in FIELDS)
    head = known.select(*keys, "part").schema.simpleString()[len("struct<") : -1].replace(":", " ")
    parts = known.mapInArrow(_summarise(keys, size), f"{head}, {lists}")
    for group in (F.col("part") % FAN, F.lit(0)):
        parts = parts.withColumn("part", group.cast("int")).groupBy(*keys, "part").applyInArrow(_merge_all(keys, size), f"{head}, {lists}")
    return parts.drop("part")


def _pack(names: list[str], head: list[pa.Array], s: Summary) -> pa.Table:
    return pa.table([*head, *[pa.array([x.tolist()], pa.list_(pa.float64())) for x in s]], names=[*names, "part", *FIELDS])


def _summarise(keys: list[str], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[list[pa.Array], Sketch]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            code = np.zeros(b.num_rows, np.int64)
            for k in range(len(keys)):
                c = b.column(k).dictionary_encode("encode")
                code = code * (len(c.dictionary) + 1) + c.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            value, weight = (b.column(len(keys) + i).to_numpy() for i in (0, 1))
            for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                head = [b.column(k).slice(int(at[0]), 1) for k in (*range(len(keys)), len(keys) + 2)]
                name = tuple(h[0].as_py() for h in head[:-1])
                groups.setdefault(name, (head, Sketch(size)))[1].add(value[at], weight[at])
        for head, sketch in groups.values():
            yield from _pack(keys, head, sketch.summary()).to_batches()

    return run


def _merge_all(keys: list[str], size: int):
    def run(t: pa.Table) -> pa.Table:
        lists = [t.column(c).to_pylist() for c in FIELDS]
        parts = [tuple(np.array(x, float) for x in s) for s in zip(*lists, strict=True)]
        head = [t.column(k).slice(0, 1).combine_chunks() for k in (*keys, "part")]
        return _pack(keys, head, prune(_all(parts), size))

    return run


def weighted_cuts(rows: DataFrame, max_bins: int, keys: Sequence[str] = ("study", "feature"), value: str = "value", weight: str = "weight", size: int = SIZE) -> DataFrame:
    """Bin borders of equal weight per group: keys, bin, cut, rank_error.

    Bin b (1 .. max_bins - 1) begins at the first value with b / max_bins of the group's weight, or more, below it;
    bins that would begin at the same value are one, the highest.  Exact where a group has at most ``size`` distinct values; else
    ranks are off by ``rank_error`` of the group's weight at most.
    """
    keys = list(keys)
    s = summaries(rows, keys, value, weight, size)
    head = s.select(*keys).schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                one = tuple(np.array(b.column(len(keys) + i)[r].as_py(), float) for i in range(4))
                v, w, low, high = one
                below = (low + high - w) / 2
                at = np.searchsorted(below, high[-1] * np.arange(1, max_bins) / max_bins - 1e-12 * high[-1])
                inside = np.flatnonzero(at < len(v))
                last = inside[np.append(at[inside][1:] != at[inside][:-1], True)] if len(inside) else inside
                n = len(last)
                head_cols = [b.column(k).take(pa.array(np.full(n, r))) for k in range(len(keys))]
                values = [pa.array((last + 1).astype(np.int32)), pa.array(v[at[last]]), pa.array(np.full(n, rank_error(one)))]
                yield pa.RecordBatch.from_arrays([*head_cols, *values], names=[*keys, "bin", "cut", "rank_error"])

    return s.mapInArrow(run, f"{head}, bin int, cut double, rank_error double")
