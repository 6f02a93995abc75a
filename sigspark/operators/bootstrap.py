"""Stratified bootstrap of the AUC without a row per draw.

Every class of a group is resampled with replacement to its own size: the
draws fall on the class's rows, in score order, with equal chance.  The
multinomial counts are drawn from the top down.  The ordered scores of a group
are cut into cells of about CELL rows; first each class's size is split over
the cells (over spans of FAN cells first, where there are more of them), and
then what fell into a cell is split over its scores.  Both steps draw seeded
uniforms, so a count depends on (group, class, replicate, span) alone and not
on how the work was cut into tasks.

What moves: the collapsed scores once, to their cell, one row per (class, cell,
replicate) with a count, and a span's cells once for a unit of draws; no row per draw exists.  A task holds a cell or a span's
cells and BLOCK draws, whatever a group's size.  In a cell, the AUC needs the
positives and negatives drawn there and their concordant pairs; a running sum over
cells adds the negatives below.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import GOLD, MIX, STEP, md5_base
from ..session import reuse
from .scan import null_safe_join, ordered_scan

#: Rows of a cell (one score with more ties than that is a cell of its own), cells of a span, and draws made at once.
CELL, FAN, BLOCK = 1 << 16, 1 << 14, 1 << 16
#: Draws over more than ROWS rows are counted in slots, whose numbers have GRID bits; a unit of work has between these numbers of draws.
ROWS, GRID, UNIT = 1 << 18, 16, (1 << 20, 1 << 26)


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = ((x >> np.uint32(16)) ^ x) * np.uint32(MIX)
    return (x >> np.uint32(16)) ^ x


def uniforms(base0: int, base1: int, a: int, first: int, n: int) -> np.ndarray:
    """U[0, 1) of 53 bits for the draws first .. first + n - 1 of replicate ``a``; all products are taken modulo 2^32."""
    j = np.arange(first, first + n, dtype=np.uint64).astype(np.uint32)
    x, y = (j * np.uint32(s) + np.uint32((base + a * g) & 0xFFFFFFFF) for base, g, s in zip((base0, base1), GOLD, STEP, strict=True))
    x = _mix(x)
    return (_mix(x + y) * float(1 << 21) + (_mix(x ^ y) >> np.uint32(11))) * 2.0**-53


class Parts:
    """Rows laid out in parts of given sizes; counts on which of them equal-chance draws fall."""

    def __init__(self, sizes: np.ndarray):
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        self.total = int(self.ends[-1]) if len(sizes) else 0
        self.shift = 0 if self.total <= ROWS else max(0, self.total.bit_length() - GRID)
        # slots of 2^shift rows are counted; those inside one part count for it, only draws in the others are looked up
        first = np.arange(((self.total - 1) >> self.shift) + 1 if self.total else 0) << self.shift
        self.owner = np.searchsorted(self.ends, first, side="right")
        self.mixed = self.owner != np.searchsorted(self.ends, np.minimum(first + (1 << self.shift), self.total) - 1, side="right")
        self.some = np.flatnonzero(sizes)

    def counts(self, draws: int, base0: int, base1: int, rep: int, first: int = 0) -> np.ndarray:
        """How many of ``draws`` draws (numbered from ``first``) fall on each part."""
        if not draws or len(self.some) <= 1:
            return np.where(self.sizes > 0, draws, 0)
        out = np.zeros(len(self.sizes), np.int64)
        slots = np.zeros(len(self.owner), np.int64)
        for lo in range(0, draws, BLOCK):
            u = uniforms(base0, base1, rep, first + lo, min(BLOCK, draws - lo))
            u *= self.total
            at = u.astype(np.int64)
            if self.shift:
                slot = at >> self.shift
                out += np.bincount(np.searchsorted(self.ends, at[self.mixed[slot]], side="right"), minlength=len(out))
                at = slot
            slots += np.bincount(at, minlength=len(slots))
        if not self.shift:
            out[self.some] = np.add.reduceat(slots, (self.ends - self.sizes)[self.some])
            return out
        slots[self.mixed] = 0
        return out + np.bincount(self.owner, weights=slots, minlength=len(out)).astype(np.int64)


def draw_counts(sizes: np.ndarray, draws: int, base0: int, base1: int, rep: int, first: int = 0) -> np.ndarray:
    """How many of ``draws`` equal-chance draws (numbered from ``first``) fall on each of the parts with these sizes."""
    return Parts(sizes).counts(draws, base0, base1, rep, first)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the children of each (group, class, span) for its listed replicates and blocks of draws."""
    for b in batches:
        col = {k: b.column(b.schema.get_field_index(k)) for k in ("gk", "label", "parts", "base0", "base1", "todo")}
        for r in range(b.num_rows):
            child, sizes = (col["parts"][r].values.field(k).to_numpy() for k in ("child", "m"))
            rep, first, draws = (col["todo"][r].values.field(k).to_numpy() for k in ("rep", "first", "draws"))
            parts, base = Parts(sizes.astype(np.int64)), (col["base0"][r].as_py(), col["base1"][r].as_py())
            n = np.array([parts.counts(int(d), *base, int(a), int(f)) for a, f, d in zip(rep, first, draws, strict=True)])
            which, hit = np.nonzero(n)
            fixed = [pa.array(np.full(len(hit), col[k][r].as_py(), np.int32)) for k in ("gk", "label")]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(child[hit]), pa.array(rep[which].astype(np.int32)), pa.array(n[which, hit])], names=["gk", "label", "span", "rep", "cnt"])


def _cell_counts(cells: DataFrame, groups: DataFrame, keys: list[str], reps: int, seed: int, fan: int, top: int, unit: int) -> DataFrame:
    """(gk, label, span = cell, rep, cnt): each class's draws per cell and replicate.

    ``cells(gk, label, cell, m)`` has the class's rows per cell.  One step a level of spans; a span's parts travel once for
    about ``unit`` draws, which are several replicates' or a block of one's.
    """
    rep = F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")
    counts = cells.groupBy("gk", "label").agg(F.sum("m").alias("cnt")).select("gk", "label", F.lit(0).cast("long").alias("span"), rep, "cnt")
    for level in range(top, 0, -1):
        parts = cells.select("gk", "label", F.expr(f"cell div {fan ** (level - 1)}").alias("child"), "m").groupBy("gk", "label", "child").agg(F.sum("m").alias("m"))
        parts = parts.groupBy("gk", "label", F.expr(f"child div {fan}").alias("span")).agg(F.sort_array(F.collect_list(F.struct("child", "m"))).alias("parts"))
        base = [md5_base(*[F.col(k) for k in keys], F.col("label"), F.lit(seed), F.lit(level), F.col("span"), part=i).alias(f"base{i}") for i in (0, 1)]
        parts = parts.join(groups, "gk").select("gk", "label", "span", "parts", *base)
        span, total = ["gk", "label", "span"], F.aggregate("parts", F.lit(0).cast("long"), lambda n, c: n + c["m"])
        # replicates that make a unit together; the parts themselves join after that
        many = parts.select(*span, F.greatest(F.lit(1).cast("long"), F.floor(F.lit(unit) / total)).alias("many"), (F.size("parts") == 1).alias("alone"))
        alone, first = F.col("alone"), F.col("block") * unit
        block = F.when(alone, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.expr(f"(cnt - 1) div {unit}")))
        work = counts.where("cnt > 0").join(many, span).select("*", F.expr("rep div many").alias("chunk"), F.explode(block).alias("block"))
        todo = F.struct("rep", first.alias("first"), F.when(alone, F.col("cnt")).otherwise(F.least(F.lit(unit), F.col("cnt") - first)).alias("draws"))
        work = work.groupBy(*span, "chunk", "block").agg(F.collect_list(todo).alias("todo")).join(parts, span)
        work = work.repartition(max(1, counts.sparkSession.sparkContext.defaultParallelism * 4), "gk", "label", "chunk", "block")
        counts = work.mapInArrow(_split, "gk int, label int, span long, rep int, cnt long").groupBy("gk", "label", "span", "rep").agg(F.sum("cnt").alias("cnt"))
    return counts


def _cell_auc(key: tuple, scores: pa.Table, drawn: pa.Table) -> pa.Table:
    """Positives, negatives and concordant pairs drawn in one cell, for each replicate of one part of them."""
    scores = scores.sort_by("score")
    sizes = {1: scores.column("pos").to_numpy(), 0: scores.column("neg").to_numpy()}
    none = {"base0": 0, "base1": 0, "cnt": {}}
    of = {0: none, 1: none} | {r["d_label"]: {"base0": r["d_base0"], "base1": r["d_base1"], "cnt": {c["rep"]: c["cnt"] for c in r["d_cnt"]}} for r in drawn.to_pylist()}
    rows, parts = [], {y: Parts(n) for y, n in sizes.items()}
    for rep in sorted({*of[0]["cnt"], *of[1]["cnt"]}):
        w1, w0 = (parts[y].counts(of[y]["cnt"].get(rep, 0), of[y]["base0"], of[y]["base1"], rep) for y in (1, 0))
        below = np.cumsum(w0) - w0
        rows.append((rep, int(w1.sum()), int(w0.sum()), float(w1 @ below + (w1 @ w0) * 0.5)))
    gk, cell, _ = (k.as_py() if hasattr(k, "as_py") else k for k in key)
    rep, p, q, s = zip(*rows, strict=True) if rows else ((), (), (), ())
    out = {"gk": pa.array([gk] * len(rows), pa.int32()), "cell": pa.array([cell] * len(rows), pa.int64()), "rep": pa.array(rep, pa.int32())}
    return pa.table(out | {"p": pa.array(p, pa.int64()), "q": pa.array(q, pa.int64()), "s": pa.array(s, pa.float64())})


def auc_bootstrap(
    pred: DataFrame, keys: Sequence[str] = ("study", "model"), reps: int = 1000, seed: int = 42, cell: int | None = None, fan: int | None = None,
) -> DataFrame:
    """Stratified bootstrap of the AUC: 2.5 / 50 / 97.5 % percentiles over ``reps`` resamples.

    Rows without a score or with a label other than 0 and 1 are left out; a group with one class has no AUC (n_reps 0, NULL bounds).
    Output: keys, n_reps, auc_lo, auc_med, auc_hi.
    """
    keys, cell, fan = list(keys), cell or CELL, fan or FAN
    spark = pred.sparkSession
    p = pred.where(F.col("label").isin(0, 1) & F.col("score").isNotNull())
    c = p.groupBy(*keys, F.col("score").cast("double").alias("score")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    c = reuse(c)
    # one row a group: numbering them in a single window is bounded by the number of groups
    groups = reuse(c.select(*keys).distinct().withColumn("gk", F.row_number().over(Window.orderBy(*keys))))
    c = null_safe_join(c, groups, keys).select("gk", "score", "pos", "neg").withColumn("n", F.col("pos") + F.col("neg"))
    s = ordered_scan(c, ["gk"], ["score"], sums=["n"])
    s = reuse(s.select("gk", F.expr(f"(n_cum - n) div {cell}").alias("cell"), "score", "pos", "neg"))
    size = F.explode(F.array(*[F.struct(F.lit(y).alias("label"), F.col(c).alias("m")) for y, c in ((1, "pos"), (0, "neg"))])).alias("x")
    cells = reuse(s.groupBy("gk", "cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).select("gk", "cell", size).select("gk", "x.label", "cell", "x.m").where("m > 0"))
    last, n_cells, n = cells.agg(F.max("cell"), F.count_distinct("gk", "cell"), F.sum("m")).first()
    top, spans = 0, (last or 0) + 1
    while spans > 1:
        top, spans = top + 1, -(-spans // fan)
    # few cells: their replicates are dealt out too
    chunks = max(1, min(reps, 4 * spark.sparkContext.defaultParallelism // max(1, n_cells)))
    unit = min(max(UNIT[0], (n or 0) * reps // (8 * spark.sparkContext.defaultParallelism)), UNIT[1])
    counts = _cell_counts(cells, groups, keys, reps, seed, fan, top, unit).select("gk", "label", F.col("span").alias("cell"), (F.col("rep") % chunks).alias("chunk"), "rep", "cnt")
    base = [md5_base(*[F.col(k) for k in keys], F.col("label"), F.lit(seed), F.lit(0), F.col("cell"), part=i).alias(f"base{i}") for i in (0, 1)]
    drawn = counts.groupBy("gk", "cell", "chunk", "label").agg(F.collect_list(F.struct("rep", "cnt")).alias("cnt"))
    drawn = drawn.join(groups, "gk").select("gk", "cell", "chunk", "label", "cnt", *base)
    dealt = s.select("gk", "cell", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "score", "pos", "neg")
    on = ["gk", "cell", "chunk"]
    drawn = drawn.toDF(*[f"d_{c}" for c in drawn.columns])  # both sides come from the same scores: names that tell them apart
    found = dealt.groupBy(*on).cogroup(drawn.groupBy(*[f"d_{c}" for c in on])).applyInArrow(_cell_auc, "gk int, cell long, rep int, p long, q long, s double")
    w = Window.partitionBy("gk", "rep").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("q").over(w), F.lit(0))
    a = found.select("gk", "rep", "p", "q", (F.col("s") + F.col("p") * below).alias("s")).groupBy("gk", "rep").agg(
        F.try_divide(F.sum("s"), F.sum("p").cast("double") * F.sum("q")).alias("auc")
    )
    out = a.groupBy("gk").agg(
        F.count("auc").alias("n_reps"),
        *[F.percentile("auc", F.lit(q)).alias(name) for q, name in ((0.025, "auc_lo"), (0.5, "auc_med"), (0.975, "auc_hi"))],
    )
    return groups.join(out, "gk").select(*keys, "n_reps", "auc_lo", "auc_med", "auc_hi")
