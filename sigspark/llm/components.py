"""Connected components of a link table, as Spark joins and grouped minima.

Alternates large-star and small-star steps (Kiveris et al., "Connected
components in MapReduce and beyond", 2014): the links of every node are
turned towards the smallest node known, until a round changes nothing.
Each round is a grouped minimum (combined map-side, so a hub with a third of
all links is no hot task) and a join, which Spark splits where a hub's links
are many.  Rounds are cut off with a reliable checkpoint.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.session import cut_lineage


def lowest(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each row of one small group reaches, by its matrix of links."""
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(near, low[None], np.iinfo(np.int64).max).min(1))
        if (new == low).all():
            return low
        low = new


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return both.join(low, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    moved = down.join(low, F.col("a") == F.col("n"))
    return moved.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    ``links`` holds two long columns; nulls and self links count as no link,
    repeats and either direction are fine.  No links give an empty table.
    """
    e = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    e = cut_lineage(e)
    state = None
    while True:
        e = cut_lineage(_small_star(_large_star(e)))
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return found.unionByName(roots)
