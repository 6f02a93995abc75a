"""Joins with a set of ids whose size is measured first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many ids (8 bytes each) travel to every executor; beyond that both sides are shuffled.
MAX_BROADCAST_IDS = 2_000_000


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so (whatever the case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_ids(df: DataFrame, col: str, ids: DataFrame, how: str = "left_semi", rows: int | None = None) -> DataFrame:
    """``df`` rows whose ``col`` is (left_semi) or is not (left_anti) in ``ids``, one long column without repeats.

    ``ids`` is to be materialised (checkpoint or table); its count decides between a broadcast and a shuffle.
    A null ``col`` is in no set.
    """
    name = fresh(df.columns, "__id")
    ids = ids.select(F.col(ids.columns[0]).alias(name))
    if (ids.count() if rows is None else rows) <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, df[col] == ids[name], how)
