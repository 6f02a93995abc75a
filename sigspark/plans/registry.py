"""Registry of named queries: key -> (Spark builder, DuckDB oracle SQL or None).

Each Spark builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame
over the driver tables; each oracle is plain SQL over the same tables.
Queries without a SQL form (iterative fits) register ``sql=None`` and are
checked against brute force in the tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return deco


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """``df`` with ``cols`` rounded: for the comparison only, operators never round."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def load_all() -> None:
    """Import every query module so that its keys register."""
    from . import q_roc  # noqa: F401
    from . import q_cohort  # noqa: F401
    from . import q_signatures  # noqa: F401
    from . import q_trees  # noqa: F401
    from . import q_boost  # noqa: F401
    from . import q_compare  # noqa: F401
