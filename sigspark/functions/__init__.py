"""Column expressions shared by the operators.

All helpers return ``Column`` objects built from ``pyspark.sql.functions``
so they stay inside whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Response labels of the clinical tables and their encoding.
RESPONDER = "R"
NON_RESPONDER = "NR"
LABEL_LEVELS = ("NR", "R")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bq(name: str) -> str:
    """Back-tick a column name that may hold ``-``, ``+`` or parentheses."""
    return "`" + name.replace("`", "``") + "`"


def encode_label(col, strict: bool = False) -> Column:
    """``R`` -> 0, anything else -> 1 (the training encoding).

    ``strict=True`` is the three-way form used for the logistic baseline:
    ``R`` -> 0, ``NR`` -> 1, anything else (including NULL) -> NULL.
    """
    c = _c(col)
    if strict:
        return F.when(c == RESPONDER, F.lit(0)).when(c == NON_RESPONDER, F.lit(1))
    return F.when(c == RESPONDER, F.lit(0)).otherwise(F.lit(1))


def as_factor(col, levels=LABEL_LEVELS) -> Column:
    """Restrict to a domain: values outside ``levels`` become NULL."""
    c = _c(col)
    return F.when(c.isin(*levels), c)


def to_double(col) -> Column:
    """Numeric coercion; unparsable text becomes NULL instead of failing."""
    c = _c(col)
    return c.try_cast("double")


def md5_uniform(*cols) -> Column:
    """Deterministic U[0,1) draw from the key columns.

    u = first 8 hex digits of md5(key) / 2^32, key = '|'-joined text of the
    columns.  DuckDB gives the same number with
    ``('0x' || substr(md5(key), 1, 8))::bigint / 4294967296``.
    """
    key = F.concat_ws("|", *[_c(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sigmoid(col) -> Column:
    c = _c(col)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def study_of(path_col) -> Column:
    """Study key from a file path: strip directory, extension and the
    training-set prefix/suffix (``train_set_<study>_filtered.csv``)."""
    base = F.regexp_extract(_c(path_col), r"([^/]+?)(\.[^./]*)?$", 1)
    base = F.regexp_replace(base, r"^train_set_", "")
    base = F.regexp_replace(base, r"_filtered$", "")
    return F.trim(base)


def study_parts(study_col) -> Column:
    """``ICB_<cohort>__<cancer>__<treatment>`` -> struct(cohort, cancer, treatment)."""
    s = F.trim(_c(study_col))
    parts = F.split(s, "__")
    return F.struct(
        F.regexp_replace(F.get(parts, 0), r"^ICB_", "").alias("cohort"),
        F.get(parts, 1).alias("cancer"),
        F.get(parts, 2).alias("treatment"),
    )


# Multipliers of the 32-bit integer mixing hash of the bootstrap's draws.
GOLD = (2654435761, 3266489917)  # steps of the replicate, one for each half of the state
STEP = (2246822519, 668265263)  # steps of the draw
MIX = 73244475


def md5_base(*cols, part: int = 0) -> Column:
    """32-bit integer key from eight hex digits of md5, the ``part``-th of them (see :func:`md5_uniform`)."""
    key = F.concat_ws("|", *[_c(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1 + 8 * part, 8), 16, 10).cast("bigint")
