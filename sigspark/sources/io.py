"""File sources and sinks.

* training sets: CSV with a header, numeric feature columns in a fixed
  order, ``response`` last, one study per file (or per ``study=`` folder);
* name lists: one name per line;
* cohort tables: parquet long tables (expression, clinical, signatures,
  signature_info) partitioned by ``study`` - our form of the per-study
  experiment containers;
* model documents: see :mod:`sigspark.operators.trees`.

Explicit schemas everywhere; schema inference is for tests only.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bq, study_of


def train_schema(names: Sequence[str], label: str = "response") -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType(), True) for n in names] + [T.StructField(label, T.StringType(), True)])


def read_train(spark: SparkSession, path: str, names: Sequence[str] | None = None, glob: str = "*.csv") -> DataFrame:
    """Read training CSVs; adds ``study`` from the file name unless the data is
    partitioned by a ``study=`` folder.

    Columns are matched by each file's own header, whatever their order; other columns
    are left out, and a name that a file lacks is an error.  One job finds the files of each
    header line; files with the same header are one scan.  ``names=None`` infers (tests only).
    """
    reader = spark.read.option("header", True).option("pathGlobFilter", glob)
    if names is None:
        df = reader.option("inferSchema", True).csv(path)
        return df if "study" in df.columns else df.withColumn("study", study_of(F.col("_metadata.file_name")))
    by_header: dict[tuple[str, ...], list[str]] = {}
    for r in _header_lines(spark, path, glob):
        by_header.setdefault(tuple(spark.read.option("header", True).csv(_escaped(r.files[0])).columns), []).extend(r.files)
    wanted, out = train_schema(names), None
    for header, files in by_header.items():
        missing = [c for c in wanted.names if c not in header]
        if missing:
            raise ValueError(f"{files[0]} has no column {', '.join(missing[:5])}")
        schema = T.StructType([wanted[c] if c in wanted.names else T.StructField(c, T.StringType()) for c in header])
        part = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv([_escaped(f) for f in files])
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"study=([^/]+)/", 1)
        plain = lambda c: F.url_decode(F.regexp_replace(c, r"\+", "%2B"))  # noqa: E731 - '+' stands for itself
        name = plain(plain(folder))  # Spark escapes the value, and the path's URI once more
        study = F.when(folder != "", name).otherwise(study_of(F.col("_metadata.file_name")))
        part = part.select(*[F.col(bq(c)) for c in wanted.names], study.alias("study"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no file matches {glob} in {path}")
    return out


def _header_lines(spark: SparkSession, path: str, glob: str) -> list:
    """(header line, its files in order), one row per distinct header line: found in one job, one or a few a study travel.

    Of a file that is read in several pieces, only the first is looked at.
    """
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    at = lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_block_start").alias("block"))
    first = at.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("line"))
    return first.groupBy("line").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy(F.col("files")[0]).collect()


def _escaped(path: str) -> str:
    """A listed path as a reader takes it: letters that globs give a meaning are escaped."""
    return re.sub(r"([{}\[\]*?])", r"\\\1", path)


def _by_study(df: DataFrame, by: Sequence[str] = ("study",)):
    """Writer that replaces the studies of ``df`` and leaves those it does not hold.

    Spark writes the new folders beside the table and puts them in their place when the whole
    job has succeeded, so a job that fails leaves the old data as it was.
    """
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)


def write_train(df: DataFrame, path: str, names: Sequence[str], label: str = "response") -> None:
    """One folder per study, features in ``names`` order, then the label; studies that are not in ``df`` stay."""
    _by_study(df.select("study", *[F.col(bq(n)) for n in names], F.col(bq(label)))).option("header", True).csv(path)


def read_list(spark: SparkSession, path: str, col: str = "value") -> DataFrame:
    """One name per line; blank lines dropped; ``pos`` keeps file order
    (increasing, not dense, across file splits)."""
    return (
        spark.read.text(path)
        .select(F.trim("value").alias(col))
        .where(F.col(col) != "")
        .withColumn("pos", F.monotonically_increasing_id())
    )


COHORT_TABLES = ("expression", "clinical", "signatures", "signature_info")


def write_table(df: DataFrame, path: str, by: Sequence[str] = ("study",)) -> None:
    """Parquet by ``by``; the parts that ``df`` holds are replaced, the others stay (without ``by`` the whole table is replaced)."""
    (_by_study(df, by) if by else df.write.mode("overwrite")).parquet(path)


def read_cohort(spark: SparkSession, root: str, names: Sequence[str] = COHORT_TABLES) -> dict[str, DataFrame]:
    """The long cohort tables ``names`` under ``root/<name>``; filters on ``study`` prune partitions.

    A table that is not there is an error: name those that a cohort has.
    """
    return {name: spark.read.parquet(os.path.join(root, name)) for name in names}


#: Buckets of a cohort table: a power of two, so that tables of different sizes can share them.
BUCKETS = 256


def write_bucketed(df: DataFrame, table: str, path: str, by: Sequence[str] = ("study", "patientid"), buckets: int = BUCKETS) -> DataFrame:
    """Write ``df`` under ``path`` as the catalog table ``table``, bucketed and sorted by ``by``; read back from the catalog.

    Two tables with the same buckets over the same columns (expression and clinical by (study, patientid)) are
    joined and grouped on them without a shuffle of either.  Rows are dealt to their buckets before the write,
    so each bucket is one file.
    """
    dealt = df.repartition(buckets, *[F.col(bq(c)) for c in by])
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, *by).sortBy(*by).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def write_list(df: DataFrame, path: str, col: str = "value") -> None:
    """Write a name list, one per line, in ``col`` order.

    A name list is a small dimension (feature or signature names), so it is
    written as one file to keep the line order.
    """
    df.select(F.col(col).cast("string")).orderBy(col).coalesce(1).write.mode("overwrite").text(path)
