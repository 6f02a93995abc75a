"""The corpus pipeline: one stage after the other over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet to the shared folder and read again as the next stage's
documents.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import decontam, minhash_forest, mixing, substring, toxicity
from sigspark.llm.lookup import fresh, with_ids
from sigspark.llm.queries import TOXIC, table
from sigspark.session import cut_lineage, scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below TOXIC."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs.columns, "score")
    return toxicity.score(docs, model, keep=tuple(docs.columns), out_col=score).where(F.col(score) < TOXIC).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies (shingles of five words, similarity 0.8); documents without an id stay."""
    found = minhash_forest.near_duplicates(docs, k=5, least=80)
    copies = cut_lineage(found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct())
    return with_ids(docs, "doc_id", copies, "left_anti")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id holds; what holds nothing else goes."""
    return substring.cut_passages(docs, substring.near_passages(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    found = decontam.search(docs, table(spark, sf_dir, "benchmark"))
    return with_ids(docs, "doc_id", cut_lineage(found.select("doc_id").distinct()), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, repeats counted (the texts stay in the stage before)."""
    return mixing.mix_sources(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: A learned score and hashed candidate search have no SQL form; tests hold the result against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
