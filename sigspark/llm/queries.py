"""The registered queries of this subpackage: one thin query per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.session import cut_lineage, scratch_path

from . import alignment, capfilter, codes, decontam, html, langid, licenses, minhash_forest, mixing, rules, substring, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False)))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


#: A document with this score or more is toxic.
TOXIC = 0.3


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(docs, model, keep=("doc_id", held_out.alias("held_out")))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


@query
def op8_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.near_passages(table(spark, sf_dir, "documents"))
    return found.withColumnsRenamed({"id": "doc_id", "other": "other_doc_id"})


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    book = codes.train(vectors)
    if book is None:
        return vectors.limit(0).selectExpr("vec_id", "'' as code", "0L as error", "0L as label_error", "'' as codebooks_sha256")
    coded = codes.with_group_error(cut_lineage(codes.encode(vectors, book, keep=("vec_id", "label"))))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(book.sha256()).alias("codebooks_sha256"))


def _codes_sql(parts: int = codes.PARTS, entries: int = codes.ENTRIES, rounds: int = codes.ROUNDS, scale: int = codes.SCALE) -> str:
    """The codes over a table of components; the squared distance and the entry are one number, so its minimum breaks ties by index."""
    steps = [
        f"""k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS i, len(embedding) // {parts} AS width FROM embeddings
  WHERE len(embedding) > 0 AND len([1 FOR v IN embedding IF v IS NULL OR NOT isfinite(v)]) = 0)""",
        f"""x AS MATERIALIZED (SELECT i, j // width AS p, j % width AS j, CAST(floor(CAST(embedding[j + 1] AS DOUBLE) * {scale}) AS BIGINT) AS q
  FROM (SELECT i, width, embedding, unnest(range(0, len(embedding))) AS j FROM k))""",
        f"c0 AS MATERIALIZED (SELECT i AS e, p, j, q FROM x WHERE i < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT i, p, min(d * {entries} + e) AS m FROM (SELECT x.i, p, c.e, sum((x.q - c.q) * (x.q - c.q))::BIGINT AS d
  FROM x JOIN c{r} c USING (p, j) GROUP BY x.i, p, c.e) GROUP BY i, p)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c.e, p, j, CASE WHEN n IS NULL THEN c.q ELSE (s - (s % n + n) % n) // n END AS q
  FROM c{r} c LEFT JOIN (SELECT m % {entries} AS e, p, j, sum(q)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (i, p) GROUP BY ALL) t USING (e, p, j))"""
            )
    return f"""WITH {", ".join(steps)},
r AS (SELECT i, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY i)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(q::VARCHAR, ',' ORDER BY p, e, j)) FROM c{rounds}) AS codebooks_sha256
FROM r JOIN k USING (i)"""


ORACLES["op11_vector_codes"] = _codes_sql()


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    found = alignment.align(table(spark, sf_dir, "documents"), a, b)
    path = scratch_path(spark, "alignment")  # written: the counts over all texts come before any row's sums
    found.select(*[c for c in found.columns if c != "groups"], digest, F.monotonically_increasing_id().alias("row")).write.parquet(path)
    aligned = spark.read.parquet(path)
    counted = alignment.with_counts(aligned, alignment.pair_counts(aligned, alignment.vocabulary_size(b)), "row")
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    verdicts = rules.train(docs, table(spark, sf_dir, "labels"), where=~failed)
    judged = rules.statistics(docs).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (verdicts.column() == 1)
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return judged.select(*base, kept.alias("kept"), verdicts.rule_column().alias("rule"))
