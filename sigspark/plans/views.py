"""Stand-in views over the driver tables.

The reference's own inputs (per-study expression matrices, clinical tables,
model files) are tiny and partly missing, so every operator is also run on
the driver's parquet tables through these fixed views.  Each view exists
twice: as a Spark DataFrame (``v_*``) and as a DuckDB CTE (``SQL_V[...]``)
used by the oracles.  Both read whole tables.

| view     | plays            | built from                                   |
|----------|------------------|----------------------------------------------|
| v_clin   | clinical         | customer x nation                            |
| v_expr   | expression       | lineitem x part x supplier x nation          |
| v_sig    | signatures       | part                                         |
| v_scores | long scores      | events                                       |
| v_wide   | training set     | embeddings                                   |
| v_pred   | predictions      | lineitem                                     |
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# Fixed values of the stand-in views.
N_WIDE_FEATURES = 8  # features taken from each embedding
WIDE_STUDIES = 4  # v_wide study = vec_id % 4
SCORE_STUDIES = 7  # v_scores study = user_id % 7
RESPONSE_CUT = 5000.0  # v_clin: acctbal >= 5000 -> R, 0 <= acctbal < 5000 -> NR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def v_clin(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    bal = F.col("c_acctbal")
    return cust.join(nation, cust.c_nationkey == nation.n_nationkey).select(
        F.col("n_name").alias("study"),
        F.col("c_custkey").alias("patientid"),
        F.when(bal >= RESPONSE_CUT, F.lit("R")).when(bal >= 0, F.lit("NR")).alias("response"),
    )


def v_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    # aggregate right after the part join: the (supplier, brand) aggregate has
    # map-side partial sums, and the supplier/nation dimension joins then see
    # one row per (supplier, brand) instead of one per line item.
    per_gene = (
        li.join(part, li.l_partkey == part.p_partkey)
        .groupBy("l_suppkey", "p_brand")
        .agg(F.sum("l_quantity").alias("value"))
    )
    geo = supp.join(nation, supp.s_nationkey == nation.n_nationkey).select("s_suppkey", "n_regionkey")
    return per_gene.join(geo, per_gene.l_suppkey == geo.s_suppkey).select(
        F.col("n_regionkey").alias("study"),
        F.col("l_suppkey").alias("patientid"),
        F.col("p_brand").alias("gene"),
        F.col("value").cast("double").alias("value"),
    )


def v_sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_type", "p_brand", "p_size")
    g = part.groupBy(F.col("p_type").alias("signature"), F.col("p_brand").alias("gene")).agg(
        F.sum("p_size").alias("s")
    )
    return g.where(F.col("s") % 2 == 0).select(
        "signature", "gene", ((F.col("s") % 5) - 2).cast("double").alias("weight")
    )


def v_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    return ev.groupBy(
        (F.col("user_id") % SCORE_STUDIES).alias("study"),
        F.col("user_id").alias("patientid"),
        F.col("event_type").alias("signature"),
    ).agg(F.avg("value").alias("score"))


def v_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    y = (F.col("label") % 2).cast("int")
    return emb.select(
        (F.col("vec_id") % WIDE_STUDIES).alias("study"),
        F.col("vec_id").alias("row_id"),
        F.slice("embedding", 1, N_WIDE_FEATURES).cast("array<double>").alias("features"),
        y.alias("y"),
        F.when(y == 0, F.lit("R")).otherwise(F.lit("NR")).alias("response"),
    )


def v_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pred(study, model, rid, label, score): two score columns act as two models.

    One scan of lineitem; ``explode`` of a two-element array yields both
    models (no union, no second scan).  label: 0 = responder (R), 1 = not (A);
    rows with flag N have no label, and the operators drop them.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount", "l_extendedprice"
    )
    m = F.explode(
        F.array(
            F.struct(F.lit("discount").alias("model"), F.col("l_discount").alias("score")),
            F.struct(F.lit("price").alias("model"), F.col("l_extendedprice").alias("score")),
        )
    ).alias("m")
    return li.select(
        F.col("l_linestatus").alias("study"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rid"),
        F.when(F.col("l_returnflag") == "R", F.lit(0)).when(F.col("l_returnflag") == "A", F.lit(1)).alias("label"),
        m,
    ).select("study", F.col("m.model").alias("model"), "rid", "label", F.col("m.score").alias("score"))


MIN_EVENTS = 10  # v_scores_sup: a score needs at least this many events, else NULL


def v_uclin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clinical table keyed like ``v_scores``: study = custkey % 7, patientid = custkey."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    bal = F.col("c_acctbal")
    return cust.select(
        (F.col("c_custkey") % SCORE_STUDIES).alias("study"),
        F.col("c_custkey").alias("patientid"),
        F.when(bal >= RESPONSE_CUT, F.lit("R")).when(bal >= 0, F.lit("NR")).alias("response"),
    )


def v_sclin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clinical table keyed like ``v_expr``: study = region of the supplier, patientid = suppkey."""
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    bal = F.col("s_acctbal")
    return supp.join(nation, supp.s_nationkey == nation.n_nationkey).select(
        F.col("n_regionkey").alias("study"),
        F.col("s_suppkey").alias("patientid"),
        F.when(bal >= RESPONSE_CUT, F.lit("R")).when(bal >= 0, F.lit("NR")).alias("response"),
    )


def v_scores_sup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_scores`` with a support rule: fewer than MIN_EVENTS events -> NULL score."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    return ev.groupBy(
        (F.col("user_id") % SCORE_STUDIES).alias("study"),
        F.col("user_id").alias("patientid"),
        F.col("event_type").alias("signature"),
    ).agg(F.when(F.count(F.lit(1)) >= MIN_EVENTS, F.avg("value")).alias("score"))


VIEWS = {
    "v_uclin": v_uclin,
    "v_sclin": v_sclin,
    "v_scores_sup": v_scores_sup,
    "v_clin": v_clin,
    "v_expr": v_expr,
    "v_sig": v_sig,
    "v_scores": v_scores,
    "v_wide": v_wide,
    "v_pred": v_pred,
}

# DuckDB text of the same views, used as CTEs by the oracles.
SQL_V = {
    "v_uclin": """v_uclin AS (
  SELECT c_custkey % 7 AS study, c_custkey AS patientid,
         CASE WHEN c_acctbal >= 5000 THEN 'R' WHEN c_acctbal >= 0 THEN 'NR' END AS response
  FROM customer)""",
    "v_sclin": """v_sclin AS (
  SELECT n.n_regionkey AS study, s.s_suppkey AS patientid,
         CASE WHEN s.s_acctbal >= 5000 THEN 'R' WHEN s.s_acctbal >= 0 THEN 'NR' END AS response
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey)""",
    "v_scores_sup": """v_scores_sup AS (
  SELECT user_id % 7 AS study, user_id AS patientid, event_type AS signature,
         CASE WHEN count(*) >= 10 THEN avg(value) END AS score
  FROM events GROUP BY user_id % 7, user_id, event_type)""",
    "v_clin": """v_clin AS (
  SELECT n.n_name AS study, c.c_custkey AS patientid,
         CASE WHEN c.c_acctbal >= 5000 THEN 'R' WHEN c.c_acctbal >= 0 THEN 'NR' END AS response
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)""",
    "v_expr": """v_expr AS (
  SELECT n.n_regionkey AS study, g.l_suppkey AS patientid, g.p_brand AS gene, CAST(g.value AS DOUBLE) AS value
  FROM (SELECT l.l_suppkey, p.p_brand, sum(l.l_quantity) AS value
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_suppkey, p.p_brand) g
  JOIN supplier s ON g.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey)""",
    "v_sig": """v_sig AS (
  SELECT signature, gene, CAST((s % 5) - 2 AS DOUBLE) AS weight
  FROM (SELECT p_type AS signature, p_brand AS gene, CAST(sum(p_size) AS BIGINT) AS s
        FROM part GROUP BY p_type, p_brand) WHERE s % 2 = 0)""",
    "v_scores": """v_scores AS (
  SELECT user_id % 7 AS study, user_id AS patientid, event_type AS signature, avg(value) AS score
  FROM events GROUP BY user_id % 7, user_id, event_type)""",
    "v_wide": """v_wide AS (
  SELECT vec_id % 4 AS study, vec_id AS row_id, CAST(embedding[1:8] AS DOUBLE[]) AS features,
         CAST(label % 2 AS INTEGER) AS y, CASE WHEN label % 2 = 0 THEN 'R' ELSE 'NR' END AS response
  FROM embeddings)""",
    "v_pred": """v_pred AS (
  SELECT l_linestatus AS study, 'discount' AS model, l_orderkey * 10 + l_linenumber AS rid,
         CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 END AS label, l_discount AS score
  FROM lineitem
  UNION ALL
  SELECT l_linestatus AS study, 'price' AS model, l_orderkey * 10 + l_linenumber AS rid,
         CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 END AS label, l_extendedprice AS score
  FROM lineitem)""",
}


def with_views(body: str, *names: str, extra: str = "") -> str:
    """Prefix ``body`` with the CTEs of the named views (and extra CTE text)."""
    parts = [SQL_V[n] for n in names]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n" + body
