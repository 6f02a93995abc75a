"""Query keys for sources, filters, reshaping, joins, set operations and cohort aggregates."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import as_factor, encode_label, study_of, study_parts, to_double
from ..operators import cohort, reshape
from ..session import scratch_path
from ..sources import io
from .registry import query
from .views import v_clin, v_expr, v_sclin, v_scores, v_scores_sup, v_sig, v_uclin, v_wide, with_views

# Fixed values of the stand-in queries.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]  # the signature names of v_scores
SELECTED = ["click", "purchase", "view"]  # the "selected signatures" list
MIN_COHORT = 55  # min_cohort threshold on v_clin (36-68 labelled per study at sf0.01)
VALUE_FLOOR = 550.0  # gene_filter floor on v_expr values
MISSING_PERC = 0.5
N_CUTOFF = 15
SIG_PERC = 0.8
WIDE_NAMES = [f"f{i}" for i in range(1, 9)]


def _in_list(names):
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _wide_sql(src: str, names=EVENT_TYPES, name: str = "w", where: str = "") -> str:
    cols = ", ".join(f"max(CASE WHEN signature = '{n}' THEN score END) AS \"{n}\"" for n in names)
    return f"{name} AS (SELECT study, patientid, {cols} FROM {src} {where} GROUP BY study, patientid)"


_LAB = "lab AS (SELECT * FROM v_clin WHERE patientid IS NOT NULL AND response IS NOT NULL)"
_CS = """ok AS (SELECT study, signature FROM v_scores_sup GROUP BY study, signature HAVING bool_and(score IS NOT NULL)),
cs AS (SELECT s.* FROM v_scores_sup s JOIN ok USING (study, signature))"""
_MISS = (
    _CS
    + f""",
have AS (SELECT DISTINCT study, signature FROM cs),
names AS (SELECT unnest({EVENT_TYPES!r}) AS signature),
miss AS (SELECT s.study, n.signature FROM (SELECT DISTINCT study FROM cs) s CROSS JOIN names n
         WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.study = s.study AND h.signature = n.signature))"""
)
_GF = f"""gf AS (SELECT e.* FROM v_expr e JOIN (
  SELECT study, gene FROM v_expr GROUP BY study, gene
  HAVING avg(CASE WHEN value <= {VALUE_FLOOR} THEN 1.0 ELSE 0.0 END) <= {MISSING_PERC}) k USING (study, gene))"""


@query(
    "labelled",
    with_views("SELECT * FROM lab", "v_clin", extra=_LAB),
)
def q_labelled(spark, sf):
    return cohort.labelled(v_clin(spark, sf))


@query(
    "min_cohort",
    with_views(
        f"SELECT * FROM lab WHERE study IN (SELECT study FROM lab GROUP BY study HAVING count(*) >= {MIN_COHORT})",
        "v_clin",
        extra=_LAB,
    ),
)
def q_min_cohort(spark, sf):
    return cohort.min_cohort(v_clin(spark, sf), MIN_COHORT)


@query(
    "label_domain",
    with_views(
        """SELECT study, patientid, coalesce(response, 'SD') AS raw,
       CASE WHEN coalesce(response, 'SD') IN ('NR', 'R') THEN coalesce(response, 'SD') END AS response
FROM v_clin""",
        "v_clin",
    ),
)
def q_label_domain(spark, sf):
    c = v_clin(spark, sf).withColumn("raw", F.coalesce("response", F.lit("SD")))
    return c.select("study", "patientid", "raw", as_factor("raw").alias("response"))


@query(
    "encode_label",
    with_views(
        """SELECT study, patientid, response,
       CASE WHEN response = 'R' THEN 0 ELSE 1 END AS label,
       CASE WHEN response = 'R' THEN 0 WHEN response = 'NR' THEN 1 END AS label_strict
FROM v_clin""",
        "v_clin",
    ),
)
def q_encode_label(spark, sf):
    c = v_clin(spark, sf)
    return c.select(
        "study", "patientid", "response", encode_label("response").alias("label"),
        encode_label("response", strict=True).alias("label_strict"),
    )


@query(
    "numeric_coerce",
    """SELECT event_id, regexp_extract(props, '"k": *([0-9.]+)', 1) AS k_text,
       TRY_CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) AS k,
       TRY_CAST(event_type AS DOUBLE) AS type_num
FROM events""",
)
def q_numeric_coerce(spark, sf):
    from .views import table

    ev = table(spark, sf, "events").select("event_id", "props", "event_type")
    k_text = F.regexp_extract("props", r'"k": *([0-9.]+)', 1)
    return ev.select("event_id", k_text.alias("k_text"), to_double(k_text).alias("k"), to_double("event_type").alias("type_num"))


@query(
    "restrict_signatures",
    with_views(f"SELECT * FROM v_scores WHERE signature IN {_in_list(SELECTED)}", "v_scores"),
)
def q_restrict_signatures(spark, sf):
    return cohort.restrict(v_scores(spark, sf), cohort.names_frame(spark, SELECTED))


@query(
    "restrict_samples",
    with_views(
        """SELECT e.* FROM v_expr e
WHERE EXISTS (SELECT 1 FROM v_sclin c WHERE c.study = e.study AND c.patientid = e.patientid
              AND c.patientid IS NOT NULL AND c.response IS NOT NULL)""",
        "v_expr",
        "v_sclin",
    ),
)
def q_restrict_samples(spark, sf):
    return cohort.restrict_samples(v_expr(spark, sf), v_sclin(spark, sf))


@query("complete_signatures", with_views("SELECT * FROM cs", "v_scores_sup", extra=_CS))
def q_complete_signatures(spark, sf):
    return cohort.complete_signatures(v_scores_sup(spark, sf))


@query("gene_filter", with_views("SELECT * FROM gf", "v_expr", extra=_GF))
def q_gene_filter(spark, sf):
    return cohort.gene_filter(v_expr(spark, sf), MISSING_PERC, VALUE_FLOOR)


_COV = (
    _GF
    + """,
samples AS (SELECT study, count(DISTINCT patientid) AS n_samples FROM gf GROUP BY study),
genes AS (SELECT DISTINCT study, gene FROM gf),
sg AS (SELECT DISTINCT signature, gene FROM v_sig),
ns AS (SELECT signature, count(*) AS n_genes FROM sg GROUP BY signature),
pr AS (SELECT g.study, sg.signature, count(*) AS n_present FROM genes g JOIN sg USING (gene) GROUP BY g.study, sg.signature),
cov AS (SELECT pr.study, pr.signature, n_samples, n_genes, n_present,
               (n_samples >= 15 AND n_present / n_genes > 0.8) AS pass
        FROM pr JOIN ns USING (signature) JOIN samples USING (study))"""
)


@query("coverage_gate", with_views("SELECT * FROM cov", "v_expr", "v_sig", extra=_COV))
def q_coverage_gate(spark, sf):
    return cohort.coverage(cohort.gene_filter(v_expr(spark, sf), MISSING_PERC, VALUE_FLOOR), v_sig(spark, sf), N_CUTOFF, SIG_PERC)


@query("to_wide", with_views("SELECT * FROM w", "v_scores", extra=_wide_sql("v_scores")))
def q_to_wide(spark, sf):
    return reshape.to_wide(v_scores(spark, sf), EVENT_TYPES)


@query(
    "to_long",
    with_views(
        "\nUNION ALL\n".join(f"SELECT study, patientid, '{n}' AS signature, \"{n}\" AS score FROM w" for n in EVENT_TYPES),
        "v_scores_sup",
        extra=_wide_sql("v_scores_sup"),
    ),
)
def q_to_long(spark, sf):
    return reshape.to_long(reshape.to_wide(v_scores_sup(spark, sf), EVENT_TYPES), EVENT_TYPES)


@query(
    "zero_fill",
    with_views(
        f"""SELECT study, patientid, signature, score FROM cs WHERE signature IN {_in_list(EVENT_TYPES)}
UNION ALL
SELECT sm.study, sm.patientid, m.signature, 0.0::DOUBLE
FROM (SELECT DISTINCT study, patientid FROM cs) sm JOIN miss m USING (study)""",
        "v_scores_sup",
        extra=_MISS,
    ),
)
def q_zero_fill(spark, sf):
    return reshape.zero_fill(cohort.complete_signatures(v_scores_sup(spark, sf)), EVENT_TYPES)


@query("missing_features", with_views("SELECT study, signature FROM miss", "v_scores_sup", extra=_MISS))
def q_missing_features(spark, sf):
    return reshape.missing_features(cohort.complete_signatures(v_scores_sup(spark, sf)), EVENT_TYPES)


@query(
    "select_features",
    with_views("SELECT study, patientid, view, click, purchase FROM w", "v_scores", extra=_wide_sql("v_scores")),
)
def q_select_features(spark, sf):
    return reshape.select_features(reshape.to_wide(v_scores(spark, sf), EVENT_TYPES), ["view", "click", "purchase"], keep=["study", "patientid"])


_JL = (
    _wide_sql("v_scores")
    + """,
jl AS (SELECT w.*, c.response FROM w JOIN v_uclin c USING (study, patientid) WHERE c.response IS NOT NULL)"""
)


@query("join_scores_labels", with_views("SELECT * FROM jl", "v_scores", "v_uclin", extra=_JL))
def q_join_scores_labels(spark, sf):
    return reshape.join_labels(reshape.to_wide(v_scores(spark, sf), EVENT_TYPES), v_uclin(spark, sf))


@query(
    "to_matrix",
    with_views(
        "SELECT study, patientid, CAST([" + ", ".join(f'"{n}"' for n in EVENT_TYPES) + "] AS DOUBLE[]) AS features, response FROM jl",
        "v_scores",
        "v_uclin",
        extra=_JL,
    ),
)
def q_to_matrix(spark, sf):
    j = reshape.join_labels(reshape.to_wide(v_scores(spark, sf), EVENT_TYPES), v_uclin(spark, sf))
    return reshape.to_matrix(j, EVENT_TYPES, "response", keep=["study", "patientid"])


@query("common_features", with_views(
    """SELECT signature FROM (SELECT DISTINCT study, signature FROM cs WHERE score IS NOT NULL)
GROUP BY signature HAVING count(*) = (SELECT count(DISTINCT study) FROM cs)""", "v_scores_sup", extra=_CS))
def q_common_features(spark, sf):
    return cohort.common_features(cohort.complete_signatures(v_scores_sup(spark, sf)))


@query(
    "pool_by_name",
    with_views(
        """SELECT study, patientid, click, view FROM w WHERE study < 4
UNION ALL BY NAME
SELECT study, patientid, click, purchase FROM w WHERE study >= 4""",
        "v_scores",
        extra=_wide_sql("v_scores"),
    ),
)
def q_pool_by_name(spark, sf):
    s = v_scores(spark, sf)
    a = reshape.to_wide(s.where(F.col("study") < 4), ["click", "view"])
    b = reshape.to_wide(s.where(F.col("study") >= 4), ["click", "purchase"])
    return cohort.pool(a, b)


@query(
    "schema_agreement",
    with_views(
        """SELECT count(*) AS n_studies, count(DISTINCT fs) AS n_feature_sets, count(DISTINCT fs) = 1 AS agree
FROM (SELECT study, list_sort(list(DISTINCT signature)) AS fs FROM cs GROUP BY study)""",
        "v_scores_sup",
        extra=_CS,
    ),
)
def q_schema_agreement(spark, sf):
    return cohort.schema_agreement(cohort.complete_signatures(v_scores_sup(spark, sf)))


@query(
    "cohort_summary",
    with_views(
        f"""SELECT pr.study, CAST(coalesce(n.sample_size, 0) AS BIGINT) AS sample_size,
       CAST(k AS BIGINT) AS num_selected_signature, CAST({len(SELECTED)} - k AS BIGINT) AS num_missing_signature
FROM (SELECT study, count(DISTINCT CASE WHEN score IS NOT NULL AND signature IN {_in_list(SELECTED)} THEN signature END) AS k
      FROM cs GROUP BY study) pr
LEFT JOIN (SELECT study, count(*) AS sample_size FROM (
             SELECT DISTINCT s.study, s.patientid FROM cs s
             JOIN (SELECT DISTINCT study, patientid FROM v_uclin WHERE patientid IS NOT NULL AND response IS NOT NULL) l
             USING (study, patientid))
           GROUP BY study) n USING (study)""",
        "v_scores_sup",
        "v_uclin",
        extra=_CS,
    ),
)
def q_cohort_summary(spark, sf):
    return cohort.cohort_summary(cohort.complete_signatures(v_scores_sup(spark, sf)), v_uclin(spark, sf), SELECTED)


_KEY = "'ICB_' || n_name || '__' || lower(c_mktsegment) || '__PD-(L)1'"


@query(
    "study_key_parse",
    f"""SELECT c_custkey, study, regexp_replace(string_split(study, '__')[1], '^ICB_', '') AS cohort,
       string_split(study, '__')[2] AS cancer, string_split(study, '__')[3] AS treatment
FROM (SELECT c_custkey, trim(regexp_replace(regexp_replace(
          regexp_extract('Training_set/train_set_' || {_KEY} || '_filtered.csv', '([^/]+?)(\\.[^./]*)?$', 1),
          '^train_set_', ''), '_filtered$', '')) AS study
      FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)""",
)
def q_study_key_parse(spark, sf):
    from .views import table

    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    key = F.concat(F.lit("ICB_"), F.col("n_name"), F.lit("__"), F.lower("c_mktsegment"), F.lit("__PD-(L)1"))
    path = F.concat(F.lit("Training_set/train_set_"), key, F.lit("_filtered.csv"))
    x = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", study_of(path).alias("study"))
    return x.select("c_custkey", "study", study_parts("study").alias("p")).select(
        "c_custkey", "study", "p.cohort", "p.cancer", "p.treatment"
    )


@query(
    "src_train_csv",
    with_views(
        "SELECT study, " + ", ".join(f"features[{i}] AS f{i}" for i in range(1, 9)) + ", response FROM v_wide",
        "v_wide",
    ),
)
def q_src_train_csv(spark, sf):
    w = v_wide(spark, sf)
    wide = w.select("study", *[F.col("features")[i - 1].alias(f"f{i}") for i in range(1, 9)], "response")
    path = scratch_path(spark, f"train_csv_{os.path.basename(sf.rstrip('/'))}")
    io.write_train(wide, path, WIDE_NAMES)
    back = io.read_train(spark, path, WIDE_NAMES)
    return back.select(F.col("study").cast("bigint").alias("study"), *WIDE_NAMES, "response")


@query("src_expression", with_views("SELECT * FROM v_expr", "v_expr"))
def q_src_expression(spark, sf):
    root = scratch_path(spark, f"cohort_{os.path.basename(sf.rstrip('/'))}")
    io.write_table(v_expr(spark, sf), os.path.join(root, "expression"))
    e = io.read_cohort(spark, root, ["expression"])["expression"]
    return e.select(F.col("study").cast("int").alias("study"), "patientid", "gene", "value")


@query(
    "src_name_list",
    with_views(
        """SELECT signature AS value, row_number() OVER (ORDER BY signature) AS ord FROM (
  SELECT signature FROM (SELECT DISTINCT study, signature FROM cs WHERE score IS NOT NULL)
  GROUP BY signature HAVING count(*) = (SELECT count(DISTINCT study) FROM cs))""",
        "v_scores_sup",
        extra=_CS,
    ),
)
def q_src_name_list(spark, sf):
    """The common-feature list written as a text file and read back in line order."""
    from pyspark.sql import Window

    names = cohort.common_features(cohort.complete_signatures(v_scores_sup(spark, sf)))
    path = scratch_path(spark, f"name_list_{os.path.basename(sf.rstrip('/'))}")
    io.write_list(names, path, "signature")
    back = io.read_list(spark, path)
    # the list is a small dimension; numbering it in one window is bounded by its length
    return back.select("value", F.row_number().over(Window.orderBy("pos")).alias("ord"))
