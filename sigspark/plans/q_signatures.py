"""Query keys for signature scoring on ``v_expr`` (expression) and ``v_sig`` (signatures)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signatures as S
from .q_cohort import _GF, MISSING_PERC, N_CUTOFF, SIG_PERC, VALUE_FLOOR
from .registry import query, rounded
from .views import v_expr, v_sig, with_views

# The signature catalogue of the stand-in (method per signature)
# and the composite / contrast definitions over those signatures.
METHOD_OF = {
    "ECONOMY": "Weighted Mean",
    "LARGE": "Weighted Mean",
    "MEDIUM": "ssGSEA",
    "PROMO": "ssGSEA",
    "SMALL": "GSVA",
    "STANDARD": "GSVA",
}
COMPOSITE_PARTS = [
    ("ECONOMY_LARGE_MEDIUM", "ECONOMY", "add", 1.0),
    ("ECONOMY_LARGE_MEDIUM", "LARGE", "add", 0.5),
    ("ECONOMY_LARGE_MEDIUM", "MEDIUM", "add", -1.0),
]
CONTRAST_PARTS = [
    ("PROMO_minus_MEDIUM", "PROMO", "add", 1.0),
    ("PROMO_minus_MEDIUM", "MEDIUM", "add", -1.0),
    ("SMALL_over_STANDARD", "SMALL", "num", 1.0),
    ("SMALL_over_STANDARD", "STANDARD", "den", 1.0),
]
KW = dict(n_cutoff=N_CUTOFF, sig_perc=SIG_PERC, missing_perc=MISSING_PERC, floor=VALUE_FLOOR)
_OUT = "SELECT study, patientid, signature, round(score, 6) + 0.0 AS score FROM {}"
PARTS_SCHEMA = "signature string, component string, op string, coef double"


def v_info(spark, sf):
    m = F.create_map(*[x for k, v in METHOD_OF.items() for x in (F.lit(k), F.lit(v))])
    return v_sig(spark, sf).select("signature").distinct().select("signature", m[F.col("signature")].alias("method"))


_INFO = "v_info AS (SELECT DISTINCT signature, CASE signature " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in METHOD_OF.items()
) + " END AS method FROM v_sig)"


def _values(parts):
    rows = ", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in parts)
    return f"(SELECT * FROM (VALUES {rows}) t(signature, component, op, coef))"


# ---- SQL text builders (one CTE chain per method; ``sig`` names the signature CTE) ----

def sql_gate(sig: str, out: str) -> str:
    return f"""{out}_sg AS (SELECT DISTINCT signature, gene FROM {sig}),
{out}_ns AS (SELECT signature, count(*) AS n_genes FROM {out}_sg GROUP BY signature),
{out}_g AS (SELECT pr.study, pr.signature, (sm.n_samples >= {N_CUTOFF} AND pr.n_present / ns.n_genes > {SIG_PERC}) AS pass
  FROM (SELECT g.study, sg.signature, count(*) AS n_present FROM (SELECT DISTINCT study, gene FROM gf) g
        JOIN {out}_sg sg USING (gene) GROUP BY g.study, sg.signature) pr
  JOIN {out}_ns ns USING (signature)
  JOIN (SELECT study, count(DISTINCT patientid) AS n_samples FROM gf GROUP BY study) sm USING (study)),
{out} AS (SELECT r.study, r.patientid, r.signature, CASE WHEN g.pass THEN r.score END AS score
  FROM {out}_raw r LEFT JOIN {out}_g g USING (study, signature))"""


def sql_wmean(sig: str, out: str) -> str:
    return f"""{out}_st AS (SELECT study, gene, avg(value) AS mu, stddev_samp(value) AS sd FROM gf GROUP BY study, gene),
{out}_raw AS (SELECT e.study, e.patientid, s.signature, sum(s.weight * ((e.value - st.mu) / st.sd)) / count(*) AS score
  FROM gf e JOIN {out}_st st USING (study, gene) JOIN {sig} s USING (gene) WHERE st.sd > 0
  GROUP BY e.study, e.patientid, s.signature),
""" + sql_gate(sig, out)


def sql_ssgsea(sig: str, out: str, alpha: float = 0.25) -> str:
    return f"""{out}_rk AS (SELECT study, patientid, gene,
    row_number() OVER (PARTITION BY study, patientid ORDER BY value, gene) AS r,
    count(*) OVER (PARTITION BY study, patientid) AS n FROM gf),
{out}_es AS (SELECT study, patientid, signature,
    sum(pow(r, {alpha} + 1)) / sum(pow(r, {alpha}))
    - (CAST(any_value(n) AS DOUBLE) * (any_value(n) + 1) / 2 - sum(r)) / NULLIF(any_value(n) - count(*), 0) AS score
  FROM {out}_rk JOIN {sig} USING (gene) GROUP BY study, patientid, signature),
{out}_raw AS (SELECT e.study, e.patientid, e.signature, e.score / NULLIF(rg.rng, 0) AS score FROM {out}_es e
  JOIN (SELECT study, signature, max(score) - min(score) AS rng FROM {out}_es GROUP BY study, signature) rg
  USING (study, signature)),
""" + sql_gate(sig, out)


def sql_ks(dens: str, sig: str, out: str) -> str:
    """GSVA steps (b)+(c) on ``dens(study, patientid, gene, cdf)`` -> ``{out}_raw``."""
    return f"""{out}_p AS (SELECT study, patientid, gene,
    row_number() OVER (PARTITION BY study, patientid ORDER BY cdf DESC, gene) AS p,
    count(*) OVER (PARTITION BY study, patientid) AS n FROM {dens}),
{out}_x AS (SELECT p.*, s.signature, abs(n - p + 1 - n / 2) AS wt FROM {out}_p p JOIN {sig} s USING (gene)),
{out}_y AS (SELECT *,
    sum(wt) OVER (PARTITION BY study, patientid, signature ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw,
    row_number() OVER (PARTITION BY study, patientid, signature ORDER BY p) AS m,
    sum(wt) OVER (PARTITION BY study, patientid, signature) AS tw,
    count(*) OVER (PARTITION BY study, patientid, signature) AS k FROM {out}_x),
{out}_raw AS (SELECT study, patientid, signature,
    greatest(max(cw / NULLIF(tw, 0) - (p - m) / NULLIF(n - k, 0)), 0)
    + least(min((cw - wt) / NULLIF(tw, 0) - (p - m) / NULLIF(n - k, 0)), 0) AS score
  FROM {out}_y GROUP BY study, patientid, signature)"""


def sql_gsva(sig: str, out: str) -> str:
    return f"""{out}_c AS (SELECT study, gene, value, count(*) AS cnt FROM gf GROUP BY study, gene, value),
{out}_cdf AS (SELECT study, gene, value,
    sum(cnt) OVER (PARTITION BY study, gene ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    / sum(cnt) OVER (PARTITION BY study, gene) AS cdf FROM {out}_c),
{out}_d AS (SELECT e.study, e.patientid, e.gene, c.cdf FROM gf e JOIN {out}_cdf c USING (study, gene, value)),
""" + sql_ks(f"{out}_d", sig, out) + ",\n" + sql_gate(sig, out)


def _sig_of(method: str, name: str) -> str:
    return f"{name} AS (SELECT s.* FROM v_sig s JOIN v_info i USING (signature) WHERE i.method = '{method}')"


_SS = ",\n".join(
    [
        _GF,
        _INFO,
        _sig_of("Weighted Mean", "s_wm"),
        _sig_of("ssGSEA", "s_sg"),
        _sig_of("GSVA", "s_gv"),
        sql_wmean("s_wm", "o_wm"),
        sql_ssgsea("s_sg", "o_sg"),
        sql_gsva("s_gv", "o_gv"),
        """ss_all AS (SELECT * FROM o_wm UNION ALL SELECT * FROM o_sg UNION ALL SELECT * FROM o_gv),
ss_ok AS (SELECT study, signature FROM ss_all GROUP BY study, signature HAVING bool_and(score IS NOT NULL)),
ss AS (SELECT a.* FROM ss_all a JOIN ss_ok USING (study, signature))""",
    ]
)


def sql_composite(scores: str, parts: str, out: str) -> str:
    return f"""{out}_p AS {parts},
{out}_np AS (SELECT signature AS composite, count(*) AS n_parts FROM {out}_p GROUP BY signature),
{out} AS (SELECT x.study, x.patientid, x.composite AS signature,
    CASE WHEN count(x.score) = any_value(np.n_parts) THEN
      CASE WHEN count_if(x.op IN ('num', 'den')) > 0
           THEN avg(CASE WHEN x.op = 'num' THEN x.score END) / NULLIF(avg(CASE WHEN x.op = 'den' THEN x.score END), 0)
           ELSE sum(CASE WHEN x.op = 'add' THEN x.coef * x.score END) END END AS score
  FROM (SELECT s.study, s.patientid, p.signature AS composite, p.op, p.coef, s.score
        FROM {scores} s JOIN {out}_p p ON s.signature = p.component) x
  JOIN {out}_np np USING (composite)
  GROUP BY x.study, x.patientid, x.composite)"""


def _parts(spark, rows):
    return spark.createDataFrame(rows, PARTS_SCHEMA)


@query("method_dispatch", with_views("SELECT s.signature, s.gene, s.weight, i.method FROM v_sig s JOIN v_info i USING (signature)", "v_sig", extra=_INFO))
def q_method_dispatch(spark, sf):
    return S.method_dispatch(v_sig(spark, sf), v_info(spark, sf))


@query(
    "signature_expand",
    with_views(
        "SELECT e.study, e.patientid, s.signature, e.gene, e.value, s.weight FROM v_expr e JOIN v_sig s USING (gene)",
        "v_expr",
        "v_sig",
    ),
)
def q_signature_expand(spark, sf):
    return S.signature_expand(v_expr(spark, sf), v_sig(spark, sf))


@query("sig_weighted_mean", with_views(_OUT.format("o"), "v_expr", "v_sig", extra=_GF + ",\n" + sql_wmean("v_sig", "o")))
def q_sig_weighted_mean(spark, sf):
    return rounded(S.sig_weighted_mean(v_expr(spark, sf), v_sig(spark, sf), **KW), 6, "score")


@query("sig_ssgsea", with_views(_OUT.format("o"), "v_expr", "v_sig", extra=_GF + ",\n" + sql_ssgsea("v_sig", "o")))
def q_sig_ssgsea(spark, sf):
    return rounded(S.sig_ssgsea(v_expr(spark, sf), v_sig(spark, sf), **KW), 6, "score")


@query("sig_gsva_ecdf", with_views(_OUT.format("o"), "v_expr", "v_sig", extra=_GF + ",\n" + sql_gsva("v_sig", "o")))
def q_sig_gsva_ecdf(spark, sf):
    return rounded(S.sig_gsva(v_expr(spark, sf), v_sig(spark, sf), kcdf="none", **KW), 6, "score")


@query("score_signatures", with_views(_OUT.format("ss"), "v_expr", "v_sig", extra=_SS))
def q_score_signatures(spark, sf):
    return rounded(S.score_signatures(v_expr(spark, sf), v_sig(spark, sf), v_info(spark, sf), **KW), 6, "score")


# ---- special signatures: the stand-in's catalogue gives each algorithm a signature or two ----

SPECIAL = {"ECONOMY": S.sig_ratio, "LARGE": S.sig_zmean, "MEDIUM": S.sig_clipped, "PROMO": S.sig_halves, "SMALL": S.sig_predictio, "STANDARD": S.sig_zmean}
_HALVES_OF = "{0} AS (SELECT signature || CASE WHEN weight > 0 THEN '+' ELSE '-' END AS signature, gene, 1.0 AS weight FROM v_sig WHERE weight <> 0 AND signature = '{1}')"


def _half_parts(halves: str) -> str:
    return f"""(SELECT left(signature, -1) AS signature, signature AS component, 'add' AS op, CASE right(signature, 1) WHEN '+' THEN 1.0 ELSE -1.0 END AS coef
  FROM (SELECT DISTINCT signature FROM {halves}))"""


_SPECIAL = ",\n".join(
    [
        _GF,
        "s_ra AS (SELECT * FROM v_sig WHERE signature = 'ECONOMY')",
        """ra_raw AS (SELECT e.study, e.patientid, s.signature,
    avg(CASE WHEN s.weight > 0 THEN e.value END) / NULLIF(avg(CASE WHEN s.weight < 0 THEN e.value END), 0) AS score
  FROM gf e JOIN s_ra s USING (gene) GROUP BY e.study, e.patientid, s.signature)""",
        sql_gate("s_ra", "ra"),
        "s_zm AS (SELECT signature, gene, 1.0 AS weight FROM v_sig WHERE signature IN ('LARGE', 'STANDARD'))",
        sql_wmean("s_zm", "zm"),
        "s_cl AS (SELECT * FROM v_sig WHERE signature = 'MEDIUM')",
        sql_wmean("s_cl", "cl_"),
        "cl AS (SELECT study, patientid, signature, CASE WHEN score IS NOT NULL THEN least(greatest(round(score * 10 / 3.0), 0.0), 10.0) END AS score FROM cl_)",
        _HALVES_OF.format("s_hv", "PROMO"),
        sql_ssgsea("s_hv", "hv_"),
        sql_composite("hv_", _half_parts("s_hv"), "hv"),
        _HALVES_OF.format("s_pi", "SMALL"),
        sql_gsva("s_pi", "pi_"),
        sql_composite("pi_", _half_parts("s_pi"), "pio"),
        """sp_all AS (SELECT * FROM ra UNION ALL SELECT * FROM zm UNION ALL SELECT * FROM cl UNION ALL SELECT * FROM hv UNION ALL SELECT * FROM pio),
sp_ok AS (SELECT study, signature FROM sp_all GROUP BY study, signature HAVING bool_and(score IS NOT NULL)),
sp AS (SELECT a.* FROM sp_all a JOIN sp_ok USING (study, signature))""",
    ]
)


@query("score_signatures_special", with_views(_OUT.format("sp"), "v_expr", "v_sig", extra=_SPECIAL))
def q_score_signatures_special(spark, sf):
    sigs = v_sig(spark, sf)
    info = sigs.select("signature").distinct().withColumn("method", F.lit(S.SPECIFIC))
    return rounded(S.score_signatures(v_expr(spark, sf), sigs, info, special=SPECIAL, **KW), 6, "score")


@query(
    "sig_composite",
    with_views(_OUT.format("o"), "v_expr", "v_sig", extra=_SS + ",\n" + sql_composite("ss", _values(COMPOSITE_PARTS), "o")),
)
def q_sig_composite(spark, sf):
    ss = S.score_signatures(v_expr(spark, sf), v_sig(spark, sf), v_info(spark, sf), **KW)
    return rounded(S.sig_composite(ss, _parts(spark, COMPOSITE_PARTS)), 6, "score")


@query(
    "sig_contrast",
    with_views(_OUT.format("o"), "v_expr", "v_sig", extra=_SS + ",\n" + sql_composite("ss", _values(CONTRAST_PARTS), "o")),
)
def q_sig_contrast(spark, sf):
    ss = S.score_signatures(v_expr(spark, sf), v_sig(spark, sf), v_info(spark, sf), **KW)
    return rounded(S.sig_composite(ss, _parts(spark, CONTRAST_PARTS)), 6, "score")


_HALVES = """halves AS (SELECT signature || CASE WHEN weight > 0 THEN '+' ELSE '-' END AS signature, gene, 1.0 AS weight
  FROM v_sig WHERE weight <> 0)"""
_PIO_PARTS = """(SELECT signature, signature || '+' AS component, 'add' AS op, 1.0 AS coef FROM (SELECT DISTINCT signature FROM v_sig)
  UNION ALL
  SELECT signature, signature || '-', 'add', -1.0 FROM (SELECT DISTINCT signature FROM v_sig))"""


@query(
    "sig_predictio",
    with_views(
        _OUT.format("o"),
        "v_expr",
        "v_sig",
        extra=",\n".join([_GF, _HALVES, sql_gsva("halves", "h"), sql_composite("h", _PIO_PARTS, "o")]),
    ),
)
def q_sig_predictio(spark, sf):
    return rounded(S.sig_predictio(v_expr(spark, sf), v_sig(spark, sf), **KW), 6, "score")


def sql_phi(z: str) -> str:
    """Standard normal CDF in DuckDB by the same series and term order as ``functions.normal_cdf``."""
    series = (
        f"list_reduce(list_transform(range(1, 121), lambda n: {{'t': {z} * {z}, 'd': CAST(2 * n + 1 AS DOUBLE)}}), "
        f"lambda acc, e: {{'t': acc.t * e.t / e.d, 'd': acc.d + acc.t * e.t / e.d}}, "
        f"{{'t': CAST({z} AS DOUBLE), 'd': CAST({z} AS DOUBLE)}}).d"
    )
    return (
        f"(CASE WHEN {z} <= -9 THEN 0.0 WHEN {z} >= 9 THEN 1.0 "
        f"ELSE 0.5 + exp(-({z} * {z}) / 2.0) / 2.5066282746310002 * {series} END)"
    )


def sql_gsva_kernel(sig: str, out: str) -> str:
    """Brute force over all sample pairs of a (study, gene) - fine for the oracle's small data."""
    return f"""{out}_st AS (SELECT study, gene, stddev_samp(value) / 4 AS h FROM gf GROUP BY study, gene HAVING stddev_samp(value) > 0),
{out}_z AS (SELECT a.study, a.patientid, a.gene, (a.value - b.value) / s.h AS z
  FROM gf a JOIN gf b ON a.study = b.study AND a.gene = b.gene JOIN {out}_st s ON s.study = a.study AND s.gene = a.gene),
{out}_d AS (SELECT study, patientid, gene, avg({sql_phi('z')}) AS cdf FROM {out}_z GROUP BY study, patientid, gene),
""" + sql_ks(f"{out}_d", sig, out) + ",\n" + sql_gate(sig, out)


@query("sig_gsva_kernel", with_views(_OUT.format("o"), "v_expr", "v_sig", extra=_GF + ",\n" + sql_gsva_kernel("v_sig", "o")))
def q_sig_gsva_kernel(spark, sf):
    return rounded(S.sig_gsva(v_expr(spark, sf), v_sig(spark, sf), kcdf="gaussian", **KW), 6, "score")
