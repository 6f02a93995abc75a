"""Gene-signature scoring as grouped DataFrame jobs.

Inputs are long tables: ``expr(study, patientid, gene, value)``,
``sigs(signature, gene, weight)``, ``info(signature, method)`` and, for
composite signatures, ``parts(signature, component, op, coef)``.

Partitioning: gene statistics are grouped aggregates on (study, gene)
(map-side partial, skew-safe); within-sample gene rankings are windows on
(study, patientid), whose size is bounded by the number of genes measured
in one sample, not by the number of samples; the walk statistics are
windows on (study, patientid, signature), bounded by the signature size.
The only per-gene ordering across samples (the ECDF of GSVA) uses the
skew-safe :func:`ordered_scan`.

Semantics follow the public definitions (weighted mean of z-scores;
ssGSEA, Barbie et al. 2009; GSVA, Haenzelmann et al. 2013).  Ties in a
ranking are broken by gene name so that every result is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reuse
from .cohort import coverage, gene_filter
from .scan import ordered_scan

def _prepare(expr, sigs, n_cutoff, sig_perc, missing_perc, floor):
    ef = reuse(gene_filter(expr, missing_perc, floor) if floor is not None else expr)
    gate = coverage(ef, sigs, n_cutoff, sig_perc).select("study", "signature", "pass")
    return ef, gate


def _gate(scores: DataFrame, gate: DataFrame) -> DataFrame:
    """Scores of (study, signature) pairs failing the coverage gate become NULL."""
    return scores.join(gate, ["study", "signature"], "left").select(
        "study", "patientid", "signature",
        F.when(F.col("pass"), F.col("score")).alias("score"),
    )


def sig_weighted_mean(
    expr: DataFrame, sigs: DataFrame, n_cutoff: int = 15, sig_perc: float | None = 0.8,
    missing_perc: float = 0.5, floor: float | None = None,
) -> DataFrame:
    """Weighted mean of per-study z-scores.

    z = (x - mean) / sd over the study's samples (sd with n-1; genes with
    sd = 0 or NULL are dropped); score = sum(weight * z) / #genes used.
    """
    ef, gate = _prepare(expr, sigs, n_cutoff, sig_perc, missing_perc, floor)
    st = ef.groupBy("study", "gene").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    z = (
        ef.join(st, ["study", "gene"])
        .where(F.col("sd") > 0)
        .select("study", "patientid", "gene", F.try_divide(F.col("value") - F.col("mu"), F.col("sd")).alias("z"))
    )
    s = (
        z.join(sigs.select("signature", "gene", "weight"), "gene")
        .groupBy("study", "patientid", "signature")
        .agg((F.sum(F.col("weight") * F.col("z")) / F.count(F.lit(1))).alias("score"))
    )
    return _gate(s, gate)


def gene_ranks(expr: DataFrame, by: str = "value", desc: bool = False) -> DataFrame:
    """Rank of each gene within its sample (1 = lowest ``by``; ties by gene) and N = genes in the sample."""
    o = [F.col(by).desc(), F.col("gene")] if desc else [F.col(by), F.col("gene")]
    w = Window.partitionBy("study", "patientid").orderBy(*o)
    n = Window.partitionBy("study", "patientid")
    return expr.select(
        "study", "patientid", "gene", F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(n).alias("n")
    )


def sig_ssgsea(
    expr: DataFrame, sigs: DataFrame, alpha: float = 0.25, norm: bool = True, n_cutoff: int = 15,
    sig_perc: float | None = 0.8, missing_perc: float = 0.5, floor: float | None = None,
) -> DataFrame:
    """Single-sample GSEA.

    Genes of a sample are ranked 1..N by increasing value; the walk goes from
    the highest rank down, stepping up by r^alpha / sum_S r^alpha on set genes
    and down by 1/(N-|S|) elsewhere, and the score is the sum of the walk.
    Summing the walk telescopes to a closed form in the set genes' ranks:

        ES = sum_S r^(alpha+1) / sum_S r^alpha - (N(N+1)/2 - sum_S r) / (N - |S|)

    so only the set genes' ranks are needed.  ``norm`` divides by the range
    (max - min) of ES over the study's samples for that signature.
    """
    ef, gate = _prepare(expr, sigs, n_cutoff, sig_perc, missing_perc, floor)
    rk = gene_ranks(ef)
    a = F.lit(alpha)
    g = (
        rk.join(sigs.select("signature", "gene"), "gene")
        .groupBy("study", "patientid", "signature")
        .agg(
            F.sum(F.pow("r", a + 1)).alias("sa1"),
            F.sum(F.pow("r", a)).alias("sa"),
            F.sum("r").alias("sr"),
            F.count(F.lit(1)).alias("k"),
            F.first("n").alias("n"),
        )
    )
    n = F.col("n").cast("double")
    es = F.col("sa1") / F.col("sa") - F.try_divide(n * (n + 1) / 2 - F.col("sr"), n - F.col("k"))
    s = g.select("study", "patientid", "signature", es.alias("score"))
    if norm:
        rng = s.groupBy("study", "signature").agg((F.max("score") - F.min("score")).alias("rng"))
        s = s.join(rng, ["study", "signature"]).select(
            "study", "patientid", "signature", F.try_divide(F.col("score"), F.col("rng")).alias("score")
        )
    return _gate(s, gate)


def ecdf(expr: DataFrame, buckets: int = 16) -> DataFrame:
    """Per (study, gene): F(x) = #{samples with value <= x} / n, for every sample.

    Ties are collapsed into counts first; the running count comes from the
    skew-safe ordered scan, so a study with very many samples is split.
    """
    c = expr.groupBy("study", "gene", "value").agg(F.count(F.lit(1)).alias("cnt"))
    s = ordered_scan(c, ["study", "gene"], ["value"], sums=["cnt"], buckets=buckets)
    tot = c.groupBy("study", "gene").agg(F.sum("cnt").alias("n"))
    cdf = s.join(tot, ["study", "gene"]).select("study", "gene", "value", (F.col("cnt_cum") / F.col("n")).alias("cdf"))
    return expr.join(cdf, ["study", "gene", "value"]).select("study", "patientid", "gene", "cdf")


def ks_scores(dens: DataFrame, sigs: DataFrame, tau: float = 1.0, col: str = "cdf") -> DataFrame:
    """GSVA steps (b) and (c) on a per-sample gene statistic ``col``.

    (b) in each sample genes are sorted by decreasing ``col`` (ties by gene);
        the gene at position p of N gets the symmetric weight |N - p + 1 - N/2|;
    (c) the walk over that order steps up by w^tau / sum_S w^tau on set genes
        and down by 1/(N - |S|) elsewhere.  Its maximum is reached right after
        a set gene and its minimum right before one (or at 0 at either end),
        so the walk is evaluated only at set-gene positions; the score is
        max(0, max) + min(0, min) (the max-difference statistic).
    """
    w = Window.partitionBy("study", "patientid").orderBy(F.col(col).desc(), F.col("gene"))
    nw = Window.partitionBy("study", "patientid")
    pos = dens.select(
        "study", "patientid", "gene", F.row_number().over(w).alias("p"), F.count(F.lit(1)).over(nw).alias("n")
    )
    rs = F.abs(F.col("n") - F.col("p") + 1 - F.col("n") / 2)
    x = pos.join(sigs.select("signature", "gene"), "gene").withColumn("wt", F.pow(rs, F.lit(tau)))
    ws = Window.partitionBy("study", "patientid", "signature").orderBy("p")
    wa = Window.partitionBy("study", "patientid", "signature")
    x = x.select(
        "study", "patientid", "signature", "p", "n", "wt",
        F.sum("wt").over(ws.rowsBetween(Window.unboundedPreceding, 0)).alias("cw"),
        F.row_number().over(ws).alias("m"),
        F.sum("wt").over(wa).alias("tw"),
        F.count(F.lit(1)).over(wa).alias("k"),
    )
    down = F.try_divide(F.col("p") - F.col("m"), F.col("n") - F.col("k"))
    after = F.try_divide(F.col("cw"), F.col("tw")) - down
    before = F.try_divide(F.col("cw") - F.col("wt"), F.col("tw")) - down
    g = x.groupBy("study", "patientid", "signature").agg(F.max(after).alias("mx"), F.min(before).alias("mn"))
    return g.select(
        "study", "patientid", "signature",
        (F.greatest(F.col("mx"), F.lit(0.0)) + F.least(F.col("mn"), F.lit(0.0))).alias("score"),
    )


def sig_gsva(
    expr: DataFrame, sigs: DataFrame, kcdf: str = "none", tau: float = 1.0, n_cutoff: int = 15,
    sig_perc: float | None = 0.8, missing_perc: float = 0.5, floor: float | None = None,
) -> DataFrame:
    """GSVA: per-gene CDF over the study's samples, then the KS-like walk per sample.

    ``kcdf="none"`` uses the empirical CDF; ``kcdf="gaussian"`` the Gaussian
    kernel CDF of :mod:`sigspark.operators.kernel` (bandwidth sd/4).
    """
    ef, gate = _prepare(expr, sigs, n_cutoff, sig_perc, missing_perc, floor)
    if kcdf == "none":
        dens = ecdf(ef)
    elif kcdf == "gaussian":
        from .kernel import kernel_cdf

        dens = kernel_cdf(ef)
    else:
        raise ValueError(f"kcdf must be 'none' or 'gaussian', not {kcdf!r}")
    return _gate(ks_scores(dens, sigs, tau), gate)


def sig_composite(scores: DataFrame, parts: DataFrame) -> DataFrame:
    """Composite and contrast signatures from component scores.

    ``parts(signature, component, op, coef)``:
    * ``op = 'add'``: score = sum(coef * component score) (weighted sums, differences);
    * ``op = 'num'`` / ``'den'``: score = mean(num components) / mean(den components),
      a zero denominator gives NULL.
    A composite is NULL in a sample unless every one of its components has a
    non-null score there.  ``parts`` is a catalogue (rows = composite parts),
    joined on the component name.
    """
    p = parts.select(
        F.col("signature").alias("composite"), F.col("component").alias("signature"), "op", "coef"
    )
    n_parts = p.groupBy("composite").agg(F.count(F.lit(1)).alias("n_parts"))
    x = scores.join(p, "signature")
    sc, op = F.col("score"), F.col("op")
    g = x.groupBy("study", "patientid", "composite").agg(
        F.sum(F.when(op == "add", F.col("coef") * sc)).alias("s_add"),
        F.avg(F.when(op == "num", sc)).alias("s_num"),
        F.avg(F.when(op == "den", sc)).alias("s_den"),
        F.count_if(op.isin("num", "den")).alias("n_ratio"),
        F.count(sc).alias("n_ok"),
    ).join(n_parts, "composite")
    val = F.when(F.col("n_ratio") > 0, F.try_divide(F.col("s_num"), F.col("s_den"))).otherwise(F.col("s_add"))
    return g.select(
        "study", "patientid", F.col("composite").alias("signature"),
        F.when(F.col("n_ok") == F.col("n_parts"), val).alias("score"),
    )


def split_by_sign(sigs: DataFrame) -> DataFrame:
    """Signature S -> S+ (genes of positive weight) and S- (negative weight), weights 1."""
    return sigs.where(F.col("weight") != 0).select(
        F.concat(F.col("signature"), F.when(F.col("weight") > 0, F.lit("+")).otherwise(F.lit("-"))).alias("signature"),
        "gene",
        F.lit(1.0).alias("weight"),
    )


def sig_predictio(expr: DataFrame, sigs: DataFrame, **kw) -> DataFrame:
    """PredictIO-style score: GSVA(sensitive genes) - GSVA(resistant genes).

    Sensitive genes carry a positive weight, resistant ones a negative
    weight; both halves are scored by GSVA (with the same gates), and the
    difference is a composite with coefficients +1 / -1.
    """
    halves = split_by_sign(sigs)
    g = sig_gsva(expr, halves, **kw)
    names = sigs.select("signature").distinct()
    parts = names.select(
        "signature",
        F.explode(
            F.array(
                F.struct(F.concat("signature", F.lit("+")).alias("component"), F.lit(1.0).alias("coef")),
                F.struct(F.concat("signature", F.lit("-")).alias("component"), F.lit(-1.0).alias("coef")),
            )
        ).alias("p"),
    ).select("signature", "p.component", F.lit("add").alias("op"), "p.coef")
    return sig_composite(g, parts)


def method_dispatch(sigs: DataFrame, info: DataFrame) -> DataFrame:
    """Signature genes joined to their scoring method (catalogue lookup)."""
    return sigs.join(info.select("signature", "method"), "signature")


def signature_expand(expr: DataFrame, sigs: DataFrame) -> DataFrame:
    """Expression rows of each signature's genes: equi-join on gene."""
    return expr.join(sigs.select("signature", "gene", "weight"), "gene").select(
        "study", "patientid", "signature", "gene", "value", "weight"
    )


def sig_ratio(expr: DataFrame, sigs: DataFrame, n_cutoff: int = 15, sig_perc: float | None = 0.8, missing_perc: float = 0.5, floor: float | None = None) -> DataFrame:
    """Mean value of the genes of positive weight over that of the genes of negative weight; a zero or missing side gives NULL."""
    ef, gate = _prepare(expr, sigs, n_cutoff, sig_perc, missing_perc, floor)
    x = ef.join(sigs.select("signature", "gene", "weight"), "gene")
    side = lambda cond: F.avg(F.when(cond, F.col("value")))
    score = F.try_divide(side(F.col("weight") > 0), side(F.col("weight") < 0))
    return _gate(x.groupBy("study", "patientid", "signature").agg(score.alias("score")), gate)


def sig_zmean(expr: DataFrame, sigs: DataFrame, **kw) -> DataFrame:
    """Mean of the z-scores of the genes, whatever their weights."""
    return sig_weighted_mean(expr, sigs.withColumn("weight", F.lit(1.0)), **kw)


def sig_clipped(expr: DataFrame, sigs: DataFrame, top: float = 3.0, **kw) -> DataFrame:
    """Weighted mean of z-scores on a scale of whole numbers from 0 (0 or less) to 10 (``top`` or more)."""
    s = sig_weighted_mean(expr, sigs, **kw)
    on_scale = F.least(F.greatest(F.round(F.col("score") * 10 / top, 0), F.lit(0.0)), F.lit(10.0))
    return s.withColumn("score", F.when(F.col("score").isNotNull(), on_scale))


def sig_halves(expr: DataFrame, sigs: DataFrame, **kw) -> DataFrame:
    """ssGSEA of the genes of positive weight minus that of the genes of negative weight; a signature of one sign has one half."""
    halves = split_by_sign(sigs)
    sign = F.substring("signature", -1, 1)
    parts = halves.select("signature").distinct().select(
        F.expr("substring(signature, 1, length(signature) - 1)").alias("signature"), F.col("signature").alias("component"),
        F.lit("add").alias("op"), F.when(sign == "+", F.lit(1.0)).otherwise(F.lit(-1.0)).alias("coef"),
    )
    return sig_composite(sig_ssgsea(expr, halves, **kw), parts)


# The method name of signatures with an algorithm of their own, and the algorithm of each.
SPECIFIC = "Specific Algorithm"
SPECIAL = {
    "COX-IS_Bonavita": sig_ratio,
    "IPRES_Hugo": sig_zmean,
    "IPS_Charoentong": sig_clipped,
    "IPSOV_Shen": sig_halves,
    "PassON_Du": sig_halves,
    "PredictIO_Bareche": sig_predictio,
}
METHODS = {"Weighted Mean": sig_weighted_mean, "ssGSEA": sig_ssgsea, "GSVA": sig_gsva}


def score_signatures(expr: DataFrame, sigs: DataFrame, info: DataFrame, special: dict | None = None, **kw) -> DataFrame:
    """Dispatch every signature to its method, stack the results, drop incomplete ones.

    One branch per method (or algorithm of a special signature, looked up by
    name in ``special``, by default SPECIAL) over the signatures of that method
    (a join with the catalogue), ``unionByName`` of the branches, then a signature
    with any NULL score in a study is removed for that study.  A signature whose
    method is not known is an error, found by a look at the (small) catalogue.
    """
    from .cohort import complete_signatures

    special = SPECIAL if special is None else special
    expr = reuse(expr)
    md = reuse(method_dispatch(sigs, info))
    own = F.col("method").eqNullSafe(SPECIFIC)
    known = F.coalesce(F.col("method").isin(*METHODS) | (own & F.col("signature").isin(*special)), F.lit(False))
    odd = md.where(~known).select("signature", "method").distinct().take(5)
    if odd:
        raise ValueError("no such method: " + ", ".join(f"{r.signature} ({r.method})" for r in odd))
    out = None
    branches = [(F.col("method") == m, fn) for m, fn in METHODS.items()]
    for fn in dict.fromkeys(special.values()):
        branches.append((own & F.col("signature").isin(*[k for k, f in special.items() if f is fn]), fn))
    for cond, fn in branches:
        part = md.where(cond).select("signature", "gene", "weight")
        if part.take(1):
            part = fn(expr, part, **kw)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return expr.select("study", "patientid", F.lit("").alias("signature"), F.lit(None).cast("double").alias("score")).limit(0)
    return complete_signatures(out)
