"""Mixing sources to target weights, in DataFrame functions only.

Targets.  A budget of words is shared over sources by weight; no source gets
more than ``cap`` times its own size, and what is cut off goes to the others
by weight until none is above its cap.  That is one level L with target =
min(cap * size, L * weight), found with running sums over the sources ordered
by cap * size / weight.

Quotas.  The mix is dealt in blocks of equal size (``block`` words) by
Sainte-Lague: the next block goes to the highest quotient target / (2 k + 1).
First the blocks of the mix are dealt to the sources, then each source's
blocks to spans of its shards and each span's to its shards (votes: their words), so every shard has a whole
number of blocks and no window holds more than the spans of a source or the SPAN shards of one.  Instead of dealing N blocks one by one, a divisor gives
each party the blocks it is sure of, and only the few quotients between two
divisors are ranked, at most two a party.

Selection.  A shard is a seeded hash class of a source's documents, of about
``shard`` words, so a source with a third of all rows is many small groups.
The shard's documents in seeded order form one run of words, cut into blocks;
q = quota div blocks whole passes take every block, and the rest is a seeded
systematic selection of blocks.  A document's taken words are those of its
words that lie in taken blocks, in closed form from its place in the run.

Defined results: a null text has size 0; nulls form a source of their own,
last in order; without any words all targets and taken words are 0; an empty
table gives an empty one; rows that share an id are ordered by size and take
their own words.  The result has one row per row of ``docs``, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sigspark.session import cut_lineage

#: Words: runs of anything but space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Share of all words that the mix takes, times a source may be taken, words of a block, words of a shard, shards of a span.
SHARE, CAP, BLOCK, SHARD, SPAN = 1.5, 2.0, 16, 1 << 16, 1 << 12
SEED = 31


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) rows with ``target`` and ``rank``, the source's place by code point (nulls last).

    One row a source comes in, so the orders over all sources are short.
    """
    at = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("rank", at).withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("most", cap * F.col("source_size"))
    by = W.orderBy(F.col("most") / F.col("weight"), "rank")
    total = F.sum("source_size").over(W.partitionBy()) * share
    s = s.withColumn("left", total - F.coalesce(F.sum("most").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
    # the level of the first source (in this order) that stays below its cap holds for all from there on
    s = s.withColumn("held", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.row_number().over(by).alias("n"), "level"))).over(W.partitionBy()))
    target = F.when(F.col("held").isNull(), F.col("most")).otherwise(F.least("most", F.col("held.level") * F.col("weight")))
    return s.select("source", "source_size", "rank", target.alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """``parties`` with ``quota``: each group's ``seats`` dealt to its parties by the highest votes / (2 k - 1).

    Ties go to the first party in order.  Groups are dealt apart; a group's
    parties meet in one window (shards of a source, or the sources), its seats
    never do.
    """
    g = W.partitionBy(*group) if group else W.partitionBy()
    p = parties.withColumn("__all", F.sum(votes).over(g)).withColumn("__n", F.count("*").over(g))
    per = lambda d: F.when(F.col("__all") > 0, F.col(votes) * F.greatest(F.col(seats) + d * F.col("__n") / 2, F.lit(0.0)) / F.col("__all")).otherwise(0.0)
    p = p.withColumn("__low", F.floor(per(-1) + 0.5)).withColumn("__high", F.floor(per(1) + 0.5) + 1)
    p = p.withColumn("__rest", F.col(seats) - F.sum("__low").over(g))
    k = F.explode(F.sequence(F.col("__low") + 1, F.col("__high")))  # the quotients between the two divisors
    q = p.where((F.col(votes) > 0) & (F.col("__rest") > 0)).withColumn("k", k)
    q = q.withColumn("q", F.col(votes) / (2 * F.col("k") - 1))
    order = (W.partitionBy(*group) if group else W.partitionBy()).orderBy(F.col("q").desc(), *party)
    won = q.withColumn("__won", F.row_number().over(order)).where("__won <= __rest").groupBy(*group, *party).agg(F.count("*").alias("__more"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, *party)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = p.alias("a").join(won.alias("b"), cond, "left")
    return out.select(*[F.col(f"a.{c}") for c in parties.columns], (F.col("a.__low") + F.coalesce(F.col("b.__more"), F.lit(0))).cast("long").alias("quota"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    block: int = BLOCK,
    shard: int = SHARD,
    seed: int = SEED,
    span: int = SPAN,
) -> DataFrame:
    """id, source, size, source_size, target, shard, passes (whole passes over the document) and taken (words, repeats counted)."""
    d = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    d = cut_lineage(d)  # narrow rows: the texts are read and counted once
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, share, cap).withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard), F.lit(1)).cast("long"))
    goal = goal.withColumn("blocks", F.sum("target").over(W.partitionBy()))
    goal = sainte_lague(goal.withColumn("blocks", F.round(F.col("blocks") / block).cast("long")), [], ["rank"], "target", "blocks")
    goal = goal.select("source", "source_size", "target", "rank", "shards", F.col("quota").alias("source_quota"))
    d = d.alias("d").join(goal.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("d.*", "source_size", "target", "rank", "shards", "source_quota")
    d = d.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("shards")))
    votes = d.groupBy("rank", "shard", "source_quota").agg(F.sum("size").alias("shard_size")).withColumn("span", F.expr(f"shard div {span}"))
    votes = cut_lineage(votes)  # one row a shard
    spans = votes.groupBy("rank", "span", "source_quota").agg(F.sum("shard_size").alias("span_size"))
    spans = sainte_lague(spans, ["rank"], ["span"], "span_size", "source_quota").select("rank", "span", F.col("quota").alias("span_quota"))
    quota = sainte_lague(votes.join(spans, ["rank", "span"]), ["rank", "span"], ["shard"], "shard_size", "span_quota").select("rank", "shard", "shard_size", "quota")
    run = W.partitionBy("rank", "shard").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id", "size")
    d = d.withColumn("stop", F.sum("size").over(run.rowsBetween(W.unboundedPreceding, 0))).withColumn("start", F.col("stop") - F.col("size"))
    d = d.join(quota, ["rank", "shard"])
    n = F.greatest(F.ceil(F.col("shard_size") / block), F.lit(1)).cast("long")
    d = d.withColumn("n", n).withColumn("quota", F.least(F.col("quota"), (F.col("n") * cap).cast("long")))
    d = d.withColumn("passes", F.floor(F.col("quota") / F.col("n"))).withColumn("rest", F.col("quota") % F.col("n"))
    d = d.withColumn("turn", F.pmod(F.xxhash64("rank", "shard", F.lit(seed + 2)), F.col("n")))
    # blocks taken of the first m: those at which (i + turn) * rest / n passes a whole number; rest of n in all
    before = lambda m: F.floor((m + F.col("turn")) * F.col("rest") / F.col("n")) - F.floor(F.col("turn") * F.col("rest") / F.col("n"))
    whole = lambda x: F.floor(x / block)
    words = lambda x: block * before(whole(x)) + (before(whole(x) + 1) - before(whole(x))) * (x % block)
    taken = F.col("passes") * F.col("size") + words(F.col("stop")) - words(F.col("start"))
    return d.select(F.col("id").alias(id_col), F.col("source").alias(source), "size", "source_size", "target", "shard", "passes", taken.cast("long").alias("taken"))
