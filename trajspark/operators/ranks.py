"""Ranks, exact quantiles and rank statistics without a single-task sort.

Values are first reduced to a histogram of distinct values (ties cost one row),
then cut into order-preserving buckets.  Sorting happens inside one
(group, bucket); the counts of the buckets before it give the offset.  Nothing
here needs a data pass to choose bucket borders, so a recomputed task always
gets the same ones.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

#: buckets per doubling of the magnitude
BUCKETS_PER_OCTAVE = 256
_B = "_bucket"


def value_bucket(value: Column) -> Column:
    """A bucket number that never decreases as ``value`` grows."""
    mag = F.floor(F.log2(F.abs(value) * F.lit(float(2 ** 20)) + F.lit(1.0))
                  * F.lit(float(BUCKETS_PER_OCTAVE)))
    return F.when(value < 0, -mag).otherwise(mag).cast("int")


def cumulate(hist: DataFrame, group: Sequence[str], value: str,
             counts: Sequence[str], descending: bool = False) -> DataFrame:
    """Add ``before_<c>`` (rows with a smaller value) and ``total_<c>``.

    ``hist`` holds one row per (group, value).  With ``descending`` "before"
    means a larger value.
    """
    group = list(group)
    g = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in group] or [F.lit("")]
    base = hist.withColumn("_g", F.concat_ws("\u0001", *g)) \
        .withColumn(_B, value_bucket(F.col(value))).repartition("_g", _B)
    sums = base.groupBy("_g", _B).agg(*[F.sum(c).alias(f"_s_{c}") for c in counts])
    ob = F.col(_B).desc() if descending else F.col(_B).asc()
    before_b = W.partitionBy("_g").orderBy(ob).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("_g")
    carry = sums.select(
        F.col("_g").alias("_cg"), F.col(_B).alias("_cb"),
        *[F.coalesce(F.sum(f"_s_{c}").over(before_b), F.lit(0)).alias(f"_o_{c}")
          for c in counts],
        *[F.sum(f"_s_{c}").over(whole).alias(f"total_{c}") for c in counts])
    ov = F.col(value).desc() if descending else F.col(value).asc()
    local_w = W.partitionBy("_g", _B).orderBy(ov).rowsBetween(
        W.unboundedPreceding, -1)
    local = base.select("*", *[
        F.coalesce(F.sum(c).over(local_w), F.lit(0)).alias(f"_w_{c}")
        for c in counts])
    out = local.join(carry, (F.col("_g") == F.col("_cg"))
                     & (F.col(_B) == F.col("_cb")), "inner")
    for c in counts:
        out = out.withColumn(f"before_{c}", F.col(f"_o_{c}") + F.col(f"_w_{c}"))
    return out.drop("_g", "_cg", _B, "_cb", *[f"_o_{c}" for c in counts],
                    *[f"_w_{c}" for c in counts])


def histogram(df: DataFrame, group: Sequence[str], value: str,
              counts: dict[str, Column] | None = None,
              descending: bool = False) -> DataFrame:
    """Cumulated histogram of ``value`` per group (nulls are left out)."""
    counts = counts or {"n": F.lit(1)}
    h = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(
        *[F.sum(e.cast("long")).alias(o) for o, e in counts.items()])
    return cumulate(h, group, value, list(counts), descending)


def quantiles(df: DataFrame, group: Sequence[str], value: str,
              probs: dict[str, float], kind: str = "linear") -> DataFrame:
    """Exact quantiles per group.

    ``kind`` is ``linear`` (interpolated) or ``higher`` (the element at
    0-based rank ceil(q * (n - 1))).  Also returns ``n``.
    """
    h = histogram(df, group, value)
    aggs = [F.max("total_n").alias("n")]
    for o, p in probs.items():
        pos = F.lit(float(p)) * (F.col("total_n") - 1)
        for side, idx in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (F.col("before_n") <= idx) & (
                idx < F.col("before_n") + F.col("n"))
            aggs.append(F.max(F.when(here, F.col(value))).alias(f"_{o}_{side}"))
    res = (h.groupBy(*group) if group else h.groupBy()).agg(*aggs)
    for o, p in probs.items():
        if kind == "higher":
            res = res.withColumn(o, F.col(f"_{o}_hi"))
        else:
            pos = F.lit(float(p)) * (F.col("n") - 1)
            frac = pos - F.floor(pos)
            res = res.withColumn(
                o, F.col(f"_{o}_lo") + frac * (F.col(f"_{o}_hi") - F.col(f"_{o}_lo")))
    return res.drop(*[f"_{o}_{s}" for o in probs for s in ("lo", "hi")])


def with_ranks(df: DataFrame, group: Sequence[str], value: str, out: str,
               keep_ties: str = "average") -> DataFrame:
    """1-based rank of each row's value (average or min over ties)."""
    h = histogram(df, group, value)
    first = F.col("before_n") + 1
    rank = first + (F.col("n") - 1) / 2.0 if keep_ties == "average" else first
    r = h.select(*[F.col(g).alias(f"_r_{g}") for g in group],
                 F.col(value).alias("_rv"), rank.cast("double").alias(out))
    on = [F.col(g).eqNullSafe(F.col(f"_r_{g}")) for g in group] + [
        F.col(value) == F.col("_rv")]
    return df.join(r, on, "inner").drop("_rv", *[f"_r_{g}" for g in group])


def auc(df: DataFrame, group: Sequence[str], score: str, positive: Column,
        weight: Column | None = None) -> DataFrame:
    """Tie-averaged AUROC per group; null when a class is absent.

    ``weight`` is an integer copy count per row (bootstrap replicates).
    """
    one = F.lit(1) if weight is None else weight
    h = histogram(df, group, score, {
        "p": F.when(positive, one).otherwise(0),
        "q": F.when(positive, 0).otherwise(one)})
    won = F.col("p") * (F.col("before_q") + F.col("q") / 2.0)
    return (h.groupBy(*group) if group else h.groupBy()).agg(
        F.max("total_p").alias("n_pos"), F.max("total_q").alias("n_neg"),
        F.sum(won).alias("_won")).select(
        *group, "n_pos", "n_neg",
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
               F.col("_won") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"))


def average_precision(df: DataFrame, group: Sequence[str], score: str,
                      positive: Column) -> DataFrame:
    """Average precision per group over distinct score levels."""
    h = histogram(df, group, score, {
        "p": F.when(positive, 1).otherwise(0), "n": F.lit(1)}, descending=True)
    prec = (F.col("before_p") + F.col("p")) / (F.col("before_n") + F.col("n"))
    return (h.groupBy(*group) if group else h.groupBy()).agg(
        (F.sum(prec * F.col("p")) / F.max("total_p")).alias("avg_precision"))


def hash_order(df: DataFrame, group: Sequence[str], u: str, out: str) -> DataFrame:
    """0-based rank of a uniform draw inside its group, plus ``<out>_total``.

    Draws are 52-bit, so equal values are broken by nothing: they share a rank.
    """
    h = histogram(df, group, u)
    r = h.select(*[F.col(g).alias(f"_r_{g}") for g in group],
                 F.col(u).alias("_rv"), F.col("before_n").alias(out),
                 F.col("total_n").alias(f"{out}_total"))
    on = [F.col(g).eqNullSafe(F.col(f"_r_{g}")) for g in group] + [
        F.col(u) == F.col("_rv")]
    return df.join(r, on, "inner").drop("_rv", *[f"_r_{g}" for g in group])


def normal_quantile(p: float) -> float:
    """Standard normal quantile (a constant of a plan, not a row function)."""
    from statistics import NormalDist
    return NormalDist().inv_cdf(p)
