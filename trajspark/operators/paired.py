"""Paired and stratified significance tests as aggregates.

Replicates are made row by row (every row draws its own sign, weight or order
from a hash of seed, replicate and id) and are summed before any shuffle.
"""

from __future__ import annotations

import math

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.functions import stats
from trajspark.functions.hashing import uniform
from trajspark.operators import ranks


def _by(df: DataFrame, group: Sequence[str]):
    return df.groupBy(*group)


def _join(a: DataFrame, b: DataFrame, group: Sequence[str]) -> DataFrame:
    return a.join(b, list(group)) if group else a.crossJoin(b)


def replicates(df: DataFrame, n: int) -> DataFrame:
    """Every row once per replicate number ``rep``."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def sign_flip(df: DataFrame, group: Sequence[str], key: Column, diff: Column,
              n_perm: int, seed: str) -> DataFrame:
    """Two-sided sign-flip permutation test on the mean difference."""
    d = df.select(*group, key.alias("_k"), diff.alias("_d"))
    obs = _by(d, group).agg(F.avg("_d").alias("mean_diff"), F.count(F.lit(1)).alias("n"))
    sign = F.when(uniform(seed, F.col("rep"), F.col("_k")) < 0.5, -1.0).otherwise(1.0)
    null = _by(replicates(d, n_perm), [*group, "rep"]).agg(
        F.avg(sign * F.col("_d")).alias("_m"))
    j = _join(null, F.broadcast(obs), group)
    hit = F.abs("_m") >= F.abs("mean_diff") - F.lit(1e-12)
    return _by(j, [*group, "mean_diff", "n"]).agg(
        ((F.sum(hit.cast("int")) + 1) / F.lit(n_perm + 1)).alias("p_value"))


def wilcoxon_pratt(df: DataFrame, group: Sequence[str], diff: Column) -> DataFrame:
    """Signed-rank test, zeros ranked and then dropped (normal tail)."""
    group = list(group)
    a = df.select(*group, diff.alias("_d")).withColumn("_a", F.abs("_d"))
    h = ranks.histogram(a, group, "_a", {
        "n": F.lit(1), "up": F.when(F.col("_d") > 0, 1).otherwise(0)})
    rank = F.col("before_n") + (F.col("n") + 1) / 2.0
    some = F.col("_a") > 0
    s = _by(h, group).agg(
        F.max("total_n").alias("n"),
        F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).alias("n_zero"),
        F.coalesce(F.sum(F.when(some, rank * F.col("up"))), F.lit(0.0)).alias("_rp"),
        F.coalesce(F.sum(F.when(some, rank * (F.col("n") - F.col("up")))), F.lit(0.0)).alias("_rm"),
        F.coalesce(F.sum(F.when(some, (F.pow("n", F.lit(3)) - F.col("n")) / 2.0)), F.lit(0.0)).alias("_tie"))
    n, z0 = F.col("n").cast("double"), F.col("n_zero").cast("double")
    mean = (n * (n + 1) - z0 * (z0 + 1)) / 4.0
    var = (n * (n + 1) * (2 * n + 1) - z0 * (z0 + 1) * (2 * z0 + 1) - F.col("_tie")) / 24.0
    t = F.least("_rp", "_rm")
    live = F.col("n") > F.col("n_zero")
    return s.select(*group, "n", "n_zero", F.when(live, t).alias("statistic"),
                    F.when(live, (t - mean) / F.sqrt(var)).alias("z"))


def mcnemar_counts(df: DataFrame, group: Sequence[str], a: Column, b: Column) -> DataFrame:
    """Discordant counts per group."""
    return _by(df, group).agg(
        F.sum((a & ~b).cast("int")).alias("n10"), F.sum((~a & b).cast("int")).alias("n01"))


def mcnemar(df: DataFrame, group: Sequence[str], a: Column, b: Column) -> DataFrame:
    return mcnemar_counts(df, group, a, b).withColumn(
        "p_value", stats.mcnemar_p("n10", "n01"))


def within_corr(df: DataFrame, group: Sequence[str], stratum: Sequence[str],
                x: str, y: str) -> DataFrame:
    """Correlation after centring inside each stratum (strata of 1 dropped).

    Sums of squares per stratum are enough; no row is centred or joined back.
    """
    s = df.groupBy(*group, *stratum).agg(
        F.count(F.lit(1)).alias("_n"),
        F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"))
    s = s.filter("_n >= 2")
    xx, yy = F.sum(F.col("_n") * F.col("_vx")), F.sum(F.col("_n") * F.col("_vy"))
    live = (xx > 0) & (yy > 0)
    return _by(s, group).agg(
        F.when(live, F.sum(F.col("_n") * F.col("_c")) / F.sqrt(xx * yy)).alias("r_within"),
        F.count(F.lit(1)).alias("n_strata"), F.sum("_n").alias("n"))


def stratified_permutation(df: DataFrame, stratum: str, key: Column, x: str, y: str,
                           n_perm: int, seed: str) -> DataFrame:
    """Permute x inside each stratum; p of the within-stratum correlation.

    Within a replicate the row at id-rank i receives the x of the row at
    hash-rank i of the same stratum.
    """
    d = df.select(stratum, key.cast("double").alias("_k"), x, y)
    obs = within_corr(d, [], [stratum], x, y)
    ys = replicates(ranks.hash_order(d, [stratum], "_k", "_i").select(
        stratum, "_i", y), n_perm)
    xs = replicates(d, n_perm).withColumn(
        "_u", uniform(seed, F.col("rep"), F.col("_k").cast("long")))
    xs = ranks.hash_order(xs, ["rep", stratum], "_u", "_i").select("rep", stratum, "_i", x)
    null = within_corr(ys.join(xs, ["rep", stratum, "_i"]), ["rep"], [stratum], x, y)
    j = null.select(F.col("r_within").alias("_r")).crossJoin(F.broadcast(obs))
    hit = F.abs("_r") >= F.abs("r_within") - F.lit(1e-12)
    return j.groupBy("r_within", "n_strata", "n").agg(
        ((F.sum(F.coalesce(hit, F.lit(False)).cast("int")) + 1) / F.lit(n_perm + 1)).alias("p_value"))


def adjust(pvalues: DataFrame, family: Sequence[str], p: str, key: Sequence[str],
           alpha: float = 0.05) -> DataFrame:
    """Holm and Benjamini-Hochberg adjusted p-values over each family of tests.

    A family is a list of reported tests, so it fits one window partition.
    """
    w = W.partitionBy(*family).orderBy(p, *key)
    all_ = W.partitionBy(*family)
    d = pvalues.withColumns({"_i": F.row_number().over(w) - 1, "_m": F.count(F.lit(1)).over(all_)})
    holm = F.least(F.lit(1.0), (F.col("_m") - F.col("_i")) * F.col(p))
    bh = F.col(p) * F.col("_m") / (F.col("_i") + 1)
    d = d.withColumns({
        "p_holm": F.max(holm).over(w.rowsBetween(W.unboundedPreceding, 0)),
        "p_bh": F.least(F.lit(1.0), F.min(bh).over(w.rowsBetween(0, W.unboundedFollowing)))})
    return d.withColumns({"reject_holm": F.col("p_holm") <= F.lit(alpha),
                          "reject_bh": F.col("p_bh") <= F.lit(alpha)}).drop("_i", "_m")


#: cumulated Poisson(1) probabilities: weight k when the draw is below entry k; up to where no 53-bit draw lies above
_POISSON = [sum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1)) for k in range(18)]


def copies(u: Column) -> Column:
    """Bootstrap copy count of a row: Poisson(1) by inversion of one draw."""
    out = F.lit(len(_POISSON))
    for k in range(len(_POISSON) - 1, -1, -1):
        out = F.when(u < F.lit(_POISSON[k]), F.lit(k)).otherwise(out)
    return out


#: A statistic of resampled rows: takes the column with a row's copies, gives an aggregate over them.
Statistic = Callable[[Column], Column]


def mean_of(value: str | Column) -> Statistic:
    v = F.col(value) if isinstance(value, str) else value
    return lambda w: F.sum(w * v) / F.sum(w)


def ratio_of(top: str, bottom: str) -> Statistic:
    """Ratio of two sums; null where the lower one is 0."""
    return lambda w: F.try_divide(F.sum(w * F.col(top)), F.sum(w * F.col(bottom)))


def quantile_of(value: str, share: float) -> Statistic:
    """Interpolated quantile.  A task holds the distinct values of a group: round a continuous value first if there are many."""
    return lambda w: F.percentile(F.col(value), F.lit(share), w)


def draws(n_boot: int, seed: str, key: Column) -> Column:
    """Array of a row's copies in each replicate, from a hash of seed, replicate and key."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_boot - 1)), lambda r: copies(uniform(seed, r, key)))


def resampled(df: DataFrame, group: Sequence[str], key: Column, statistic: Statistic, n_boot: int, seed: str) -> DataFrame:
    """``group, rep, value``: the caller's aggregate in each replicate.

    Copies are drawn and added up inside the tasks; what is shuffled is one partial
    aggregate per task, group and replicate, never a row's replicate.
    """
    r = replicates(df, n_boot).withColumn("_w", copies(uniform(seed, F.col("rep"), key))).filter("_w > 0")
    return r.groupBy(*group, "rep").agg(statistic(F.col("_w")).alias("value"))


def bootstrap(df: DataFrame, group: Sequence[str], key: Column, value: Column,
              n_boot: int, seed: str, stat: str | Statistic = "mean", level: float = 0.95) -> DataFrame:
    """Percentile interval under Poisson resampling: of the mean or median of ``value``, or of any ``Statistic``.

    Rows whose ``value`` is null are left out; a replicate whose statistic is null doesn't count.
    """
    d = df.withColumn("_v", value).filter("_v IS NOT NULL").withColumn("_k", key)
    if isinstance(stat, str):
        stat = {"mean": mean_of("_v"), "median": quantile_of("_v", 0.5)}[stat]
    reps = resampled(d, group, F.col("_k"), stat, n_boot, seed)
    return interval(reps.filter("value IS NOT NULL").withColumnRenamed("value", "_s"), group, level)


def auc_replicates(df: DataFrame, group: Sequence[str], key: Column, score: str, positive: Column, n_boot: int, seed: str) -> DataFrame:
    """``group, rep, value``: the AUROC of ``score`` in each replicate (null without both kinds of rows).

    Rows are range-partitioned by score once, equal scores together.  A task adds up, for all replicates
    at a time, the copies of both kinds and the pairs among its own rows; partitions then join in score order, a
    later one's positives beating all negatives before it.  Shuffled are the rows, and one number per task,
    group and replicate.
    """
    group = list(group)
    d = df.filter(F.col(score).isNotNull()).select(*group, F.col(score).cast("double").alias("_s"), key.alias("_k"), positive.alias("_p"))
    d = d.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group, "_s").sortWithinPartitions(*group, "_s")
    out = T.StructType([*(d.schema[g] for g in group), T.StructField("part", T.LongType()),
                        *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("p", "q", "u"))])

    def run(batches):
        part, at, last, sums = TaskContext.get().partitionId(), None, None, None
        for b in batches:
            if not len(b):
                continue
            code = b.groupby(group, dropna=False, sort=False).ngroup().to_numpy() if group else np.zeros(len(b), int)
            score_, pos, w = b["_s"].to_numpy(), b["_p"].to_numpy(bool), np.vstack(b["_w"].to_numpy()).astype(float)
            cut = np.flatnonzero((code[1:] != code[:-1]) | (score_[1:] != score_[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(b)]):
                here = tuple(b.iloc[lo][group]) if group else ()
                if str(here) != str(at):
                    if sums is not None:
                        yield given(at, part, sums)
                    at, last, sums = here, None, np.zeros((5, w.shape[1]))
                # rows: positives and negatives below this score, pairs won, positives and negatives at this score
                if score_[lo] != last:
                    sums[2] += sums[3] * (sums[1] + sums[4] / 2)
                    sums[0] += sums[3]
                    sums[1] += sums[4]
                    sums[3:], last = 0, score_[lo]
                sums[3] += w[lo:hi][pos[lo:hi]].sum(0)
                sums[4] += w[lo:hi][~pos[lo:hi]].sum(0)
        if sums is not None:
            yield given(at, part, sums)

    def given(at, part, sums):
        p, q, u = sums[0] + sums[3], sums[1] + sums[4], sums[2] + sums[3] * (sums[1] + sums[4] / 2)
        return pd.DataFrame([(*at, part, p, q, u)], columns=out.fieldNames())

    parts = d.withColumn("_w", draws(n_boot, seed, F.col("_k"))).drop("_k").mapInPandas(run, out)
    long = parts.select(*group, "part", F.posexplode(F.arrays_zip("p", "q", "u")).alias("rep", "x")).select(*group, "part", "rep", "x.*")
    before = W.partitionBy(*group, "rep").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    won = long.withColumn("_u", F.col("u") + F.col("p") * F.coalesce(F.sum("q").over(before), F.lit(0.0)))
    return won.groupBy(*group, "rep").agg(F.try_divide(F.sum("_u"), F.sum("p") * F.sum("q")).alias("value"))


def interval(reps: DataFrame, group: Sequence[str], level: float) -> DataFrame:
    a = (1.0 - level) / 2.0
    return ranks.quantiles(reps, group, "_s", {"ci_low": a, "ci_high": 1.0 - a}) \
        .withColumnRenamed("n", "n_rep")


def bootstrap_auc_gap(df: DataFrame, key: Column, score_a: str, score_b: str,
                      positive: Column, n_boot: int, seed: str, level: float = 0.95) -> DataFrame:
    """Interval of AUC(a) - AUC(b) over episode resamples."""
    d = df.select(key.alias("_key"), positive.alias("_pos"), F.inline(F.array(
        F.struct(F.lit("a").alias("m"), F.col(score_a).alias("s")), F.struct(F.lit("b").alias("m"), F.col(score_b).alias("s")))))
    a = auc_replicates(d, ["m"], F.col("_key"), "s", F.col("_pos"), n_boot, seed)
    reps = a.filter("value IS NOT NULL").groupBy("rep").agg(
        (F.max(F.when(F.col("m") == "a", F.col("value")))
         - F.max(F.when(F.col("m") == "b", F.col("value")))).alias("_s"))
    return interval(reps, [], level)


def clustered_sign_flip(df: DataFrame, key: str, arm: str, value: str, a: str, b: str,
                        n_perm: int, seed: str) -> DataFrame:
    """Average the repeats per (key, arm), pair on common keys, flip signs."""
    m = df.groupBy(key, arm).agg(F.avg(value).alias("_m"))
    w = m.groupBy(key).agg(F.max(F.when(F.col(arm) == a, F.col("_m"))).alias("_a"),
                           F.max(F.when(F.col(arm) == b, F.col("_m"))).alias("_b"))
    w = w.filter("_a IS NOT NULL AND _b IS NOT NULL")
    return sign_flip(w, [], F.col(key), F.col("_a") - F.col("_b"), n_perm, seed)


def chi_square(df: DataFrame, arm: str, cls: str) -> DataFrame:
    """Chi-square statistic of a class mix across arms.

    sum(o^2 / e) - n needs only the observed cells, so empty cells cost nothing.
    """
    c = df.groupBy(arm, cls).agg(F.count(F.lit(1)).cast("double").alias("_o"))
    rows = c.groupBy(arm).agg(F.sum("_o").alias("_r"))
    cols = c.groupBy(cls).agg(F.sum("_o").alias("_c"))
    j = c.join(rows, arm).join(cols, cls)
    s = j.agg(F.sum(F.col("_o") * F.col("_o") / (F.col("_r") * F.col("_c"))).alias("_q"),
              F.sum("_o").alias("_n"), F.countDistinct(arm).alias("_ra"), F.countDistinct(cls).alias("_ca"))
    return s.select((F.col("_n") * (F.col("_q") - 1)).alias("chi2"),
                    ((F.col("_ra") - 1) * (F.col("_ca") - 1)).alias("dof"))


def contrasts(df: DataFrame, group: Sequence[str], key: Column, a: str, b: str,
              n_perm: int, seed: str, n_boot: int = 200, level: float = 0.95) -> DataFrame:
    """Paired mean difference per metric with bootstrap interval, permutation p and Holm over the metrics."""
    diff = F.col(a) - F.col(b)
    base = df.groupBy(*group).agg(
        F.avg(a).alias("a_mean"), F.avg(b).alias("b_mean"), F.stddev_samp(a).alias("a_sd"),
        F.stddev_samp(b).alias("b_sd"), F.sum((diff > 0).cast("int")).alias("wins"))
    p = sign_flip(df, group, key, diff, n_perm, seed)
    ci = bootstrap(df, group, key, diff, n_boot, f"{seed}-ci", "mean", level).select(*group, "ci_low", "ci_high")
    return adjust(p.join(base, list(group)).join(ci, list(group), "left"), [], "p_value", list(group))


def leave_one_out_corr(df: DataFrame, stratum: str, x: str, y: str) -> DataFrame:
    """Within-stratum correlation without each stratum in turn.

    The sums of a stratum are subtracted from the grand sums, so the rows are
    read once however many strata there are.
    """
    s = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(x, y).alias("c"),
                                F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    live = F.when(F.col("n") >= 2, F.col("n")).otherwise(0)
    s = s.select(stratum, (live * F.col("c")).alias("xy"), (live * F.col("vx")).alias("xx"), (live * F.col("vy")).alias("yy"))
    tot = s.agg(F.sum("xy").alias("_xy"), F.sum("xx").alias("_xx"), F.sum("yy").alias("_yy"))
    j = s.crossJoin(F.broadcast(tot))
    xx, yy = F.col("_xx") - F.col("xx"), F.col("_yy") - F.col("yy")
    return j.select(F.col(stratum).alias("dropped"), F.when(
        (xx > 0) & (yy > 0), (F.col("_xy") - F.col("xy")) / F.sqrt(xx * yy)).alias("r_within"))
