"""One-class reference statistics, fitted as distributed aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark import schema
from trajspark.functions.hashing import uniform
from trajspark.operators import ranks


def floored_scale(s: Column) -> Column:
    """Scale for z-scores: 1 when nothing varies, else at least 1e-3."""
    return F.when(s < schema.DEGENERATE_EPS, F.lit(1.0)).otherwise(
        F.greatest(s, F.lit(1e-3)))


def safe_scale(s: Column) -> Column:
    """Scale that reports raw deviations when nothing varies."""
    return F.when(s < schema.DEGENERATE_EPS, F.lit(1.0)).otherwise(s)


def standardizer(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Population mean and floored std of ``value`` per group."""
    return df.groupBy(*group).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("_sd")).select(
        *group, "mean", floored_scale(F.col("_sd")).alias("std"))


def robust_iqr(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Median and IQR / 1.349 per group (raw scale 1 when degenerate)."""
    q = ranks.quantiles(df, group, value, {"q25": .25, "med": .5, "q75": .75})
    return q.select(*group, F.col("med").alias("loc"),
                    safe_scale((F.col("q75") - F.col("q25")) / F.lit(1.349)).alias("scale"))


def robust_mad(df: DataFrame, group: Sequence[str], value: str, fallback: bool = True) -> DataFrame:
    """Median and 1.4826 * MAD per group; std when the MAD vanishes, or 0 without the ``fallback``."""
    group = list(group)
    ok = df.filter(F.col(value).isNotNull() & ~F.isnan(value)
                   & (F.abs(F.col(value)) < F.lit(float("inf"))))
    med = ranks.quantiles(ok, group, value, {"med": .5}).select(*group, "med")
    dev = (ok.join(F.broadcast(med), group) if group else ok.crossJoin(F.broadcast(med))) \
        .withColumn("_dev", F.abs(F.col(value) - F.col("med")))
    mad = ranks.quantiles(dev, group, "_dev", {"mad": .5}).select(*group, "mad")
    if not fallback:
        return (med.join(mad, group) if group else med.crossJoin(mad)).select(
            *group, F.col("med").alias("loc"), (F.lit(1.4826) * F.col("mad")).alias("scale"))
    sd = (ok.groupBy(*group) if group else ok.groupBy()).agg(
        F.stddev_pop(value).alias("_sd"))
    if group:
        j = med.join(mad, group).join(sd, group)
    else:
        j = med.crossJoin(mad).crossJoin(sd)
    raw = F.lit(1.4826) * F.col("mad")
    return j.select(*group, F.col("med").alias("loc"), safe_scale(
        F.when(raw < schema.DEGENERATE_EPS, F.col("_sd")).otherwise(raw)).alias("scale"))


def split_60_20_20(episodes: DataFrame, key: str, seed: str,
                   healthy: str = "is_healthy") -> DataFrame:
    """Healthy 60/20/20 by hash rank; every injected episode is test."""
    e = episodes.withColumn("_u", uniform(seed, F.col(key)))
    r = ranks.hash_order(e, [healthy], "_u", "_r")
    n_train = F.greatest(F.rint(F.col("_r_total") * 0.6), F.lit(1.0))
    n_val = F.greatest(F.rint(F.col("_r_total") * 0.2), F.lit(1.0))
    return r.withColumn("split", F.when(~F.col(healthy), "test")
                        .when(F.col("_r") < n_train, "train")
                        .when(F.col("_r") < n_train + n_val, "val")
                        .otherwise("test")).drop("_u", "_r", "_r_total")


def fit_held_split(episodes: DataFrame, key: str, seed: str,
                   fit_share: float = 0.85) -> DataFrame:
    """Fit / held-out parts of the healthy train episodes, shared by scorers."""
    e = episodes.withColumn("_u", uniform(seed, F.col(key)))
    r = ranks.hash_order(e, [], "_u", "_r")
    n_fit = F.greatest(F.rint(F.col("_r_total") * fit_share), F.lit(1.0))
    return r.withColumn("part", F.when(F.col("_r") < n_fit, "fit").otherwise("held")) \
        .drop("_u", "_r", "_r_total")


def stratified_two_fold(episodes: DataFrame, key: str, stratum: str, seed: str) -> DataFrame:
    """Alternate the hash order inside each stratum over two folds."""
    e = episodes.withColumn("_u", uniform(seed, F.col(key)))
    r = ranks.hash_order(e, [stratum], "_u", "_r")
    return r.withColumn("fold", (F.col("_r") % 2).cast("int")).drop("_u", "_r", "_r_total")
