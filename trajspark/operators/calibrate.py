"""Confidence calibration and its quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.operators import ranks


def conformal(reference: DataFrame, test: DataFrame, group: Sequence[str],
              score: str) -> DataFrame:
    """Confidence 1 - (1 + #{reference >= x}) / (n + 1) for every test row.

    Both sides meet in one cumulated histogram; no pair of rows is formed.
    Without reference rows in its group a test row has a null confidence.
    """
    group = list(group)
    both = reference.select(*group, score, F.lit(1).alias("_ref")).unionByName(
        test.select(*group, score, F.lit(0).alias("_ref")))
    h = ranks.histogram(both, group, score, {"r": F.col("_ref")}, descending=True)
    level = h.filter(F.col("total_r") > 0).select(
        *group, score, (F.lit(1.0) - (F.lit(1.0) + F.col("before_r") + F.col("r"))
                        / (F.col("total_r") + F.lit(1.0))).alias("confidence"))
    return test.join(level, [*group, score], "left")


def _bin(conf: Column, n_bins: int) -> Column:
    return F.greatest(F.least(F.floor(conf * n_bins), F.lit(n_bins - 1)), F.lit(0)).cast("int")


def reliability(df: DataFrame, group: Sequence[str], conf: str, label: Column,
                n_bins: int = 10) -> DataFrame:
    """One row per non-empty confidence bin."""
    return df.groupBy(*group, _bin(F.col(conf), n_bins).alias("bin")).agg(
        F.avg(conf).alias("mean_confidence"),
        F.avg(label.cast("double")).alias("empirical_freq"),
        F.count(F.lit(1)).alias("n")).withColumn(
        "bin_center", (F.col("bin") + 0.5) / F.lit(float(n_bins)))


def ece(df: DataFrame, group: Sequence[str], conf: str, label: Column,
        n_bins: int = 10) -> DataFrame:
    """Expected calibration error per group."""
    r = reliability(df, group, conf, label, n_bins)
    gap = F.abs(F.col("empirical_freq") - F.col("mean_confidence"))
    return (r.groupBy(*group) if group else r.groupBy()).agg(
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def ks_uniform(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Kolmogorov-Smirnov distance from Uniform(0, 1)."""
    v = df.withColumn(value, F.greatest(F.least(F.col(value), F.lit(1.0)), F.lit(0.0)))
    h = ranks.histogram(v, group, value)
    up = (F.col("before_n") + F.col("n")) / F.col("total_n") - F.col(value)
    down = F.col(value) - F.col("before_n") / F.col("total_n")
    return (h.groupBy(*group) if group else h.groupBy()).agg(
        F.max(F.greatest(up, down)).alias("ks"))


def isotonic(train: DataFrame, test: DataFrame, score: str, label: str,
             out: str = "probability") -> DataFrame:
    """Isotonic score -> probability, constant outside the fitted range.

    Equal scores are merged into one weighted point before the fit.
    """
    from pyspark.ml.regression import IsotonicRegression
    points = train.groupBy(score).agg(F.avg(label).alias("_y"),
                                      F.count(F.lit(1)).cast("double").alias("_w"))
    model = IsotonicRegression(featuresCol=score, labelCol="_y", weightCol="_w",
                               predictionCol=out).fit(points)
    return model.transform(test).withColumn(
        out, F.greatest(F.least(F.col(out), F.lit(1.0)), F.lit(0.0)))
