"""Online content gate over whole step vectors, for a log and for a stream alike.

Two streams, each held against its own healthy runs: behaviour (Mahalanobis distance
of the first 51 numbers, as a robust z) and content (largest one-sided robust z of
the grounding dims).  In display units 1.0 is the alarm level of either; a lexical
miss shows at least 1.5, unless healthy runs have such misses too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark import schema
from trajspark.operators import alarms, fit as fits, fusion, grounding, models, ranks
from trajspark.sources import sinks

#: Fixed value: what a lexical miss shows at least.
LEXICAL_DISPLAY = 1.5
DIMS = grounding.DIMS[:-1]
WIDTH = sum(n for c, n in schema.WIDTHS.items() if c != "g")


@dataclass(frozen=True)
class Levels:
    """Everything the gate knows of healthy runs: one model and a dozen numbers."""
    gaussian: models.Gaussian
    behaviour: tuple[float, float]               # location and scale
    theta: float                                 # alarm level of the behaviour z
    dims: dict[str, tuple[float, float]]         # location and scale per content dim
    content: tuple[float, float]
    rare: float                                  # 95 % level of the healthy runs' content peaks
    trip: float                                  # their largest peak, in units of it
    lexical: bool                                # whether a lexical miss says anything


def _streams(vectors: DataFrame, gaussian: models.Gaussian, dims: dict[str, tuple[float, float]]) -> DataFrame:
    zs = [F.greatest(F.least((F.col("g")[i] - F.lit(dims[n][0])) / F.lit(max(dims[n][1], schema.DEGENERATE_EPS)), F.lit(fusion.Z_CAP)), F.lit(0.0))
          for i, n in enumerate(DIMS)]
    d = vectors.withColumn("_v", F.concat("e", "u", "m", "x"))
    return d.withColumns({"_moved": models.mahalanobis(F.col("_v"), gaussian), "_content": F.greatest(*zs), "lexical": F.col("g")[len(DIMS)]}).drop("_v")


def _scale(x: float | None) -> float:
    return x if x is not None and x >= schema.DEGENERATE_EPS else 1.0


def fit(healthy: DataFrame, keys: Sequence[str], t: str, budget: float = 0.05) -> Levels:
    """Levels from the vectors (``e, u, m, x, g``) of healthy runs."""
    keys = list(keys)
    v = sinks.materialize(healthy.select(*keys, t, "e", "u", "m", "x", "g", F.concat("e", "u", "m", "x").alias("_v")), "gate_healthy")
    gaussian = models.fit_gaussian(v, "_v", WIDTH)
    stats = fusion.dim_stats(v.select(*[F.col("g")[i].alias(n) for i, n in enumerate(DIMS)]), DIMS).collect()  # one row per dim
    dims = {r["dim"]: (r["loc"], r["scale"]) for r in stats}
    s = sinks.materialize(_streams(v.drop("_v"), gaussian, dims).select(*keys, t, "_moved", "_content", "lexical"), "gate_streams")
    b, g = (fits.robust_mad(s, [], c).first() for c in ("_moved", "_content"))
    peaks = s.groupBy(*keys).agg(((F.max("_moved") - b["loc"]) / b["scale"]).alias("max_score"), ((F.max("_content") - g["loc"]) / g["scale"]).alias("g"))
    peaks = sinks.materialize(peaks.withColumn("monitor", F.lit("gate")), "gate_peaks")
    theta = alarms.pick_threshold(peaks, ["monitor"], "max_score", budget).first()["theta"]
    rare = _scale(ranks.quantiles(peaks, ["monitor"], "g", {"q": 0.95}, "higher").first()["q"])
    top = peaks.agg(F.max("g")).first()[0]
    lexical = s.agg(F.max("lexical")).first()[0] == 0.0
    return Levels(gaussian, (b["loc"], b["scale"]), _scale(theta), dims, (g["loc"], g["scale"]), rare, max(top / rare, 1.0), lexical)


def gated(vectors: DataFrame, levels: Levels) -> DataFrame:
    """``vectors`` with ``behaviour``, ``content`` and ``lexical``, the ``display`` score and whether it is an ``alarm``."""
    d = _streams(vectors, levels.gaussian, levels.dims)
    b = (F.col("_moved") - F.lit(levels.behaviour[0])) / F.lit(levels.behaviour[1]) / F.lit(levels.theta)
    g = (F.col("_content") - F.lit(levels.content[0])) / F.lit(levels.content[1]) / F.lit(levels.rare) / F.lit(levels.trip)
    miss = F.when(F.lit(levels.lexical) & (F.col("lexical") > 0), F.lit(LEXICAL_DISPLAY)).otherwise(F.lit(0.0))
    return d.withColumns({"behaviour": b, "content": g, "display": F.greatest(b, g, miss)}).drop("_moved", "_content").withColumn("alarm", F.col("display") > 1.0)
