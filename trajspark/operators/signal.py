"""Whole step vectors: semantic, uncertainty, metadata and derived channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from trajspark import schema
from trajspark.functions import text, vector
from trajspark.functions.hashing import uniform
from trajspark.operators import features, grounding, models, ordered, validate


def observed(steps: DataFrame) -> DataFrame:
    """Columns that a logged step has by itself: calls, reasoning and tool columns.  No shuffle; streams too."""
    d = text.step_calls(steps, "text", "tool_events")
    return d.withColumns(features.call_columns(F.col("calls"), validate.latency_of(F.col("latency_s"))[0]))


def from_log(steps: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Columns that ``signals`` needs, from steps in the log's own schema: ``observed`` and retries."""
    keys = list(keys)
    d = observed(steps)
    calls = d.select(*keys, t, F.explode("calls").alias("c")).select(*keys, t, "c.name", F.col("c.args").alias("args_key"))
    retries = features.retry_count(calls, keys, t)
    return d.join(retries, [*keys, t], "left").withColumn("retries", F.coalesce("retries", F.lit(0)))


def token_count() -> Column:
    return F.greatest(F.coalesce("output_tokens", F.lit(1)), F.lit(1)).cast("double")


def base_channels(steps: DataFrame) -> DataFrame:
    """Steps with ``e``, ``u`` and ``m``, which depend on the step alone.  No shuffle; streams too."""
    u = features.surprisal(F.col("token_logprobs"))
    act, _ = validate.action_of(F.col("action"))
    lat, _ = validate.latency_of(F.col("latency_s"))
    return models.embed_distinct(steps, "text", "e").withColumns({
        "u": F.array(u["mean"], u["peak"], u["slope"], u["high_share"]),
        "m": F.array(*[(act == a).cast("double") for a in schema.ACTION_TYPES], F.log(lat), F.log(token_count()),
                     F.coalesce(F.col("error"), F.lit(False)).cast("double"))})


def signals(steps: DataFrame, keys: Sequence[str], t: str, extended: bool = True, grounded: bool = False) -> DataFrame:
    """Steps with channels ``e``, ``u``, ``m``, when extended ``x``, and when grounded ``g``: 43, 51 or 60 wide.

    Needs text, task, action, latency_s, output_tokens, error, token_logprobs
    and the columns of ``from_log``.  The anchor is the first step's task or, without
    one, its reasoning (never its results, which would be held against themselves).
    """
    keys = list(keys)
    d = base_channels(steps)
    if grounded:
        d = grounding.grounding_channel(d, keys, t)
    if not extended:
        return d
    said = "reasoning" if "reasoning" in d.columns else "text"
    first = d.groupBy(*keys).agg(F.min_by(F.struct("task", said), F.col(t)).alias("_f"))
    anchors = first.select(*keys, models.embed_text(F.when(F.trim("_f.task") != "", F.col("_f.task")).otherwise(
        F.coalesce(f"_f.{said}", F.lit("")))).alias("_a"))
    d = d.withColumn("_use", features.context_use(token_count(), F.col("text")))
    d = features.past_vector_sum(d, keys, t, "e", schema.WIDTHS["e"], "_past", {"_cum": ordered.Run("sum", "_use")})
    d = ordered.lag(d, keys, t, {"_prev": "e"}).join(anchors, keys)
    drift = F.when(F.col("_prev").isNull(), 0.0).otherwise(1 - vector.dot(F.col("e"), F.col("_prev")))
    far = vector.norm(F.col("_past"))
    own = F.when((F.col(t) == 0) | (far == 0), 1.0).otherwise(vector.dot(F.col("e"), F.col("_past")) / far)
    return d.withColumn("x", F.array(
        drift, vector.dot(F.col("e"), F.col("_a")), F.col("tool_success"), F.col("retries").cast("double"),
        F.col("tool_latency"), features.context_share(F.col("_cum")), F.col("n_calls").cast("double"), own)) \
        .drop("_past", "_prev", "_a", "_use", "_cum")


def attribution(errors: DataFrame, keys: Sequence[str], t: str, dims: Sequence[str], floor: float = 0.005) -> DataFrame:
    """Share of each dim in the error accumulated so far, largest first."""
    runs = {f"_r_{d}": ordered.Run("sum", d) for d in dims}
    r = ordered.running(errors, keys, t, runs)
    total = sum((F.col(f"_r_{d}") for d in dims[1:]), F.col(f"_r_{dims[0]}"))
    shares = F.array(*[F.struct((F.col(f"_r_{d}") / total).alias("share"), F.lit(d).alias("dim")) for d in dims])
    shares = F.filter(shares, lambda s: s["share"] > F.lit(floor))
    return r.select(*keys, t, F.sort_array(shares, asc=False).alias("shares"))


def quadratic_parts(vec: Column, mean: Sequence[float], precision: Sequence[Sequence[float]], channels: dict[str, Sequence[int]]) -> dict[str, Column]:
    """What each channel (its positions in ``vec``) adds to a squared Mahalanobis distance: d_i (P d)_i over its positions.

    The parts add up to the whole distance.  Correlated channels can have a negative part.
    """
    d = F.transform(vec, lambda v, i: v - F.element_at(F.array(*map(F.lit, mean)), i + 1))
    row = lambda i: F.aggregate(F.zip_with(d, F.array(*map(F.lit, precision[i])), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    part = lambda i: F.get(d, F.lit(i)) * row(i)
    return {name: sum((part(i) for i in at[1:]), part(at[0])) for name, at in channels.items()}


def ensemble_parts(errors: dict[str, Column], scale: dict[str, float]) -> dict[str, Column]:
    """Surprise of each channel's ensemble: its mean squared error in units of its healthy level."""
    square = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x) / F.size(e)
    return {name: square(e) / F.lit(scale[name]) for name, e in errors.items()}


def channel_shares(steps: DataFrame, keys: Sequence[str], t: str, parts: dict[str, Column]) -> DataFrame:
    """``keys, t`` and, per channel, its share of what has accumulated up to the step.

    Parts are added along the run; a channel whose sum is negative (it speaks against the alarm) has share 0, and the
    shares of a step add up to 1 (0 each, where nothing has accumulated yet).
    """
    d = steps.select(*keys, t, *(c.alias(f"_p_{n}") for n, c in parts.items()))
    r = ordered.running(d, keys, t, {f"_r_{n}": ordered.Run("sum", f"_p_{n}") for n in parts})
    pos = {n: F.greatest(F.col(f"_r_{n}"), F.lit(0.0)) for n in parts}
    total = sum(list(pos.values())[1:], next(iter(pos.values())))
    return r.select(*keys, t, *(F.when(total > 0, c / total).otherwise(0.0).alias(n) for n, c in pos.items()))


def noise(seed: str, std: float, *key: Column) -> Column:
    """Gaussian noise from two keyed uniform draws."""
    a, b = uniform(f"{seed}a", *key), uniform(f"{seed}b", *key)
    return F.lit(std) * F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - a)) * F.cos(F.lit(6.283185307179586) * b)
