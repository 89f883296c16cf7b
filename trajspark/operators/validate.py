"""Validation, acceptance and projection rules as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark import schema


def action_of(raw: Column) -> tuple[Column, Column]:
    """(normalised action, was it unknown) of a raw action name."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    table = F.create_map(*[F.lit(x) for kv in schema.ACTION_OF.items() for x in kv])
    hit = F.element_at(table, low)
    return F.coalesce(hit, F.lit("tool_call")), hit.isNull() & (low != "")


def unmapped_actions(df: DataFrame, raw: str) -> DataFrame:
    """How often each unknown action name occurs."""
    _, unknown = action_of(F.col(raw))
    return df.filter(unknown).groupBy(F.lower(F.col(raw)).alias("action")).agg(
        F.count(F.lit(1)).alias("n"))


def latency_of(raw: Column) -> tuple[Column, Column]:
    """(latency floored at 1 ms, is it refused): negatives are broken rows."""
    v = F.coalesce(raw, F.lit(1.0))
    return F.greatest(v, F.lit(schema.MIN_LATENCY_S)), v < 0


def _not_finite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def step_reject_reason(df: DataFrame) -> Column:
    """First reason a step record cannot be used, null when it is fine.

    Text columns hold numbers as written, so that "not a number" is told apart
    from "absent".  Columns that ``df`` lacks are not checked.
    """
    cols = set(df.columns)
    checks: list[tuple[Column, str]] = []
    if "token_logprobs" in cols:
        checks.append((F.exists("token_logprobs", lambda v: v.isNull()), "logprob not numeric"))
        checks.append((F.exists("token_logprobs", _not_finite), "logprob not finite"))
    if "latency_s" in cols:
        num = F.col("latency_s").try_cast("double")
        checks.append((F.col("latency_s").isNotNull() & num.isNull(), "latency not numeric"))
        checks.append((_not_finite(num) | (num < 0), "latency not finite and non-negative"))
    if "output_tokens" in cols:
        num = F.col("output_tokens").try_cast("int")
        checks.append((F.col("output_tokens").isNotNull() & num.isNull(), "output_tokens not an integer"))
        checks.append((num < 0, "output_tokens negative"))
    if "tool_events" in cols:
        checks.append((F.exists("tool_events", lambda e: F.trim(F.coalesce(e["name"], F.lit(""))) == ""),
                       "tool event without a name"))
        checks.append((F.exists("tool_events", lambda e: F.coalesce(_not_finite(e["latency_s"]), F.lit(False))),
                       "tool latency not finite"))
    if "_corrupt_record" in cols:
        checks.insert(0, (F.col("_corrupt_record").isNotNull(), "not a step object"))
    out = F.lit(None).cast("string")
    for cond, why in reversed(checks):
        out = F.when(F.coalesce(cond, F.lit(False)), why).otherwise(out)
    return out


def validate_steps(steps: DataFrame, keys: list[str], t: str = "t"
                   ) -> tuple[DataFrame, DataFrame]:
    """(usable steps, rejected episodes).

    One bad step rejects its whole episode; the reject names the earliest one.
    """
    s = steps.withColumn("reject_reason", step_reject_reason(steps))
    bad = s.filter(F.col("reject_reason").isNotNull()).groupBy(*keys).agg(
        F.min(t).alias("step"), F.min_by("reject_reason", t).alias("reason"))
    good = s.drop("reject_reason").join(bad.select(*keys), keys, "left_anti")
    fill = {"text": F.coalesce(F.col("text"), F.lit("")) if "text" in s.columns else None,
            "latency_s": F.coalesce(F.col("latency_s").try_cast("double"), F.lit(1.0))
            if "latency_s" in s.columns else None,
            "output_tokens": F.col("output_tokens").try_cast("int")
            if "output_tokens" in s.columns else None,
            "error": F.coalesce(F.col("error"), F.lit(False)) if "error" in s.columns else None}
    return good.withColumns({k: v for k, v in fill.items() if v is not None}), bad


def acceptance(min_steps: int = schema.MIN_STEPS, allow_unverified: bool = False) -> Column:
    """Acceptance verdict of an attempted episode.

    Needs n_steps, injector (null for healthy), applied_count, first_applied_t,
    success (nullable).  What happened decides, not what was asked for.
    """
    healthy = F.col("injector").isNull()
    verdict = F.when(F.col("n_steps") < min_steps, "too short")
    verdict = verdict.when(~healthy & (F.coalesce("applied_count", F.lit(0)) == 0), "never applied")
    verdict = verdict.when(~healthy & (F.col("first_applied_t") >= F.col("n_steps") - 1),
                           "no following step")
    verdict = verdict.when(healthy & (F.col("success") == F.lit(False)), "not successful")
    if not allow_unverified:
        verdict = verdict.when(healthy & F.col("success").isNull(), "unverified")
    return verdict.otherwise("accepted")


def admitted() -> Column:
    """An injected run counts when applied and 0 < first < n_steps - 1."""
    f = F.col("first_applied_t")
    return (F.coalesce("applied_count", F.lit(0)) > 0) & (f > 0) & (f < F.col("n_steps") - 1)


def invariant_violations(width: str = "width") -> Column:
    """Codes of the broken episode invariants, as an array."""
    inj = ~F.col("is_healthy")
    return F.array_compact(F.array(
        F.when(~F.col(width).isin(*schema.EPISODE_WIDTHS), "width"),
        F.when(~inj & (F.col("failure_class").isNotNull() | F.col("tau").isNotNull()), "healthy_label"),
        F.when(inj & ~F.coalesce(F.col("failure_class").isin(*schema.FAILURE_CLASSES), F.lit(False)), "class"),
        F.when(inj & ~F.coalesce((F.col("tau") > 0) & (F.col("tau") < F.col("n_steps")), F.lit(False)), "tau"),
        F.when(inj & ~F.coalesce(F.col("t_fail") == F.col("n_steps") - 1, F.lit(False)), "t_fail")))


def use_uncertainty(episodes: DataFrame, dataset: str, has_logprobs: str,
                    share: float = 0.9) -> DataFrame:
    """Per dataset: keep the uncertainty channel only if enough episodes have it."""
    return episodes.groupBy(dataset).agg(
        F.avg(F.col(has_logprobs).cast("double")).alias("logprob_share")).withColumn(
        "use_uncertainty", F.col("logprob_share") >= F.lit(share))
