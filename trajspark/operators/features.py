"""Per-step features of a trajectory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from trajspark import schema
from trajspark.operators import ordered, ranks


def canonical_json(col: str | Column) -> Column:
    """Order- and whitespace-free text of a JSON object.

    Text that is not a JSON object keeps its words, one space apart.
    """
    c = F.col(col) if isinstance(col, str) else col
    m = F.from_json(c, "map<string,string>")
    # A number stays a number; anything else is written as a JSON string.
    item = lambda e: F.concat(
        F.lit('"'), e["key"], F.lit('":'),
        F.when(e["value"].rlike(r"^(-?\d+(\.\d+)?|true|false|null|\{.*\}|\[.*\])$"), e["value"])
        .otherwise(F.concat(F.lit('"'), e["value"], F.lit('"'))))
    text = F.concat(F.lit("{"), F.array_join(
        F.transform(F.array_sort(F.map_entries(m)), item), ","), F.lit("}"))
    return F.coalesce(text, F.trim(F.regexp_replace(c, r"\s+", " ")))


def tool_step(calls: DataFrame, step_key: Sequence[str], step_latency: Column) -> DataFrame:
    """Success rate, call count and log tool latency of each step with calls.

    Needs is_error and latency_s (null = not measured).  Steps without calls
    get 1, 0 and 0 from the left join in ``with_tool_step``.
    """
    return calls.groupBy(*step_key).agg(
        (F.lit(1.0) - F.avg(F.col("is_error").cast("double"))).alias("tool_success"),
        F.count(F.lit(1)).alias("n_calls"),
        F.avg("latency_s").alias("_lat")).withColumn(
        "tool_latency", F.when(F.col("_lat").isNotNull(), F.log(F.greatest("_lat", F.lit(schema.MIN_LATENCY_S))))
        .otherwise(F.log(step_latency / F.col("n_calls")))).drop("_lat")


def with_tool_step(steps: DataFrame, per_step: DataFrame, step_key: Sequence[str]) -> DataFrame:
    """Left join of ``tool_step``; a step without tools is a success."""
    return steps.join(per_step, list(step_key), "left").withColumns({
        "tool_success": F.coalesce("tool_success", F.lit(1.0)),
        "n_calls": F.coalesce("n_calls", F.lit(0)),
        "tool_latency": F.coalesce("tool_latency", F.lit(0.0))})


def call_columns(calls: Column, step_latency: Column) -> dict[str, Column]:
    """Success rate, call count and log tool latency from a step's array of calls (latency not measured by call)."""
    n = F.coalesce(F.size(calls), F.lit(0))
    failed = F.size(F.filter(calls, lambda c: c["is_error"]))
    return {"tool_success": F.when(n > 0, 1.0 - failed / n).otherwise(1.0), "n_calls": n,
            "tool_latency": F.when(n > 0, F.log(step_latency / n)).otherwise(0.0)}


def retry_count(calls: DataFrame, keys: Sequence[str], step: str) -> DataFrame:
    """Calls per step whose (name, args_key) already ran in an earlier step.

    Pure aggregates: a call is no retry exactly when its step is the first
    step of its signature, so the first-step counts are taken off the totals.
    """
    keys = list(keys)
    sig = calls.groupBy(*keys, "name", "args_key", step).agg(F.count(F.lit(1)).alias("c"))
    first = sig.groupBy(*keys, "name", "args_key").agg(
        F.min(step).alias(step), F.min_by("c", step).alias("c"))
    both = sig.select(*keys, step, "c", F.lit(0).cast("long").alias("f")).unionByName(
        first.select(*keys, step, F.lit(0).cast("long").alias("c"), F.col("c").alias("f")))
    return both.groupBy(*keys, step).agg((F.sum("c") - F.sum("f")).alias("retries"))


def stuck(steps: DataFrame, keys: Sequence[str], t: str, is_error: Column,
          signature: Column, n: int) -> DataFrame:
    """True when the last n steps all failed or all had one signature."""
    lb = ordered.look_back(steps.withColumns({"_e": is_error.cast("int"), "_s": signature}),
                           keys, t, n - 1)
    w = lb.window(-(n - 1))
    return lb.with_columns({"stuck": (F.col(t) >= n - 1) & (
        (F.min("_e").over(w) == 1) | (F.min("_s").over(w) == F.max("_s").over(w)))}).drop("_e", "_s")


def healthy_band(steps: DataFrame, t: str, value: str, min_runs: int) -> DataFrame:
    """p10 / p50 / p90 per step index, up to the first index with too few runs."""
    q = ranks.quantiles(steps, [t], value, {"p10": .1, "p50": .5, "p90": .9})
    short = steps.groupBy(t).count().filter(F.col("count") < min_runs).agg(F.min(t).alias("_stop"))
    return q.crossJoin(F.broadcast(short)).filter(
        F.col("_stop").isNull() | (F.col(t) < F.col("_stop"))).drop("_stop")


def surprisal(logprobs: Column) -> dict[str, Column]:
    """mean, peak, slope over the index and share above 2.5 nats of -logprob."""
    n = F.coalesce(F.size(logprobs), F.lit(0))
    s = F.transform(logprobs, lambda v: -v)
    total = F.aggregate(s, F.lit(0.0), lambda a, v: a + v)
    dotted = F.aggregate(F.transform(s, lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    nn = n.cast("double")
    si, sii = nn * (nn - 1) / 2, nn * (nn - 1) * (2 * nn - 1) / 6
    slope = (nn * dotted - si * total) / (nn * sii - si * si)
    missing = logprobs.isNull() | (n == 0)
    high = F.size(F.filter(s, lambda v: v > schema.HIGH_SURPRISAL_NATS)) / nn
    miss = F.lit(schema.MISSING_SURPRISAL)
    return {"mean": F.when(missing, miss).otherwise(total / nn),
            "peak": F.when(missing, miss).otherwise(F.array_max(s)),
            "slope": F.when(missing | (n < 2), F.lit(0.0)).otherwise(slope),
            "high_share": F.when(missing, F.lit(0.0)).otherwise(high)}


def context_use(tokens: Column, text: Column) -> Column:
    """What a step adds to the context: its tokens and a quarter of its characters."""
    return tokens.cast("double") + F.length(text) / 4.0


def context_share(used: Column, budget: float = schema.CONTEXT_BUDGET_TOKENS) -> Column:
    return F.least(used / F.lit(budget), F.lit(schema.CONTEXT_RATIO_CAP))


def context_ratio(steps: DataFrame, keys: Sequence[str], t: str, tokens: Column,
                  text: Column, budget: float = schema.CONTEXT_BUDGET_TOKENS) -> DataFrame:
    """Running (tokens + chars / 4) over the context budget, capped."""
    s = steps.withColumn("_use", context_use(tokens, text))
    return ordered.running(s, keys, t, {"_cum": ordered.Run("sum", "_use")}).withColumn(
        "ctx_ratio", context_share(F.col("_cum"), budget)).drop("_use", "_cum")


def stale_toolset(calls: DataFrame, corpus: Sequence[str], name: str,
                  served: Sequence[str]) -> DataFrame:
    """Corpora that call a tool no longer served, with the names."""
    seen = calls.groupBy(*corpus, name).count()
    stale = F.when(~F.col(name).isin(*served), F.col(name))
    names = F.array_join(F.array_sort(F.collect_set(stale)), ",")
    return seen.groupBy(*corpus).agg(
        F.bool_or(stale.isNotNull()).alias("refused"),
        F.when(F.max(stale).isNotNull(), names).alias("stale"))


def transcripts(steps: DataFrame, keys: Sequence[str], t: str, action: Column, text: Column) -> DataFrame:
    """Transcript up to each step.

    The output itself is quadratic in the run length; ``transcripts_at`` gives
    the chosen steps only.
    """
    line = F.concat(F.lit("step "), (F.col(t) + 1).cast("string"), F.lit(" ("), action, F.lit("): "), F.trim(text))
    w = W.partitionBy(*keys).orderBy(t).rowsBetween(W.unboundedPreceding, 0)
    return steps.withColumn("_line", line).withColumn(
        "transcript", F.array_join(F.collect_list("_line").over(w), "\n")).drop("_line")


def transcripts_at(steps: DataFrame, picks: DataFrame, keys: Sequence[str], t: str, upto: str,
                   action: Column, text: Column) -> DataFrame:
    """One transcript per picked (key, upto): lines up to that step."""
    line = F.concat(F.lit("step "), (F.col(t) + 1).cast("string"), F.lit(" ("), action, F.lit("): "), F.trim(text))
    j = steps.select(*keys, F.col(t).alias("_t"), line.alias("_line")).join(picks, list(keys)) \
        .filter(F.col("_t") <= F.col(upto))
    return j.groupBy(*keys, upto).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_t", "_line"))), lambda x: x["_line"]), "\n").alias("transcript"))


def healthy_null(runs: DataFrame, rules: Sequence[tuple[str, int]]) -> DataFrame:
    """Keep runs that pass every rule so far, dropping a rule that leaves too few.

    ``rules`` are (boolean column, least number of runs left), cumulative.
    """
    keep, counts = F.lit(True), []
    for i, (c, _) in enumerate(rules):
        keep = keep & F.col(c)
        counts.append(F.sum(keep.cast("int")).alias(f"_n{i}"))
    n = runs.agg(*counts)
    out, keep, prior = runs.crossJoin(F.broadcast(n)), F.lit(True), F.lit(True)
    for i, (c, least) in enumerate(rules):
        last = i == len(rules) - 1
        keep = keep & F.col(c)
        prior = prior & ((F.col(f"_n{i}") < least) | (F.col(c) if last else keep))
    return out.filter(prior).drop(*[f"_n{i}" for i in range(len(rules))])


def past_vector_sum(steps: DataFrame, keys: Sequence[str], t: str, vec: str, n: int, out: str,
                    more: dict[str, ordered.Run] | None = None) -> DataFrame:
    """Sum of the earlier vectors of the run (zeros at the head); ``more`` running aggregates share the pass."""
    d = steps.withColumns({f"_v{i}": F.col(vec)[i] for i in range(n)})
    runs = {f"_s{i}": ordered.Run("sum", f"_v{i}", False) for i in range(n)}
    r = ordered.running(d, keys, t, runs | (more or {}))
    return r.withColumn(out, F.array(*[F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) for i in range(n)])).drop(
        *[f"_v{i}" for i in range(n)], *[f"_s{i}" for i in range(n)])


def warmup_centroid(steps: DataFrame, keys: Sequence[str], t: str, vec: str, n: int, warmup: int,
                    out: str) -> DataFrame:
    """Sum of the first ``warmup`` vectors per run (direction of their mean)."""
    return steps.filter(F.col(t) < warmup).groupBy(*keys).agg(
        F.array(*[F.sum(F.col(vec)[i]) for i in range(n)]).alias(out))
