"""Repair arms: retries paired with the run they continue, outcomes, cost and graders.

A retry replays the first steps of the run that failed and goes its own way after
them.  The run is found by content: the longest prefix of the retry that some
original run also starts with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.operators import ordered
from trajspark.operators.ordered import Run

_HALVES = ("_pa", "_pb")


def prefix_digests(steps: DataFrame, keys: Sequence[str], t: str, content: Column) -> DataFrame:
    """``keys, t`` and the two numbers that identify the steps from 0 up to each step.

    Each step gives two 60-bit parts of SHA-256 over (position, content), and a
    prefix is their running sums, so a long run is summed segment by segment.
    Null contents equal each other and no text.
    """
    h = F.sha2(F.concat_ws(":", F.col(t).cast("string"), F.coalesce(F.concat(F.lit("="), content.cast("string")), F.lit("-"))), 256)
    part = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)")
    rows = steps.select(*keys, t, part(1).alias("_ha"), part(16).alias("_hb"))
    out = ordered.running(rows, keys, t, {"_pa": Run("sum", "_ha"), "_pb": Run("sum", "_hb")})
    return out.select(*keys, t, *[F.col(c).cast("decimal(38,0)").alias(c) for c in _HALVES])


def pair_by_prefix(originals: DataFrame, retries: DataFrame, run: str, t: str, content: Column,
                   scope: Sequence[str] = ()) -> DataFrame:
    """``run, origin, shared, calls``: the original each retry continues.

    Both tables hold (scope, run, t from 0, content).  ``origin`` is the original
    with the longest common prefix inside the scope (a task, say), of equals the
    smallest; null, with ``shared`` 0, where not even the first step agrees.
    ``calls``: steps of the retry after that prefix.

    Originals that start alike are reduced to one owner per prefix first, so the
    join gives at most one row per retry step whatever the number of runs is.
    """
    scope = list(scope)
    keys = [*scope, run]
    owner = prefix_digests(originals, keys, t, content).groupBy(*scope, t, *_HALVES).agg(F.min(run).alias("_owner"))
    mine = prefix_digests(retries, keys, t, content)
    met = mine.join(owner, [*scope, t, *_HALVES], "left")
    at = F.when(F.col("_owner").isNotNull(), F.col(t) + 1)
    return met.groupBy(*keys).agg(
        F.max_by("_owner", at).alias("origin"), F.coalesce(F.max(at), F.lit(0)).cast("int").alias("shared"),
        F.count(F.lit(1)).alias("_n")).select(*keys, "origin", "shared", (F.col("_n") - F.col("shared")).alias("calls"))


def arm_outcomes(rows: DataFrame, population: DataFrame, group: Sequence[str], arm: str, rep: str) -> DataFrame:
    """One row per (group, arm): what an arm recovers, breaks and costs.

    ``rows``: (group, arm, rep, was, now, calls), one per retried episode and
    repeat; ``population``: (group, n_total, n_correct) over every episode, retried
    or not.  Counts and rates are taken inside a repeat and then averaged, so an
    episode never counts once per repeat.  ``rate`` is over episodes that were
    wrong; ``net`` is what a deployment gets: correct before, plus recovered, minus
    broken, over all episodes.  ``calls_per_recovery`` is null where nothing recovers.
    Rows without a verdict before or after are counted in ``ungraded`` alone.
    """
    group = list(group)
    n = lambda c: F.sum(c.cast("int"))
    graded = F.col("was").isNotNull() & F.col("now").isNotNull()
    wrong, right = graded & ~F.col("was"), graded & F.col("was")
    per = rows.groupBy(*group, arm, rep).agg(
        n(wrong).alias("_w"), n(wrong & F.col("now")).alias("_r"), n(right & ~F.col("now")).alias("_b"),
        F.sum(F.when(wrong, F.col("calls"))).alias("_c"), n(~graded).alias("_u"))
    rate = F.try_divide("_r", "_w")
    out = per.groupBy(*group, arm).agg(
        F.count(F.lit(1)).alias("repeats"), F.sum("_u").alias("ungraded"), F.sum("_w").alias("n_wrong"),
        F.avg(rate).alias("rate"), F.min(rate).alias("rate_min"), F.max(rate).alias("rate_max"),
        F.avg("_r").alias("recovered"), F.avg("_b").alias("broken"),
        F.try_divide(F.sum("_c"), F.sum("_w")).alias("calls"))
    out = out.join(population.select(*group, "n_total", "n_correct"), group) if group else out.crossJoin(F.broadcast(population))
    return out.select(
        *group, arm, "repeats", "ungraded", "n_wrong", "rate", "rate_min", "rate_max", "recovered", "broken", "calls",
        F.try_divide("calls", F.when(F.col("rate") > 0, F.col("rate"))).alias("calls_per_recovery"),
        ((F.col("n_correct") + F.col("recovered") - F.col("broken")) / F.col("n_total")).alias("net"))


def grader_disagreement(rows: DataFrame, label: str, a: str, b: str, expected: Sequence[str] = ("incomplete",)) -> DataFrame:
    """``label, both, disagree, unexpected``: two graders over the rows that have both verdicts.

    They may differ on the ``expected`` labels, as one asks for the stated result
    and the other for the work; anywhere else a difference points at a reader.
    """
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    out = rows.filter(both).groupBy(label).agg(
        F.count(F.lit(1)).alias("both"), F.sum((F.col(a) != F.col(b)).cast("int")).alias("disagree"))
    return out.withColumn("unexpected", (F.col("disagree") > 0) & ~F.coalesce(F.col(label).isin(*expected), F.lit(False)))
