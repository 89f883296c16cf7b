"""Queries for repair arms: pairs by prefix, outcomes and graders."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.operators import repairs
from trajspark.plans import base
from trajspark.plans.base import cte, sql
from trajspark.plans.numeric import R
from trajspark.plans.registry import query

cte("starts", ("steps",), """
  SELECT user_id, user_id % 3 = 0 AS original, t, string_agg(event_type, ',') OVER (PARTITION BY user_id ORDER BY t) AS prefix FROM steps""")
cte("owners", ("starts",), "SELECT prefix, min(user_id) AS origin FROM starts WHERE original GROUP BY prefix")
cte("rpairs", ("starts", "owners"), """
  SELECT user_id, arg_max(origin, t) FILTER (origin IS NOT NULL) AS origin, coalesce(max(t + 1) FILTER (origin IS NOT NULL), 0)::INTEGER AS shared,
    count(*) - coalesce(max(t + 1) FILTER (origin IS NOT NULL), 0) AS calls FROM starts LEFT JOIN owners USING (prefix) WHERE NOT original GROUP BY user_id""")
cte("verdicts", ("steps",), """
  SELECT user_id, arg_max(value, t) > 20 AS ok, CASE WHEN arg_max(event_type, t) <> 'click' THEN arg_max(value, t) > 26 END AS ok2,
    CASE WHEN arg_max(event_type, t) = 'view' THEN 'incomplete' ELSE arg_max(event_type, t) END AS label FROM steps GROUP BY user_id""")
cte("arms", ("rpairs", "verdicts"), """
  SELECT p.user_id, CASE WHEN p.user_id % 2 = 0 THEN 'resample' ELSE 'feedback' END AS arm, (p.user_id // 2) % 4 AS rep,
    o.ok AS was, CASE WHEN p.user_id % 17 <> 1 THEN r.ok END AS now, calls, r.label, r.ok2
  FROM rpairs p JOIN verdicts o ON o.user_id = p.origin JOIN verdicts r ON r.user_id = p.user_id""")


def pairs(spark, d):
    s = base.steps(spark, d).select("user_id", "t", "event_type")
    original = F.col("user_id") % 3 == 0
    return repairs.pair_by_prefix(s.filter(original), s.filter(~original), "user_id", "t", F.col("event_type"))


def verdicts(spark, d):
    last = base.steps(spark, d).groupBy("user_id").agg(F.max_by(F.struct("value", "event_type"), "t").alias("e"))
    kind, value = F.col("e.event_type"), F.col("e.value")
    return last.select("user_id", (value > 20).alias("ok"), F.when(kind != "click", value > 26).alias("ok2"),
                       F.when(kind == "view", "incomplete").otherwise(kind).alias("label"))


def arms(spark, d):
    v, u = verdicts(spark, d), F.col("user_id")
    return pairs(spark, d).join(v.select(F.col("user_id").alias("origin"), F.col("ok").alias("was")), "origin").join(v, "user_id").select(
        "user_id", F.when(u % 2 == 0, "resample").otherwise("feedback").alias("arm"), (F.floor(u / 2) % 4).alias("rep"),
        "was", F.when(u % 17 != 1, F.col("ok")).alias("now"), "calls", "label", "ok2")


@query("repair_pairs", sql("SELECT user_id, origin, shared, calls FROM rpairs", "rpairs"))
def _(spark, d):
    """The run that every retry continues, found by the longest common prefix of its events."""
    return pairs(spark, d)


@query("repair_arms", sql("""
, p AS (SELECT arm, rep, count(*) FILTER (NOT was AND now IS NOT NULL) AS w, count(*) FILTER (NOT was AND now) AS r, count(*) FILTER (was AND NOT now) AS b,
   sum(calls) FILTER (NOT was AND now IS NOT NULL) AS c, count(*) FILTER (now IS NULL) AS u FROM arms GROUP BY arm, rep),
a AS (SELECT arm, count(*) AS repeats, sum(u)::BIGINT AS ungraded, sum(w)::BIGINT AS n_wrong, avg(r / w) AS rate, min(r / w) AS lo, max(r / w) AS hi,
   avg(r) AS rec, avg(b) AS brk, sum(c) / sum(w) AS calls FROM p GROUP BY arm),
n AS (SELECT count(*) AS total, count(*) FILTER (ok) AS good FROM verdicts WHERE user_id % 3 = 0)
SELECT arm, repeats, ungraded, n_wrong, round(rate, 6) AS rate, round(lo, 6) AS rate_min, round(hi, 6) AS rate_max, round(rec, 6) AS recovered, round(brk, 6) AS broken,
  round(calls, 6) AS calls, round(CASE WHEN rate > 0 THEN calls / rate END, 6) AS calls_per_recovery, round((good + rec - brk) / total, 6) AS net FROM a, n""", "arms").replace("\n\n,", ",", 1))
def _(spark, d):
    """Recovered minus broken on the pairs, cost of a recovery and the net over all runs."""
    v = verdicts(spark, d).filter(F.col("user_id") % 3 == 0).agg(
        F.count(F.lit(1)).alias("n_total"), F.sum(F.col("ok").cast("int")).alias("n_correct"))
    o = repairs.arm_outcomes(arms(spark, d), v, [], "arm", "rep")
    exact = ("arm", "repeats", "ungraded", "n_wrong")
    return o.select(*exact, *[R(c).alias(c) for c in o.columns if c not in exact])


@query("grader_disagreement", sql("""
SELECT label, count(*) AS both, count(*) FILTER (now <> ok2) AS disagree, count(*) FILTER (now <> ok2) > 0 AND label <> 'incomplete' AS unexpected
FROM arms WHERE now IS NOT NULL AND ok2 IS NOT NULL GROUP BY label""", "arms"))
def _(spark, d):
    return repairs.grader_disagreement(arms(spark, d), "label", "now", "ok2")
