"""Queries for the audit of labels and the retirement of invalid ones."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trajspark.operators import label_audit
from trajspark.plans.base import cte, sql, table
from trajspark.plans.registry import query
from trajspark.sources import sinks

def k():
    return F.col("conv_id")


cte("lsteps", (), """
  SELECT conv_id, turn AS t, role = 'user' AND conv_id % 12 <> 6 AS called, turn = 0 AND (conv_id % 5 = 0 OR conv_id % 10 = 3) AS lp,
    turn = 3 AND conv_id % 16 = 1 AS err, turn = 0 AND conv_id % 13 <> 0 AS task,
    CASE WHEN role <> 'user' OR conv_id % 12 IN (6, 5) THEN '' WHEN conv_id % 3 = 0 THEN text || ' 429 Too Many Requests'
      WHEN conv_id % 3 = 1 THEN '{"a": ' ELSE text || ' $12' END AS r FROM conversations""")
cte("lentries", (), """
  SELECT conv_id + 1000000 * g.m AS conv_id, CASE conv_id % 8 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'tool_cascade' WHEN 2 THEN 'goal_drift'
      WHEN 3 THEN 'context_corruption' WHEN 4 THEN 'malformed_json' END AS failure_class,
    CASE WHEN conv_id % 9 <> 8 AND conv_id % 8 < 5 THEN 1 END AS tau, count(*) + (conv_id % 11 = 0)::INTEGER AS listed, conv_id % 5 = 0 AS flag,
    CASE WHEN conv_id % 7 <> 0 THEN conv_id % 3 <> 0 END AS success, conv_id % 24 = 2 AS bound
  FROM conversations, (VALUES (0), (1)) g(m) WHERE m = 0 OR conv_id % 20 = 0 GROUP BY conv_id, m""")
cte("lseen", ("lsteps", "lentries"), r"""
  SELECT conv_id, count(*) AS n, bool_or(lp) AS lp, bool_or(called) AS ev, bool_or(task) AS task, bool_or(t >= tau AND err) AS err,
    count(*) FILTER (t >= tau AND r <> '') AS res, bool_or(t >= tau AND CASE failure_class
      WHEN 'rate_limit' THEN contains(r, '429 Too Many Requests') WHEN 'goal_drift' THEN contains(r, '[SYSTEM UPDATE:')
      WHEN 'tool_cascade' THEN contains(r, '429 Too Many Requests') OR r = '{"a": ' WHEN 'malformed_json' THEN r = '{"a": '
      WHEN 'context_corruption' THEN regexp_matches(r, '\$\d{1,3}\s*$') END) AS shown
  FROM lsteps JOIN lentries USING (conv_id) GROUP BY conv_id""")
cte("laudit", ("lseen", "lentries"), """
  SELECT conv_id, failure_class, tau, coalesce(n, 0)::INTEGER AS n_steps, verdict, CASE WHEN n IS NULL THEN ['missing_trace_file'] ELSE list_filter([
    CASE WHEN listed <> n THEN 'manifest_T_mismatch' END, CASE WHEN flag <> lp THEN 'logprob_flag_mismatch' END,
    CASE WHEN failure_class IS NOT NULL AND tau IS NULL THEN 'labelled_without_tau' END, CASE WHEN tau >= n - 1 THEN 'no_post_onset_steps' END,
    CASE WHEN verdict <> 'confirmed' THEN verdict || '_positive' END, CASE WHEN failure_class IS NULL AND NOT success THEN 'unsuccessful_healthy' END,
    CASE WHEN NOT ev THEN 'legacy_text_only_telemetry' END, CASE WHEN NOT task THEN 'no_task_recorded' END], lambda x: x IS NOT NULL) END AS defects
  FROM (SELECT *, CASE WHEN failure_class IS NOT NULL AND tau < n - 1 THEN CASE WHEN bound OR coalesce(shown, false) OR coalesce(err, false) THEN 'confirmed'
      WHEN res = 0 THEN 'unverifiable' ELSE 'no_op' END END AS verdict FROM lentries LEFT JOIN lseen USING (conv_id))""")
BLOCKS = "list_filter(defects, lambda x: x IN (" + ", ".join(f"'{b}'" for b in label_audit.BLOCKING) + "))"


def listed(spark, d):
    """Conversations as listed episodes; every 20th is listed once more without steps."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.sha2(F.min_by("text", "turn"), 256).alias("digest"))
    e = c.select(
        "conv_id", F.when(k() % 8 == 0, "rate_limit").when(k() % 8 == 1, "tool_cascade").when(k() % 8 == 2, "goal_drift")
        .when(k() % 8 == 3, "context_corruption").when(k() % 8 == 4, "malformed_json").alias("failure_class"),
        F.when((k() % 9 != 8) & (k() % 8 < 5), 1).alias("tau"), (F.col("n") + (k() % 11 == 0).cast("int")).cast("int").alias("T"),
        (k() % 5 == 0).alias("has_logprobs"), F.when(k() % 7 != 0, k() % 3 != 0).alias("success"),
        F.struct((k() % 8 == 2).cast("int").alias("applied_count")).alias("injection"),
        F.when(k() % 24 == 2, F.col("digest")).otherwise("stale").alias("trace_sha256"))
    twice = e.withColumn("_m", F.explode(F.when(k() % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return twice.withColumn("conv_id", k() + F.col("_m") * 1000000).drop("_m"), c.select("conv_id", "digest")


def steps(spark, d):
    c, user = table(spark, d, "conversations"), F.col("role") == "user"
    r = F.when(~user | (k() % 12).isin(6, 5), "").when(k() % 3 == 0, F.concat("text", F.lit(" 429 Too Many Requests"))) \
        .when(k() % 3 == 1, '{"a": ').otherwise(F.concat("text", F.lit(" $12")))
    calls = F.filter(F.array(F.struct(r.alias("result"))), lambda x: user & (k() % 12 != 6))
    lp = (F.col("turn") == 0) & ((k() % 5 == 0) | (k() % 10 == 3))
    return c.select("conv_id", F.col("turn").alias("t"), F.when(lp, F.array(F.lit(-0.1))).alias("token_logprobs"),
                    ((F.col("turn") == 3) & (k() % 16 == 1)).alias("error"), F.when((F.col("turn") == 0) & (k() % 13 != 0), "do it").alias("task"),
                    calls.alias("tool_events"), calls.alias("calls"))


def audited(spark, d):
    e, digests = listed(spark, d)
    return label_audit.audit_labels(e, steps(spark, d), ["conv_id"], digests=digests)


@query("label_audit", sql(f"""
SELECT conv_id, failure_class, tau, n_steps, verdict, array_to_string(defects, ',') AS defects, array_to_string({BLOCKS}, ',') AS blocking FROM laudit""", "laudit"))
def _(spark, d):
    """Every defect of every listed conversation, and those that make its label unusable."""
    return audited(spark, d).withColumns({c: F.array_join(c, ",") for c in ("defects", "blocking")})


@query("defect_counts", sql(f"""
SELECT defect, count(*) AS n, any_value({BLOCKS.replace('defects', '[defect]')}) <> [] AS blocks FROM (SELECT unnest(defects) AS defect FROM laudit) GROUP BY defect""", "laudit"))
def _(spark, d):
    return label_audit.defect_counts(audited(spark, d), [])


@query("retire_labels", sql(f"""
SELECT conv_id, CASE WHEN len(b) > 0 THEN 'rejected' ELSE 'accepted' END AS status,
  CASE WHEN len(b) > 0 THEN 'retroactive gate: ' || array_to_string(list_sort(b), ', ') END AS reason FROM (SELECT conv_id, {BLOCKS} AS b FROM laudit)""", "laudit"))
def _(spark, d):
    """Labels that fail the audit leave the accepted table for the rejected one, in one commit."""
    path = f"{sinks.shared_dir(spark).rstrip('/')}/traj-{uuid.uuid4().hex}/labels"
    e, _ = listed(spark, d)
    label_audit.create_labels(e, path)
    label_audit.retire(spark, path, audited(spark, d), ["conv_id"])
    kept = label_audit.accepted(spark, path).select("conv_id", F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("reason"))
    moved = label_audit.rejected(spark, path)
    return kept if moved is None else kept.unionByName(moved.select("conv_id", F.lit("rejected").alias("status"), "reason"))
