"""Queries for the deterministic checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.functions import stats
from trajspark.operators import verify
from trajspark.operators.verify import LineItem, TaskSpec
from trajspark.plans import base
from trajspark.plans.base import U, cte, sql, table
from trajspark.plans.numeric import R
from trajspark.plans.registry import query
from trajspark.sources import sinks

SPEC = TaskSpec(
    line_items=(LineItem("purchase", 1, 12), LineItem("view", 2)),
    required_tools=("signup",), required_counts=(("click", 14),), combining_tools=("click",),
    result_contracts=(("purchase", r"\$\d+(\.\d+)?"), ("view", r"\$\d+(\.\d+)?/night")))
ORDER_SPEC = TaskSpec(line_items=(LineItem("line"),))
PICK_SPEC = TaskSpec(line_items=(LineItem("line", 1, 3),))

cte("vcalls", ("steps",), """
  SELECT user_id, t, event_type AS name, props AS args_key, event_type = 'error' AS is_error,
    CASE event_type WHEN 'purchase' THEN CASE WHEN value > 100 THEN 'N/A ' || value ELSE '$' || value END
      WHEN 'view' THEN '$' || value || '/night' WHEN 'signup' THEN 'ok' ELSE value::VARCHAR END AS result, value FROM steps""")


def vcalls(spark, d):
    v = F.col("value").cast("string")
    r = F.when((F.col("event_type") == "purchase") & (F.col("value") > 100), F.concat(F.lit("N/A "), v)) \
        .when(F.col("event_type") == "purchase", F.concat(F.lit("$"), v)) \
        .when(F.col("event_type") == "view", F.concat(F.lit("$"), v, F.lit("/night"))) \
        .when(F.col("event_type") == "signup", F.lit("ok")).otherwise(v)
    return base.steps(spark, d).select(
        "user_id", "t", F.col("event_type").alias("name"), F.col("props").alias("args_key"),
        (F.col("event_type") == "error").alias("is_error"), r.alias("result"), F.lit(True).alias("has_result"))


cte("cov", ("vcalls",), """
  SELECT user_id, coalesce(min(CASE WHEN name = 'click' THEN t END), max(t)) AS step,
    count(DISTINCT CASE WHEN name = 'purchase' THEN args_key END) AS p, count(DISTINCT CASE WHEN name = 'signup' THEN args_key END) AS s,
    count(DISTINCT CASE WHEN name = 'click' THEN args_key END) AS c FROM vcalls GROUP BY user_id""")
cte("coverage", ("cov",), """
  SELECT user_id, step, 'purchase' AS tool, p AS got, 12 AS need FROM cov WHERE p < 12
  UNION ALL SELECT user_id, step, 'signup', s, 1 FROM cov WHERE s < 1
  UNION ALL SELECT user_id, step, 'click', c, 14 FROM cov WHERE c < 14""")
cte("contract", ("vcalls",), r"""
  SELECT user_id, t AS step, name AS tool FROM vcalls WHERE (name = 'purchase' AND NOT regexp_full_match(result, '\$\d+(\.\d+)?'))
    OR (name = 'view' AND NOT regexp_full_match(result, '\$\d+(\.\d+)?/night'))""")


@query("required_coverage", sql("SELECT user_id, step, tool, got, need FROM coverage", "coverage"))
def _(spark, d):
    return verify.required_coverage(vcalls(spark, d), U, "t", SPEC).drop("check")


@query("tool_contract", sql("SELECT user_id, step, tool FROM contract", "contract"))
def _(spark, d):
    return verify.tool_contract(vcalls(spark, d), U, "t", SPEC).drop("check")


cte("olines", (), """
  SELECT l_orderkey AS o, l_linenumber AS t, l_partkey AS part, floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100 + 0.5) / 100 AS price FROM lineitem""")


def order_calls(spark, d):
    p = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) * 100 + 0.5) / 100
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("t"), F.lit("line").alias("name"),
        F.col("l_partkey").cast("string").alias("args_key"), F.lit(False).alias("is_error"),
        F.concat(F.lit("$"), F.format_number(p, 2)).alias("result"), F.lit(True).alias("has_result"), p.alias("price"))


cte("ostated", ("olines",), """
  SELECT o_orderkey AS o, CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN o_totalprice ELSE s END AS stated
  FROM orders LEFT JOIN (SELECT o, sum(price) AS s FROM olines GROUP BY o) l ON l.o = o_orderkey""")


def order_stated(spark, d):
    s = order_calls(spark, d).groupBy("o").agg(F.sum("price").alias("s"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("o"), "o_custkey", "o_totalprice")
    k = F.col("o_custkey") % 4
    return o.join(s, "o", "left").select("o", F.when(k == 1, F.col("o_totalprice")).when(k > 1, F.col("s")).alias("stated"))


@query("total_consistency", sql("""
, dd AS (SELECT o, sum(price) AS rec FROM (SELECT o, part, arg_min(price, struct_pack(t := t, price := price)) AS price FROM olines GROUP BY o, part) GROUP BY o)
SELECT o, round(rec, 2) AS recomputed, round(stated, 2) AS stated, CASE WHEN rec IS NULL THEN 'unverifiable' WHEN stated IS NULL THEN 'no_total'
  WHEN abs(stated - rec) <= greatest(0.01 * greatest(abs(rec), 1.0), 0.5) THEN 'ok' ELSE 'mismatch' END AS verdict
FROM ostated LEFT JOIN dd USING (o)""", "ostated").replace("\n\n,", ",", 1))
def _(spark, d):
    r = verify.total_consistency(order_calls(spark, d), order_stated(spark, d), ["o"], "t", ORDER_SPEC)
    return r.select("o", R("recomputed", 2).alias("recomputed"), R("stated", 2).alias("stated"), "verdict")


@query("candidate_selection", sql("""
, dd AS (SELECT o, part, arg_min(price, struct_pack(t := t, price := price)) AS price FROM olines GROUP BY o, part),
k AS (SELECT o, price, row_number() OVER (PARTITION BY o ORDER BY price, part) AS i, count(*) OVER (PARTITION BY o) AS n FROM dd),
cand AS (SELECT o, sum(price) AS v FROM k WHERE n <= 3 GROUP BY o
  UNION ALL SELECT a.o, a.price + b.price + c.price FROM k a JOIN k b ON a.o = b.o AND a.i < b.i JOIN k c ON c.o = a.o AND b.i < c.i WHERE a.n > 3),
st AS (SELECT o_orderkey AS o, CASE WHEN o_custkey % 2 = 0 THEN o_totalprice ELSE low END AS stated FROM orders JOIN
  (SELECT o, sum(price) AS low FROM k WHERE i <= 3 GROUP BY o) l ON l.o = o_orderkey)
SELECT o, CASE WHEN bool_or(abs(stated - v) <= greatest(0.01 * greatest(abs(v), 1.0), 0.5)) THEN 'matches' ELSE 'mismatch' END AS selection
FROM st JOIN cand USING (o) GROUP BY o""", "olines").replace("\n\n,", ",", 1))
def _(spark, d):
    c = order_calls(spark, d)
    # written once: the lowest three and the selections both read it
    priced = sinks.materialize(verify.priced_calls(c, ["o"], "t", PICK_SPEC).select("o", "name", "price"), "priced_lines")
    # the three lowest distinct lookups of an order, as a stated total
    from pyspark.sql import Window as W
    low = priced.withColumn("i", F.row_number().over(W.partitionBy("o").orderBy("price"))).filter("i <= 3") \
        .groupBy("o").agg(F.sum("price").alias("low"))
    st = table(spark, d, "orders").select(F.col("o_orderkey").alias("o"), "o_custkey", "o_totalprice").join(low, "o").select(
        "o", F.when(F.col("o_custkey") % 2 == 0, F.col("o_totalprice")).otherwise(F.col("low")).alias("stated"))
    return verify.selection(priced, st, ["o"], PICK_SPEC).select("o", "selection")


@query("verify_all", sql("""
, pr AS (SELECT user_id, name, args_key, arg_min(value, t) AS price, arg_min(result, t) AS res FROM vcalls WHERE name IN ('purchase', 'view') GROUP BY ALL),
pp AS (SELECT * FROM pr WHERE res LIKE '$%'),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id, name ORDER BY price) AS i FROM pp),
n AS (SELECT user_id, sum(CASE WHEN name = 'view' THEN 2 * price WHEN i <= 12 THEN price ELSE 0 END) AS rec FROM q GROUP BY user_id),
st AS (SELECT user_id, rec, CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 50000 ELSE rec END AS stated FROM (SELECT DISTINCT user_id FROM vcalls) LEFT JOIN n USING (user_id)),
v AS (SELECT user_id, CASE WHEN rec IS NULL THEN 'unverifiable' WHEN stated IS NULL THEN 'no_total' WHEN user_id % 3 = 2 THEN 'ok' ELSE 'mismatch' END AS verdict FROM st),
f AS (SELECT user_id, 'required_coverage' AS c FROM coverage UNION ALL SELECT user_id, 'tool_contract' FROM contract
  UNION ALL SELECT user_id, 'total_consistency' FROM v WHERE verdict IN ('mismatch', 'no_total')),
g AS (SELECT user_id, count(*) AS n_findings, string_agg(DISTINCT c, ',' ORDER BY c) AS failed_checks FROM f GROUP BY user_id)
SELECT user_id, coalesce(n_findings, 0) > 0 AS failed, verdict <> 'unverifiable' AS checked, coalesce(n_findings, 0) AS n_findings,
  coalesce(failed_checks, '') AS failed_checks FROM v LEFT JOIN g USING (user_id)""", "coverage", "contract").replace("\n\n,", ",", 1))
def _(spark, d):
    """Stated: nothing, 50,000 (above every selection), or the twelve cheapest purchases and all views."""
    c = vcalls(spark, d)
    spec = TaskSpec(line_items=(LineItem("purchase", 1, 12), LineItem("view", 2)), required_tools=SPEC.required_tools,
                    required_counts=SPEC.required_counts, combining_tools=SPEC.combining_tools,
                    result_contracts=SPEC.result_contracts)
    from pyspark.sql import Window as W
    i = F.row_number().over(W.partitionBy("user_id", "name").orderBy("price"))
    low = verify.priced_calls(c, U, "t", spec).withColumn("i", i).groupBy("user_id").agg(F.sum(
        F.when(F.col("name") == "view", 2 * F.col("price")).when(F.col("i") <= 12, F.col("price"))).alias("low"))
    k = F.col("user_id") % 3
    st = c.select("user_id").distinct().join(low, "user_id", "left").select(
        "user_id", F.when(k == 1, F.lit(50000.0)).when(k == 2, F.col("low")).alias("stated"))
    return verify.verify(c, st, U, "t", spec)


cte("assertions", ("olines",), """
  SELECT l.o, l.t, round(CASE l.part % 4 WHEN 0 THEN l.price WHEN 1 THEN 2 * f.p WHEN 2 THEN f.p * 1.08 ELSE f.p + 777.77 END, 2) AS value
  FROM olines l JOIN (SELECT o, arg_min(price, struct_pack(t := t, part := part, price := price)) AS p FROM olines GROUP BY o) f USING (o)""")


def assertions(spark, d):
    c = order_calls(spark, d).select("o", "t", "price", F.col("args_key").cast("long").alias("part"))
    f = c.groupBy("o").agg(F.min_by("price", F.struct("t", "part", "price")).alias("p"))
    k = F.col("part") % 4
    v = F.when(k == 0, F.col("price")).when(k == 1, 2 * F.col("p")).when(k == 2, F.col("p") * 1.08).otherwise(F.col("p") + 777.77)
    return c.join(f, "o").select("o", "t", F.round(v, 2).alias("value"))


@query("numeric_grounding", sql("""
SELECT a.o, a.t, a.value FROM assertions a WHERE NOT EXISTS (SELECT 1 FROM olines r, range(1, 5) k(k), (VALUES (0.0), (0.08), (0.085), (0.10)) x(tax)
  WHERE r.o = a.o AND r.t < a.t AND abs(a.value - round(round(k * r.price, 2) * (1 + tax)::DOUBLE, 2)) <= 0.5)""", "assertions"))
def _(spark, d):
    """Asserted figures not derivable from earlier results (values, multiples, tax)."""
    res = order_calls(spark, d).select("o", "t", F.lit(0).alias("pos"), F.col("price").alias("value"))
    return verify.ungrounded_by(assertions(spark, d), res, ["o"])


@query("numeric_grounding_sums")
def _(spark, d):
    """The same with subset sums of the results."""
    res = order_calls(spark, d).select("o", "t", F.lit(0).alias("pos"), F.col("price").alias("value"))
    left = verify.ungrounded_by(assertions(spark, d), res, ["o"])
    return verify.ungrounded_by_sums(left, res, ["o"])


@query("objective_label", sql("""
, it AS (SELECT o, round(price * 100)::BIGINT AS c, row_number() OVER (PARTITION BY o ORDER BY t, part, price) AS i FROM olines),
f AS (SELECT o, sum(c)::BIGINT AS g, max(CASE WHEN i = 1 THEN c END) AS c1, coalesce(max(CASE WHEN i = 2 THEN c END), 0) AS c2 FROM it GROUP BY o),
w AS (SELECT o, g, c1, o_custkey AS k, CASE o_custkey % 5 WHEN 0 THEN g WHEN 1 THEN c1 + c2 WHEN 2 THEN g + 12345 WHEN 3 THEN g END AS fin,
   CASE o_custkey % 5 WHEN 3 THEN c1 + 98765 ELSE c1 END AS itm FROM f JOIN orders ON o_orderkey = o),
tot AS (SELECT o, c AS v FROM it UNION SELECT o, g FROM f UNION SELECT a.o, a.c + b.c FROM it a JOIN it b ON a.o = b.o AND a.i < b.i),
der AS (SELECT DISTINCT o, round(v * x.r::DOUBLE)::BIGINT AS v FROM tot, (VALUES (1.0), (1.08), (1.085), (1.10)) x(r))
SELECT o, CASE WHEN k % 5 <> 4 AND (o, itm) NOT IN (SELECT o, v FROM der) THEN 'hallucinated' WHEN k % 11 = 0 THEN 'hallucinated' WHEN k % 5 = 4 THEN 'other'
  WHEN abs(fin - g) <= 50 THEN CASE WHEN k % 7 = 0 THEN 'incomplete' ELSE 'healthy' END
  WHEN (o, fin) IN (SELECT o, v FROM der) THEN 'arithmetic_error' ELSE 'hallucinated' END AS label FROM w""", "olines").replace("\n\n,", ",", 1))
def _(spark, d):
    from pyspark.sql import Window as W
    c = order_calls(spark, d).select(
        "o", "t", F.col("args_key").cast("long").alias("part"), verify.cents(F.col("price")).alias("value"))
    i = F.row_number().over(W.partitionBy("o").orderBy("t", "part", "value"))
    f = c.withColumn("i", i).groupBy("o").agg(
        F.sum("value").alias("g"), F.max(F.when(F.col("i") == 1, F.col("value"))).alias("c1"),
        F.coalesce(F.max(F.when(F.col("i") == 2, F.col("value"))), F.lit(0)).alias("c2"))
    o = f.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("k")), "o")
    k = F.col("k") % 5
    fin = F.when(k.isin(0, 3), F.col("g")).when(k == 1, F.col("c1") + F.col("c2")).otherwise(F.col("g") + 12345)
    itm = F.when(k == 3, F.col("c1") + 98765).otherwise(F.col("c1"))
    figs = o.filter(k != 4).select("o", F.inline(F.array(
        F.struct(F.lit(0).alias("ord"), itm.alias("value")), F.struct(F.lit(1).alias("ord"), fin.alias("value")))))
    exp = o.select("o", F.col("g").alias("expected"), (F.col("k") % 11 == 0).alias("contradicted"),
                   (F.col("k") % 7 == 0).alias("work_missing"))
    marks = verify.derivable(figs, c, ["o"])
    return verify.objective_label(figs, exp, marks, ["o"])


@query("check_vs_monitor", sql("""
, fl AS (SELECT e.user_id, coalesce(failure_class, 'healthy') AS label, tau, count(c.step) > 0 AS flagged,
   coalesce(bool_or(c.step >= tau AND c.step <= tau + 1), false) AS near FROM episodes e LEFT JOIN contract c USING (user_id) WHERE split = 'test' GROUP BY ALL),
al AS (SELECT user_id, alarm_step IS NOT NULL AS alarmed FROM alarms WHERE monitor = 'cusum'),
g AS (SELECT label, count(*) AS n, count(*) FILTER (flagged) AS k, count(*) FILTER (near) AS near, count(*) FILTER (alarmed) AS m FROM fl JOIN al USING (user_id) GROUP BY label),
h AS (SELECT n AS hn, k AS hk FROM g WHERE label = 'healthy')
SELECT label, n, k AS check_flagged, near AS within_one_step, m AS monitor_alarmed, round(least(1.0, (SELECT sum(CASE WHEN k + hk - x <= hn THEN exp(
   lgamma(k + hk + 1) - lgamma(x + 1) - lgamma(k + hk - x + 1) + lgamma(n + hn - k - hk + 1) - lgamma(n - x + 1) - lgamma(hn - k - hk + x + 1)
   - (lgamma(n + hn + 1) - lgamma(n + 1) - lgamma(hn + 1))) ELSE 0 END) FROM range(k, least(n, k + hk) + 1) t(x))), 6) AS p_vs_healthy FROM g, h""",
    "episodes", "contract", "alarms").replace("\n\n,", ",", 1))
def _(spark, d):
    from trajspark.operators import studies
    fnd = verify.tool_contract(vcalls(spark, d), U, "t", SPEC)
    e = base.episodes(spark, d).filter("split = 'test'")
    al = base.alarm_rows(spark, d).filter("monitor = 'cusum'").select("user_id", F.col("alarm_step").isNotNull().alias("alarmed"))
    return studies.check_vs_monitor(fnd, e, al, U).withColumn("p_vs_healthy", R("p_vs_healthy"))


cte("cus", ("alarms",), "SELECT user_id, alarm_step, tau, outcome FROM alarms WHERE monitor = 'cusum'")
cte("ckpt", ("cus", "vcalls"), """
  SELECT c.user_id, any_value(alarm_step) AS alarm_step,
    CASE WHEN any_value(alarm_step) IS NULL THEN 0 ELSE coalesce(max(CASE WHEN NOT is_error AND t < alarm_step THEN t END) + 1, 0) END AS k
  FROM cus c JOIN vcalls v USING (user_id) GROUP BY c.user_id""")


def checkpoints(spark, d, limit="alarm_step"):
    a = base.alarm_rows(spark, d).filter("monitor = 'cusum'")
    return verify.checkpoint(vcalls(spark, d), a, U, "t", limit)


@query("checkpoint_asof", sql("""
SELECT user_id, alarm_step AS "limit", k, CASE WHEN alarm_step IS NULL THEN 'not_triggered' WHEN k = 0 THEN 'checkpoint_at_start' ELSE 'normal' END AS outcome FROM ckpt""", "ckpt"))
def _(spark, d):
    return checkpoints(spark, d)


@query("checkpoint_oracle", sql("""
SELECT c.user_id, coalesce(max(CASE WHEN NOT is_error AND t < tau THEN t END) + 1, 0)::INTEGER AS k FROM cus c JOIN vcalls USING (user_id)
WHERE tau IS NOT NULL GROUP BY c.user_id""", "cus", "vcalls"))
def _(spark, d):
    return checkpoints(spark, d, "tau").filter("limit IS NOT NULL").select("user_id", "k")


@query("rollback_rates", sql("""
, o AS (SELECT dataset, CASE WHEN alarm_step IS NULL THEN 'not_triggered' WHEN u < 0.1 THEN 'reconstruction_failed' WHEN u < 0.6 THEN 'recovered'
   WHEN u < 0.9 THEN 'still_wrong' ELSE 'halted' END AS outcome FROM (SELECT c.*, dataset,
   ('0x' || substr(sha256('roll:' || c.user_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM ckpt c JOIN episodes USING (user_id))),
c AS (SELECT dataset, count(*) AS n, count(*) FILTER (outcome = 'not_triggered') AS nt, count(*) FILTER (outcome = 'reconstruction_failed') AS rf,
  count(*) FILTER (outcome = 'recovered') AS rec FROM o GROUP BY dataset)
SELECT dataset, n AS n_selected, round((n - nt) / n, 6) AS trigger_rate, round(CASE WHEN n - nt - rf > 0 THEN rec / (n - nt - rf) END, 6) AS conditional_recovery,
  round(rec / n, 6) AS end_to_end_recovery FROM c""", "ckpt", "episodes").replace("\n\n,", ",", 1))
def _(spark, d):
    from trajspark.functions.hashing import uniform
    u = uniform("roll", F.col("user_id"))
    o = checkpoints(spark, d).join(base.episodes(spark, d).select("user_id", "dataset"), "user_id").withColumn(
        "outcome", F.when(F.col("outcome") == "not_triggered", "not_triggered").when(u < 0.1, "reconstruction_failed")
        .when(u < 0.6, "recovered").when(u < 0.9, "still_wrong").otherwise("halted"))
    r = verify.rollback_rates(o, ["dataset"])
    return r.select("dataset", "n_selected", *[R(c).alias(c) for c in ("trigger_rate", "conditional_recovery", "end_to_end_recovery")])


@query("task_success", sql("""
SELECT user_id, CASE WHEN user_id % 13 = 0 THEN NULL ELSE bool_or(name = 'purchase' AND NOT is_error) AND bool_or(name = 'signup' AND NOT is_error)
  AND arg_max(value, t) > 20 END AS success FROM vcalls GROUP BY user_id""", "vcalls"))
def _(spark, d):
    acc = base.steps(spark, d).groupBy("user_id").agg(F.max_by("value", "t").alias("v")).select(
        "user_id", F.when(F.col("user_id") % 13 != 0, F.col("v") > 20).alias("accepted"))
    return verify.task_success(vcalls(spark, d), U, ["purchase", "signup"], acc)


@query("real_tool_runs", sql("""
SELECT user_id, bool_or(name = 'view' OR (name = 'click' AND (source IN ('live_external', 'live_local', 'cassette_replay')
   OR (source IS NULL AND value > 150)))) AS used_real FROM (SELECT *, CASE user_id % 3 WHEN 0 THEN 'mock' WHEN 1 THEN 'live_local' END AS source
   FROM vcalls WHERE name <> 'view' OR user_id % 5 = 0) GROUP BY user_id""", "vcalls"))
def _(spark, d):
    """One tool name is shared with a mock; its source decides, else its content."""
    c = base.steps(spark, d).withColumns({
        "name": F.when((F.col("event_type") == "view") & (F.col("user_id") % 5 != 0), "other").otherwise(F.col("event_type")),
        "source": F.when(F.col("user_id") % 3 == 0, "mock").when(F.col("user_id") % 3 == 1, "live_local"),
        "content_is_real": F.col("value") > 150})
    from trajspark.operators import studies
    return studies.used_real_tools(c, U, ["view", "click"], "click")
