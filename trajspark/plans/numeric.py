"""Queries over numeric steps: views, fits, recurrences, per-step features."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark import schema
from trajspark.functions import hashing
from trajspark.operators import alarms, fit, ordered, ranks, validate
from trajspark.operators.joins import one_row
from trajspark.plans import base
from trajspark.plans.base import U, cte, sql, table
from trajspark.plans.registry import query

R = lambda c, n=6: F.round(c, n)


@query("episodes_from_events", sql("""
SELECT user_id, t, event_id, event_type, value FROM steps""", "steps"))
def _(spark, d):
    return ordered.positions(
        table(spark, d, "events"), U, ["ts", "event_id"], ordered.day_bucket("ts")
    ).select("user_id", "t", "event_id", "event_type", "value")


@query("standardize", """
SELECT event_type, round(avg(value), 6) AS mean,
       round(CASE WHEN stddev_pop(value) < 1e-9 THEN 1.0 ELSE greatest(stddev_pop(value), 1e-3) END, 6) AS std
FROM events GROUP BY event_type""")
def _(spark, d):
    return fit.standardizer(table(spark, d, "events"), ["event_type"], "value").select(
        "event_type", R("mean").alias("mean"), R("std").alias("std"))


@query("safe_scale", """
SELECT user_id, event_type, round(CASE WHEN s < 1e-9 THEN 1.0 ELSE s END, 6) AS scale
FROM (SELECT user_id, event_type, stddev_pop(value) AS s FROM events GROUP BY ALL)""")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(
        F.stddev_pop("value").alias("s")).select(
        "user_id", "event_type", R(fit.safe_scale(F.col("s"))).alias("scale"))


@query("robust_iqr", """
SELECT event_type, round(median(value), 6) AS loc,
  round(CASE WHEN (quantile_cont(value, .75) - quantile_cont(value, .25)) / 1.349 < 1e-9 THEN 1.0
        ELSE (quantile_cont(value, .75) - quantile_cont(value, .25)) / 1.349 END, 6) AS scale
FROM events GROUP BY event_type""")
def _(spark, d):
    return fit.robust_iqr(table(spark, d, "events"), ["event_type"], "value").select(
        "event_type", R("loc").alias("loc"), R("scale").alias("scale"))


@query("robust_mad", """
SELECT event_type, round(m, 6) AS loc,
  round(CASE WHEN s < 1e-9 THEN 1.0 ELSE s END, 6) AS scale FROM (
  SELECT event_type, any_value(m) AS m,
    CASE WHEN 1.4826 * median(abs(value - m)) < 1e-9 THEN stddev_pop(value)
         ELSE 1.4826 * median(abs(value - m)) END AS s
  FROM (SELECT *, median(value) OVER (PARTITION BY event_type) AS m FROM events)
  GROUP BY event_type)""")
def _(spark, d):
    return fit.robust_mad(table(spark, d, "events"), ["event_type"], "value").select(
        "event_type", R("loc").alias("loc"), R("scale").alias("scale"))


@query("split_episodes", sql("""
SELECT user_id, n_steps, is_healthy, failure_class, tau, dataset, split FROM episodes""", "episodes"))
def _(spark, d):
    return base.episodes(spark, d)


@query("fit_held_split", sql("""
SELECT user_id, CASE WHEN row_number() OVER (ORDER BY u) - 1
    < greatest(round_even(0.85 * count(*) OVER (), 0), 1) THEN 'fit' ELSE 'held' END AS part
FROM (SELECT user_id, ('0x' || substr(sha256('held:' || user_id), 1, 13))::BIGINT / 4503599627370496.0 AS u
      FROM episodes WHERE split = 'train')""", "episodes"))
def _(spark, d):
    tr = base.episodes(spark, d).filter("split = 'train'").select("user_id")
    return fit.fit_held_split(tr, "user_id", "held")


@query("stratified_folds", sql("""
SELECT user_id, failure_class, ((row_number() OVER (PARTITION BY failure_class ORDER BY u) - 1) % 2)::INTEGER AS fold
FROM (SELECT user_id, failure_class,
        ('0x' || substr(sha256('folds:' || user_id), 1, 13))::BIGINT / 4503599627370496.0 AS u
      FROM episodes WHERE NOT is_healthy)""", "episodes"))
def _(spark, d):
    inj = base.episodes(spark, d).filter(~F.col("is_healthy")).select("user_id", "failure_class")
    return fit.stratified_two_fold(inj, "user_id", "failure_class", "folds")


@query("fold_of_id", """
SELECT doc_id, (('0x' || substr(sha256('s1:' || doc_id), 1, 16))::UBIGINT % 5)::INTEGER AS fold
FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", hashing.fold_of(F.col("doc_id"), 5, "s1").alias("fold"))


@query("uniform_draw", """
SELECT event_id, round(('0x' || substr(sha256('7:' || user_id || ':' || event_id), 1, 13))::BIGINT
       / 4503599627370496.0, 9) AS u FROM events""")
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id", R(hashing.uniform(7, F.col("user_id"), F.col("event_id")), 9).alias("u"))


@query("cusum", sql("""
SELECT user_id, t, round(s - least(0.0, min(s) OVER (PARTITION BY user_id ORDER BY t)), 6) AS c
FROM (SELECT user_id, t, sum(value - 40.0) OVER (PARTITION BY user_id ORDER BY t) AS s FROM steps)""", "steps"))
def _(spark, d):
    return ordered.cusum(base.steps(spark, d).select("user_id", "t", "value"),
                         U, "t", "value", "c", 40.0).select("user_id", "t", R("c").alias("c"))


EWMA_SQL = """
WITH RECURSIVE s AS (SELECT user_id, value / 7.0 AS value,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events),
r(user_id, t, y) AS (
  SELECT user_id, t, {start} FROM s WHERE t = 0
  UNION ALL
  SELECT s.user_id, s.t, {a} * s.value + (1 - {a}) * r.y FROM r JOIN s ON s.user_id = r.user_id AND s.t = r.t + 1)
SELECT user_id, t::INTEGER AS t, round(y, 6) AS y FROM r"""


@query("ewma", EWMA_SQL.format(start="0.4 * value", a="0.4"))
def _(spark, d):
    return ordered.ewma(base.steps(spark, d).select("user_id", "t", (F.col("value") / 7.0).alias("v")),
                        U, "t", "v", "y", 0.4).select("user_id", "t", R("y").alias("y"))


@query("ewma_first_value", EWMA_SQL.format(start="value", a="0.3"))
def _(spark, d):
    return ordered.ewma(base.steps(spark, d).select("user_id", "t", (F.col("value") / 7.0).alias("v")),
                        U, "t", "v", "y", 0.3, True).select("user_id", "t", R("y").alias("y"))


@query("rolling_surprisal", sql("""
SELECT user_id, t, round(score, 6) AS score FROM scores WHERE monitor = 'ewma'""", "scores"))
def _(spark, d):
    """EWMA of the two-sided z of one channel, healthy-train reference."""
    s = base.steps(spark, d).select("user_id", "t", "value")
    train = base.episodes(spark, d).filter("split = 'train'").select("user_id")
    ref = s.join(train, "user_id", "left_semi").agg(
        F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    az = s.crossJoin(one_row(ref)).withColumn(
        "az", F.abs((F.col("value") - F.col("mu")) / fit.floored_scale(F.col("sd"))))
    return ordered.ewma(az, U, "t", "az", "score", 0.3, True).select(
        "user_id", "t", R("score").alias("score"))


@query("delta_lag", sql("""
SELECT user_id, t, round(coalesce(value - lag(value) OVER w, 0), 6) AS dv,
  round(coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w, 0) / 1e6, 6) AS gap_s
FROM steps WINDOW w AS (PARTITION BY user_id ORDER BY t)""", "steps"))
def _(spark, d):
    s = base.steps(spark, d).select("user_id", "t", "value", ordered.micros("ts").alias("us"))
    j = ordered.lag(s, U, "t", {"pv": "value", "pus": "us"})
    return j.select("user_id", "t",
                    R(F.coalesce(F.col("value") - F.col("pv"), F.lit(0.0))).alias("dv"),
                    R(F.coalesce(F.col("us") - F.col("pus"), F.lit(0)) / 1e6).alias("gap_s"))


@query("running_max", sql("""
SELECT user_id, t, max(value) OVER (PARTITION BY user_id ORDER BY t) AS run_max FROM steps""", "steps"))
def _(spark, d):
    return ordered.running(base.steps(spark, d).select("user_id", "t", "value"), U, "t",
                           {"run_max": ordered.Run("max", "value")}).select("user_id", "t", "run_max")


# ------------------------------------------------- tool calls: a step is a day
cte("calls", (), """
  SELECT user_id, (epoch_us(ts) // 86400000000)::INTEGER AS day, event_id, event_type AS name,
         props AS args, event_type = 'error' AS is_error, value / 100.0 AS latency_s FROM events""")


def calls(spark, d):
    """Tool calls per (user, day step)."""
    return table(spark, d, "events").select(
        "user_id", ordered.day_bucket("ts").alias("day"), "event_id",
        F.col("event_type").alias("name"), F.col("props").alias("args"),
        (F.col("event_type") == "error").alias("is_error"),
        (F.col("value") / 100.0).alias("latency_s"))


@query("tool_step_features", sql("""
SELECT user_id, day, round(1 - avg(is_error::INTEGER), 6) AS tool_success, count(*) AS n_calls,
  round(CASE WHEN count(CASE WHEN name <> 'view' THEN 1 END) > 0
    THEN ln(greatest(avg(CASE WHEN name <> 'view' THEN latency_s END), 1e-3))
    ELSE ln(86400.0 / count(*)) END, 6) AS tool_latency
FROM calls GROUP BY user_id, day""", "calls"))
def _(spark, d):
    from trajspark.operators import features
    c = calls(spark, d).withColumn(
        "latency_s", F.when(F.col("name") != "view", F.col("latency_s")))
    f = features.tool_step(c, ["user_id", "day"], F.lit(86400.0))
    return f.select("user_id", "day", R("tool_success").alias("tool_success"), "n_calls",
                    R("tool_latency").alias("tool_latency"))


@query("retry_count", sql("""
SELECT user_id, day, sum((day > first_day)::INTEGER)::BIGINT AS retries FROM (
  SELECT user_id, day, min(day) OVER (PARTITION BY user_id, name, args) AS first_day FROM calls)
GROUP BY user_id, day""", "calls"))
def _(spark, d):
    from trajspark.operators import features
    c = calls(spark, d).withColumn("args_key", features.canonical_json("args"))
    return features.retry_count(c, ["user_id"], "day")


@query("stuck_flag", sql("""
SELECT user_id, t, (t >= 2 AND (min((event_type = 'error')::INTEGER) OVER w = 1
   OR (event_type = lag(event_type, 1) OVER o AND event_type = lag(event_type, 2) OVER o))) AS stuck
FROM steps WINDOW o AS (PARTITION BY user_id ORDER BY t),
  w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""", "steps"))
def _(spark, d):
    from trajspark.operators import features
    s = base.steps(spark, d).select("user_id", "t", "event_type")
    return features.stuck(s, U, "t", F.col("event_type") == "error", F.col("event_type"), 3) \
        .select("user_id", "t", "stuck")


@query("healthy_band", sql("""
SELECT t, round(quantile_cont(value, .1), 6) AS p10, round(median(value), 6) AS p50,
  round(quantile_cont(value, .9), 6) AS p90, count(*) AS n
FROM steps JOIN episodes USING (user_id) WHERE is_healthy
  AND t < (SELECT coalesce(min(t), 1000000) FROM (
     SELECT t FROM steps JOIN episodes USING (user_id) WHERE is_healthy GROUP BY t HAVING count(*) < 60))
GROUP BY t""", "steps", "episodes"))
def _(spark, d):
    from trajspark.operators import features
    s = base.steps(spark, d).select("user_id", "t", "value").join(
        base.episodes(spark, d).filter("is_healthy").select("user_id"), "user_id", "left_semi")
    b = features.healthy_band(s, "t", "value", 60)
    return b.select("t", *[R(c).alias(c) for c in ("p10", "p50", "p90")], "n")


@query("surprisal_features", sql("""
SELECT user_id, blk, round(avg(s), 6) AS mean, round(max(s), 6) AS peak,
  round(CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(s, i) END, 6) AS slope, round(avg((s > 2.5)::INTEGER), 6) AS high_share
FROM (SELECT user_id, (t // 16)::INTEGER AS blk, (t % 16) AS i, value / 37.0 AS s FROM steps)
GROUP BY user_id, blk""", "steps"))
def _(spark, d):
    from trajspark.operators import features
    blocks = base.steps(spark, d).groupBy(
        "user_id", F.floor(F.col("t") / 16).cast("int").alias("blk")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("t", (-F.col("value") / 37.0).alias("lp")))),
                    lambda x: x["lp"]).alias("lps"))
    f = features.surprisal(F.col("lps"))
    return blocks.select("user_id", "blk", *[R(f[k]).alias(k) for k in ("mean", "peak", "slope", "high_share")])


@query("step_metadata", sql("""
SELECT event_id, round(ln(greatest(coalesce(gap, 1.0), 1e-3)), 6) AS log_latency,
  round(ln(greatest(length(props), 1)), 6) AS log_outlen, (event_type = 'error')::INTEGER::DOUBLE AS err,
  CASE event_type WHEN 'click' THEN 'tool_call' ELSE 'tool_call' END AS action
FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY t)) / 1e6 AS gap FROM steps)""", "steps"))
def _(spark, d):
    s = base.steps(spark, d).withColumn("us", ordered.micros("ts"))
    j = ordered.lag(s, U, "t", {"pus": "us"})
    lat, _ = validate.latency_of((F.col("us") - F.col("pus")) / 1e6)
    act, _ = validate.action_of(F.col("event_type"))
    return j.select("event_id", R(F.log(lat)).alias("log_latency"),
                    R(F.log(F.greatest(F.length("props"), F.lit(1)).cast("double"))).alias("log_outlen"),
                    (F.col("event_type") == "error").cast("double").alias("err"), act.alias("action"))


@query("canonical_args", """
SELECT event_id, '{"k":' || regexp_extract(props, '(\\d+)', 1) || '}' AS args_key FROM events""")
def _(spark, d):
    from trajspark.operators import features
    return table(spark, d, "events").select("event_id", features.canonical_json("props").alias("args_key"))


@query("session_deltas", sql("""
SELECT user_id, t, round(CASE WHEN prev IS NULL THEN 0 ELSE abs(z - prev) END, 6) AS jump
FROM (SELECT user_id, t, z, lag(z) OVER (PARTITION BY user_id ORDER BY t) AS prev FROM z)""", "z"))
def _(spark, d):
    """Jump size ||z_t - z_(t-1)|| / sqrt(D) on the standardised step."""
    s = base.steps(spark, d).select("user_id", "t", "value")
    train = base.episodes(spark, d).filter("split = 'train'").select("user_id")
    ref = s.join(train, "user_id", "left_semi").agg(
        F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    z = s.crossJoin(one_row(ref)).select("user_id", "t", (
        (F.col("value") - F.col("mu")) / fit.floored_scale(F.col("sd"))).alias("z"))
    j = ordered.lag(z, U, "t", {"p": "z"})
    return j.select("user_id", "t", R(F.coalesce(F.abs(F.col("z") - F.col("p")), F.lit(0.0))).alias("jump"))


# -------------------------------------------------------------- validation
@query("min_length_filter", sql("""
SELECT user_id, n_steps FROM episodes WHERE n_steps >= 60""", "episodes"))
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_steps")).filter("n_steps >= 60")


cte("attempts", ("steps",), """
  SELECT user_id, count(*)::INTEGER AS n_steps,
    CASE WHEN user_id % 3 = 0 THEN 'inj' END AS injector,
    CASE WHEN user_id % 3 = 0 THEN sum((event_type = 'error' AND value > 100)::INTEGER)::INTEGER END AS applied_count,
    CASE WHEN user_id % 3 = 0 THEN min(CASE WHEN event_type = 'error' AND value > 100 THEN t END) END AS first_applied_t,
    CASE WHEN user_id % 7 = 0 THEN NULL ELSE sum((event_type = 'purchase')::INTEGER) >= 12 END AS success
  FROM steps GROUP BY user_id""")


def attempts(spark, d):
    hit = (F.col("event_type") == "error") & (F.col("value") > 100)
    inj = F.col("user_id") % 3 == 0
    return base.steps(spark, d).groupBy("user_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_steps"),
        F.sum(hit.cast("int")).cast("int").alias("a"), F.min(F.when(hit, F.col("t"))).alias("f"),
        F.sum((F.col("event_type") == "purchase").cast("int")).alias("p")).select(
        "user_id", "n_steps", F.when(inj, "inj").alias("injector"),
        F.when(inj, F.col("a")).alias("applied_count"),
        F.when(inj, F.col("f")).alias("first_applied_t"),
        F.when(F.col("user_id") % 7 != 0, F.col("p") >= 12).alias("success"))


@query("acceptance_gate", sql("""
SELECT user_id, CASE WHEN n_steps < 55 THEN 'too short'
  WHEN injector IS NOT NULL AND coalesce(applied_count, 0) = 0 THEN 'never applied'
  WHEN injector IS NOT NULL AND first_applied_t >= n_steps - 1 THEN 'no following step'
  WHEN injector IS NULL AND success = false THEN 'not successful'
  WHEN injector IS NULL AND success IS NULL THEN 'unverified' ELSE 'accepted' END AS verdict,
  CASE WHEN coalesce(applied_count, 0) > 0 THEN first_applied_t END AS tau
FROM attempts""", "attempts"))
def _(spark, d):
    return attempts(spark, d).select(
        "user_id", validate.acceptance(55).alias("verdict"),
        F.when(F.coalesce("applied_count", F.lit(0)) > 0, F.col("first_applied_t")).alias("tau"))


@query("admission_check", sql("""
SELECT user_id, coalesce(applied_count > 0 AND first_applied_t > 0 AND first_applied_t < n_steps - 1, false) AS admitted
FROM attempts WHERE injector IS NOT NULL""", "attempts"))
def _(spark, d):
    return attempts(spark, d).filter("injector IS NOT NULL").select(
        "user_id", F.coalesce(validate.admitted(), F.lit(False)).alias("admitted"))


@query("episode_invariants", sql("""
SELECT user_id, CASE WHEN wbad AND NOT cbad THEN 'width' WHEN wbad THEN 'width,class'
   WHEN cbad THEN 'class' ELSE '' END AS broken FROM (
 SELECT user_id, (user_id % 11 = 0) AS wbad, (NOT is_healthy) AS cbad FROM episodes)""", "episodes"))
def _(spark, d):
    e = base.episodes(spark, d).withColumns({
        "width": F.when(F.col("user_id") % 11 == 0, 50).otherwise(51),
        "t_fail": F.when(~F.col("is_healthy"), F.col("n_steps") - 1)})
    return e.select("user_id", F.array_join(validate.invariant_violations(), ",").alias("broken"))


@query("validate_steps", sql("""
SELECT user_id, min(t) AS step, arg_min(reason, t) AS reason FROM (
  SELECT user_id, t, CASE WHEN isnan(ln_lat) OR isinf(ln_lat) OR gap < 0 THEN 'latency not finite and non-negative'
     WHEN tok < 0 THEN 'output_tokens negative' END AS reason
  FROM (SELECT user_id, t, gap, 0.0::DOUBLE AS ln_lat, tok FROM (
    SELECT user_id, t, value - 0.02 AS gap, (regexp_extract(props, '(\\d+)', 1))::INTEGER - 1 AS tok FROM steps)))
WHERE reason IS NOT NULL GROUP BY user_id""", "steps"))
def _(spark, d):
    s = base.steps(spark, d).select(
        "user_id", "t", (F.col("value") - 0.02).cast("string").alias("latency_s"),
        (F.get_json_object("props", "$.k").cast("int") - 1).cast("string").alias("output_tokens"))
    return validate.validate_steps(s, U)[1]


@query("action_map", """
SELECT conv_id, turn, role, CASE turn % 4 WHEN 0 THEN 'plan' WHEN 1 THEN 'synthesis' WHEN 2 THEN 'tool_result' ELSE 'tool_call' END AS action,
  turn % 4 = 3 AS unknown FROM conversations""")
def _(spark, d):
    """Three known words, and the role as an unknown one."""
    k = F.col("turn") % 4
    act, unk = validate.action_of(F.when(k == 0, "think").when(k == 1, "answer").when(k == 2, "observation").otherwise(F.col("role")))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", act.alias("action"), unk.alias("unknown"))


@query("unmapped_actions", """
SELECT lower(event_type) AS action, count(*) AS n FROM events
WHERE lower(event_type) NOT IN ('plan','think','thought','reasoning','reflect','tool_call','act','action',
  'function_call','tool','tool_result','observation','tool_response','function_result','synthesis','final',
  'answer','respond','response') GROUP BY 1""")
def _(spark, d):
    return validate.unmapped_actions(table(spark, d, "events"), "event_type")


@query("latency_floor", sql("""
SELECT user_id, t, greatest(coalesce(lat, 1.0), 1e-3) AS latency_s, coalesce(lat, 1.0) < 0 AS refused
FROM (SELECT user_id, t, CASE WHEN t > 0 THEN round(value - 0.05, 4) END AS lat FROM steps)""", "steps"))
def _(spark, d):
    lat, bad = validate.latency_of(F.when(F.col("t") > 0, R(F.col("value") - 0.05, 4)))
    return base.steps(spark, d).select("user_id", "t", lat.alias("latency_s"), bad.alias("refused"))


@query("channel_choice", """
SELECT source AS dataset, round(avg((lang <> 'fr')::INTEGER), 6) AS logprob_share,
  avg((lang <> 'fr')::INTEGER) >= 0.9 AS use_uncertainty FROM documents GROUP BY source""")
def _(spark, d):
    e = table(spark, d, "documents").select(F.col("source").alias("dataset"), (F.col("lang") != "fr").alias("lp"))
    return validate.use_uncertainty(e, "dataset", "lp").withColumn("logprob_share", R("logprob_share"))


@query("stale_toolset", sql("""
SELECT user_id % 4 AS corpus, bool_or(name NOT IN ('view', 'click', 'purchase', 'error')) AS refused,
  string_agg(DISTINCT CASE WHEN name NOT IN ('view', 'click', 'purchase', 'error') THEN name END, ',') AS stale
FROM calls GROUP BY 1""", "calls"))
def _(spark, d):
    from trajspark.operators import features
    c = calls(spark, d).withColumn("corpus", F.col("user_id") % 4)
    return features.stale_toolset(c, ["corpus"], "name", ["view", "click", "purchase", "error"])


# ------------------------------------------------------------------ alarms
@query("min_calibration_episodes", """
SELECT l_orderkey, l_linenumber, ceil(1.0 / (l_tax + 0.01) - 1.0)::INTEGER AS n_min FROM lineitem""")
def _(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        alarms.min_calibration_episodes(F.col("l_tax") + F.lit(0.01)).alias("n_min"))


@query("first_alarm", sql("""
SELECT monitor, user_id, alarm_step FROM first_hit""", "first_hit"))
def _(spark, d):
    return alarms.first_alarm(base.scores(spark, d), base.thetas(spark, d), ["monitor"], U).select(
        "monitor", "user_id", "alarm_step")


@query("pick_threshold", sql("""
SELECT monitor, n, round(theta, 6) AS theta, n >= 19 AS feasible FROM thetas""", "thetas"))
def _(spark, d):
    return base.thetas(spark, d).select("monitor", "n", R("theta").alias("theta"), "feasible")


@query("pick_threshold_lognormal", sql("""
SELECT monitor, n_positive, round(CASE WHEN n_positive >= 3 AND s > 0 THEN exp(m + s * 1.6448536269514715) ELSE theta END, 6) AS theta
FROM (SELECT monitor, count(CASE WHEN max_score > 0 THEN 1 END) AS n_positive,
   avg(CASE WHEN max_score > 0 THEN ln(max_score) END) AS m, stddev_samp(CASE WHEN max_score > 0 THEN ln(max_score) END) AS s
   FROM maxima WHERE split = 'val' GROUP BY monitor) JOIN thetas USING (monitor)""", "thetas"))
def _(spark, d):
    v = base.maxima(spark, d).filter("split = 'val'")
    return alarms.pick_threshold_lognormal(v, ["monitor"], "max_score").select(
        "monitor", "n_positive", R("theta_lognormal").alias("theta"))


@query("evaluate_alarms", sql("""
SELECT monitor, user_id, outcome, alarm_step, delay, lead_steps, round(saved_frac, 6) AS saved_frac FROM alarms""", "alarms"))
def _(spark, d):
    return base.alarm_rows(spark, d).select(
        "monitor", "user_id", "outcome", "alarm_step", "delay", "lead_steps", R("saved_frac").alias("saved_frac"))


SUMMARY_SQL = """
SELECT {g}, count(*) AS n_episodes,
  round(avg(CASE WHEN is_healthy THEN (outcome = 'false_alarm')::INTEGER END), 6) AS healthy_fa_rate,
  round(avg(CASE WHEN NOT is_healthy THEN (outcome = 'early_alarm')::INTEGER END), 6) AS early_alarm_rate,
  round(avg(CASE WHEN NOT is_healthy THEN (outcome = 'true_alarm')::INTEGER END), 6) AS detection_rate,
  round(avg(saved_frac), 6) AS mean_budget_saved,
  round(avg(CASE WHEN NOT is_healthy THEN coalesce(lead_steps, 0) END), 6) AS mean_lead_all,
  round(avg(CASE WHEN NOT is_healthy THEN coalesce(saved_frac, 0) END), 6) AS mean_budget_saved_all,
  median(delay) AS median_delay, median(lead_steps) AS median_lead
FROM alarms {w} GROUP BY {g}"""
_SUM = ("healthy_fa_rate", "early_alarm_rate", "detection_rate", "mean_budget_saved",
        "mean_lead_all", "mean_budget_saved_all", "median_delay", "median_lead")


def summary(rows, by):
    return alarms.summarize(rows, by).select(*by, "n_episodes", *[R(c).alias(c) for c in _SUM])


@query("alarm_summary", sql(SUMMARY_SQL.format(g="monitor", w=""), "alarms"))
def alarm_summary(spark, d):
    return summary(base.alarm_rows(spark, d), ["monitor"])


@query("alarm_summary_by_class", sql(SUMMARY_SQL.format(g="monitor, failure_class", w="WHERE NOT is_healthy"), "alarms"))
def _(spark, d):
    return summary(base.alarm_rows(spark, d).filter(~F.col("is_healthy")), ["monitor", "failure_class"])
