"""Queries for assembled step vectors, attribution and noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.functions import vector
from trajspark.operators import grounding, signal
from trajspark.plans import base
from trajspark.plans.base import U, sql, table
from trajspark.plans.numeric import R
from trajspark.plans.registry import query
from trajspark.sources import imports, sinks


def logged_steps(spark, d):
    """Assistant turns as logged steps: the next user turn is the result of a call that asks for the turn's words.

    Every third conversation has its calls written in the text, every fifth step's result is a JSON text.
    """
    c = table(spark, d, "conversations")
    s = imports.positional_steps(c, ["conv_id"], "turn", agent_role="assistant", environment_role="user")
    k = F.col("conv_id") % 3
    result = F.when(F.col("t") % 5 == 4, F.concat(F.lit('{"note": "'), F.regexp_replace("result", r'[\\"\x00-\x1f]', " "),
                                                  F.when(k == 1, '"}').otherwise('"'))).otherwise(F.col("result"))
    event = F.struct(
        F.lit("e").alias("id"), F.lit("lookup").alias("name"), F.create_map(F.lit("q"), F.col("text")).alias("args"),
        result.alias("result"), F.length("result").alias("result_chars"), F.lit(False).alias("result_truncated"),
        F.col("is_error"), F.lit(0.5).alias("latency_s"), F.lit("mock").alias("source"))
    written = F.concat("text", F.lit(' [lookup({"q": 1}) -> '), F.regexp_replace("result", r"[\[\]]", " "), F.lit("]"))
    return s.select(
        "conv_id", "t", F.when((k == 0) & F.col("has_result"), written).otherwise(F.col("text")).alias("text"),
        F.lit(None).cast("array<double>").alias("token_logprobs"), F.lit(False).alias("logprobs_available"), "action",
        (F.col("t") * 0.25 + 0.5).alias("latency_s"), "output_tokens", F.col("is_error").alias("error"),
        F.lit(None).cast("string").alias("task"), F.lit(5).alias("schema"),
        F.when(k != 0, F.filter(F.array(event), lambda e: F.col("has_result"))).alias("tool_events"))


def logged_once(spark, d):
    """Logged steps, written once."""
    done = sinks.known(spark, "logged_steps", d)
    return sinks.materialize(logged_steps(spark, d), "logged_steps", d) if done is None else done


def logged_calls(spark, d):
    """Logged steps with their calls, reasoning and tool columns, written once."""
    done = sinks.known(spark, "logged_calls", d)
    if done is None:
        done = sinks.materialize(signal.from_log(logged_once(spark, d), ["conv_id"], "t"), "logged_calls", d)
    return done


def step_signals_whole(spark, d):
    """60-wide vectors of all logged steps, written once."""
    done = sinks.known(spark, "step_signals", d)
    if done is None:
        s = signal.signals(logged_calls(spark, d), ["conv_id"], "t", grounded=True)
        done = sinks.materialize(s.select("conv_id", "t", "e", "u", "m", "x", "g"), "step_signals", d)
    return done


@query("step_signals")
def _(spark, d):
    """60-wide vectors from logged steps: calls, reasoning, tool columns and the content channel."""
    s = signal.signals(logged_calls(spark, d), ["conv_id"], "t", grounded=True)
    width = sum((F.size(c) for c in "umxg"), F.size("e"))
    return s.select("conv_id", "t", width.alias("width"), R(vector.norm(F.col("e"))).alias("e_norm"),
                    F.col("m")[5].alias("log_tokens"), R(F.col("x")[0]).alias("drift"), R(F.col("x")[7]).alias("consistency"),
                    R(F.col("x")[4]).alias("tool_latency"), F.col("x")[6].alias("n_calls"),
                    *[R(F.col("g")[i]).alias(f"g_{n}") for i, n in enumerate(grounding.DIMS)])


@query("grounding_channel")
def _(spark, d):
    """The nine content dims of every logged step."""
    g = grounding.grounding_channel(logged_calls(spark, d), ["conv_id"], "t")
    return g.select("conv_id", "t", *[R(F.col("g")[i]).alias(n) for i, n in enumerate(grounding.DIMS)])


@query("attribution", sql("""
, r AS (SELECT user_id, t, sum(z * z) OVER w AS a, sum(az) OVER w AS b FROM z WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, t, CASE WHEN a > b THEN 'square' WHEN a = b THEN 'square' ELSE 'absolute' END AS top_dim, round(greatest(a, b) / (a + b), 6) AS top_share FROM r""", "z").replace("\n\n,", ",", 1))
def _(spark, d):
    from trajspark.plans.stream_queries import z_steps
    z = z_steps(spark, d).select("user_id", "t", (F.col("z") * F.col("z")).alias("square"), F.abs("z").alias("absolute"))
    a = signal.attribution(z, U, "t", ["square", "absolute"])
    return a.select("user_id", "t", F.get("shares", F.lit(0))["dim"].alias("top_dim"),
                    R(F.get("shares", F.lit(0))["share"]).alias("top_share"))


N01 = "(('0x' || substr(sha256('noise{s}:' || user_id || ':' || t), 1, 13))::BIGINT / 4503599627370496.0)"


@query("gaussian_noise", sql(f"""
SELECT user_id, t, round(value + 0.5 * sqrt(-2 * ln(1 - {N01.format(s='a')})) * cos(6.283185307179586 * {N01.format(s='b')}), 6) AS noisy FROM steps""", "steps"))
def _(spark, d):
    s = base.steps(spark, d).select("user_id", "t", "value")
    return s.select("user_id", "t", R(F.col("value") + signal.noise("noise", 0.5, F.col("user_id"), F.col("t"))).alias("noisy"))


@query("noise_scaling", sql(f"""
, b AS (SELECT user_id, t, value, sqrt(-2 * ln(1 - {N01.format(s='a')})) * cos(6.283185307179586 * {N01.format(s='b')}) AS g FROM steps)
SELECT std::DOUBLE AS std, round(avg(abs(value + std * g - value)), 6) AS mean_shift, round(stddev_pop(value + std * g), 6) AS spread
FROM b, (VALUES (0.1), (0.5), (2.0)) s(std) GROUP BY std""", "steps").replace("\n\n,", ",", 1))
def _(spark, d):
    """Robustness conditions side by side: one row per noise level."""
    s = base.steps(spark, d).withColumn("g", signal.noise("noise", 1.0, F.col("user_id"), F.col("t")))
    s = s.select("value", "g", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.5, 2.0)])).alias("std"))
    v = F.col("value") + F.col("std") * F.col("g")
    return s.groupBy("std").agg(R(F.avg(F.abs(v - F.col("value")))).alias("mean_shift"), R(F.stddev_pop(v)).alias("spread"))


@query("scaling_curve", sql("""
, c AS (SELECT monitor, rep, max_score, row_number() OVER (PARTITION BY monitor, rep ORDER BY
    ('0x' || substr(sha256('curve:' || rep || ':' || user_id), 1, 13))::BIGINT) - 1 AS r FROM maxima, range(5) t(rep) WHERE split = 'train'),
p AS (SELECT monitor, rep, n_runs, max_score, row_number() OVER (PARTITION BY monitor, rep, n_runs ORDER BY max_score) - 1 AS i,
   count(*) OVER (PARTITION BY monitor, rep, n_runs) AS n FROM c, (VALUES (5), (10), (20), (40)) s(n_runs) WHERE r < n_runs),
th AS (SELECT monitor, rep, n_runs, max_score AS theta FROM p WHERE i = ceil((1 - 0.1) * (n - 1))),
f AS (SELECT th.monitor, rep, n_runs, avg((max_score > theta)::INTEGER) AS fa FROM th JOIN maxima m ON m.monitor = th.monitor
   WHERE split = 'test' AND is_healthy GROUP BY ALL)
SELECT monitor, n_runs, round(avg(fa), 6) AS mean_fa, round(stddev_samp(fa), 6) AS sd_fa FROM f GROUP BY monitor, n_runs""", "maxima").replace("\n\n,", ",", 1))
def _(spark, d):
    from trajspark.operators import alarms
    m = base.maxima(spark, d)
    c = alarms.scaling_curve(m.filter("split = 'train'"), m.filter("split = 'test' AND is_healthy"), ["monitor"], "user_id",
                             "max_score", (5, 10, 20, 40), 5, 0.1, "curve")
    return c.select("monitor", "n_runs", R("mean_fa").alias("mean_fa"), R("sd_fa").alias("sd_fa"))
