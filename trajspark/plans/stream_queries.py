"""Queries that run as Structured Streaming over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trajspark.functions import hashing, vector
from trajspark.operators import fit, grounding
from trajspark.operators.joins import one_row
from trajspark.plans import base
from trajspark.plans.base import U, sql
from trajspark.plans.numeric import R
from trajspark.plans.registry import query
from trajspark.plans.signal_queries import logged_once, step_signals_whole
from trajspark.sources import audit, sinks
from trajspark.streaming import baseline, gate, scoring, sessions, step_vectors


def as_stream(df):
    """A written table read back as a file stream."""
    path = f"{sinks.shared_dir(df.sparkSession).rstrip('/')}/traj-in-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def drained(stream):
    """Everything the stream emits for what is there now."""
    spark = stream.sparkSession
    root = f"{sinks.shared_dir(spark).rstrip('/')}/traj-out-{uuid.uuid4().hex}"
    scoring.run_available(stream, f"{root}/rows", f"{root}/progress")
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def fed(parts, make):
    """Rows of a stream query that is fed part by part and stopped in between; its state comes back from the checkpoint."""
    spark = parts[0].sparkSession
    root = f"{sinks.shared_dir(spark).rstrip('/')}/traj-fed-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        out = make(spark.readStream.schema(part.schema).parquet(f"{root}/in"))
        scoring.run_available(out, f"{root}/rows", f"{root}/progress")
    return spark.read.schema(out.schema).parquet(f"{root}/rows")


def z_steps(spark, d):
    s = base.steps(spark, d).select("user_id", "t", "value")
    tr = base.episodes(spark, d).filter("split = 'train'").select("user_id")
    ref = s.join(tr, "user_id", "left_semi").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    return s.crossJoin(one_row(ref)).select("user_id", "t", (
        (F.col("value") - F.col("mu")) / fit.floored_scale(F.col("sd"))).alias("z"))


@query("stream_scores", sql("""
SELECT c.user_id, c.t, round(c.score, 6) AS cusum, round(e.score, 6) AS ewma, round(max(c.score) OVER (PARTITION BY c.user_id ORDER BY c.t), 6) AS peak
FROM scores c JOIN scores e ON c.user_id = e.user_id AND c.t = e.t AND c.monitor = 'cusum' AND e.monitor = 'ewma'""", "scores"))
def _(spark, d):
    """The keyed stream gives what the batch operators give."""
    out = drained(scoring.stateful_scores(as_stream(z_steps(spark, d)), U, "t", "z"))
    return out.filter("NOT late").select("user_id", "t", *[R(c).alias(c) for c in ("cusum", "ewma", "peak")])


@query("stream_gate", sql("""
, s AS (SELECT c.user_id, c.t, c.score AS b, abs(z.z) AS g FROM scores c JOIN z USING (user_id, t) WHERE c.monitor = 'cusum')
SELECT user_id, t, round((b + 10 * greatest(g - 2.5, 0)) / 3.0, 6) AS display, b + 10 * greatest(g - 2.5, 0) > 3.0 AS alarm FROM s""", "scores", "z").replace("\n\n,", ",", 1))
def _(spark, d):
    """Online content gate in display units: the stream equals the batch."""
    z = z_steps(spark, d)
    out = drained(scoring.stateful_scores(as_stream(z), U, "t", "z")).filter("NOT late").join(z, ["user_id", "t"])
    g = out.withColumn("score", scoring.gate(F.col("cusum"), F.abs("z"), F.lit(2.5), F.lit(0.0)))
    return scoring.alarms(g, "score", 3.0).select("user_id", "t", R("display").alias("display"), "alarm")


@query("rolling_baseline")
def _(spark, d):
    """Healthy reference per corpus over its runs, with a configuration change."""
    m = base.maxima(spark, d).filter("monitor = 'cusum'").select(
        "dataset", "user_id", F.col("max_score").alias("score"), "is_healthy",
        F.when(F.col("user_id") < 75, "a").otherwise("b").alias("fingerprint"))
    m = m.withColumn("checks_passed", F.col("is_healthy") | (hashing.uniform("chk", F.col("user_id")) < 0.3))
    out = drained(baseline.rolling_baseline(as_stream(m), ["dataset"], "user_id"))
    return out.withColumns({c: R(c) for c in ("threshold", "realized_fa", "drift_fa")})


@query("audit_roundtrip", sql("""
SELECT user_id::VARCHAR AS run_id, t::BIGINT AS seq, 'score' AS event, CASE WHEN score > 3 THEN 'halt' ELSE 'watch' END AS decision,
  round(score, 6) AS value, score <= 3 AS unknown_kind FROM scores WHERE monitor = 'cusum'""", "scores"))
def _(spark, d):
    """Score records appended by a stream and read back."""
    s = base.scores(spark, d).filter("monitor = 'cusum'").select("user_id", "t", "score")
    rec = audit.records(as_stream(s), F.col("user_id"), F.col("t"), F.timestamp_seconds(F.col("t")), F.lit("score"),
                        F.when(F.col("score") > 3, "halt").otherwise("watch"), F.col("score"))
    root = f"{sinks.shared_dir(spark).rstrip('/')}/traj-audit-{uuid.uuid4().hex}"
    audit.stream(rec, f"{root}/log", f"{root}/progress").awaitTermination()
    return audit.read(spark, f"{root}/log").select("run_id", "seq", "event", "decision", R("value").alias("value"), "unknown_kind")


@query("audit_refused", """
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'unknown event ' || event_type ELSE 'no event' END AS reason
FROM events WHERE event_type IN ('view', 'click', 'error')""")
def _(spark, d):
    """Events as audit events: two kinds outside the vocabulary, one missing, the others known."""
    e = base.table(spark, d, "events").select("event_id", F.when(F.col("event_type").isin("view", "click"), F.col("event_type"))
                                              .when(F.col("event_type") != "error", "step").alias("event"))
    return audit.refused(e, F.col("event")).select("event_id", "reason")


def log_parts(spark, d):
    """Logged steps in three parts: the first two steps of each run, the next three, the rest."""
    s = logged_once(spark, d)
    return [s.filter(c) for c in ("t < 2", "t >= 2 AND t < 5", "t >= 5")]


@query("stream_signals")
def _(spark, d):
    """60-wide vectors from a stream in three micro-batches: what ``step_signals`` gives for the whole log."""
    s = fed(log_parts(spark, d), lambda log: step_vectors.live_signals(log, ["conv_id"], "t")).filter("NOT late")
    width = sum((F.size(c) for c in "umxg"), F.size("e"))
    return s.select("conv_id", F.col("t").cast("int").alias("t"), width.alias("width"), R(vector.norm(F.col("e"))).alias("e_norm"),
                    F.col("m")[5].alias("log_tokens"), R(F.col("x")[0]).alias("drift"), R(F.col("x")[7]).alias("consistency"),
                    R(F.col("x")[4]).alias("tool_latency"), F.col("x")[6].cast("int").alias("n_calls"),
                    *[R(F.col("g")[i]).alias(f"g_{n}") for i, n in enumerate(grounding.DIMS)])


@query("stream_content_gate")
def _(spark, d):
    """Online gate with a live content stream: levels from the runs of one half of the log, display and alarm for all."""
    v = step_signals_whole(spark, d)
    levels = gate.fit(v.filter(hashing.uniform("gate", F.col("conv_id")) < 0.5), ["conv_id"], "t")
    make = lambda log: gate.gated(step_vectors.live_signals(log, ["conv_id"], "t").filter("NOT late"), levels)
    out = fed(log_parts(spark, d), make)
    return out.select("conv_id", F.col("t").cast("int").alias("t"), R("behaviour", 4).alias("behaviour"), R("content", 4).alias("content"),
                      "lexical", R("display", 4).alias("display"), "alarm")


GAP, DELAY = 6 * 3600, 86_400
_PARTED = f"""
WITH p AS (
  SELECT *, CASE WHEN event_id % 13 = 0 THEN 2 ELSE least(2, floor(3 * (epoch(ts) - lo) / (hi - lo + 1)))::INT END AS part
  FROM events, (SELECT min(epoch(ts)) AS lo, max(epoch(ts)) AS hi FROM events)),
m AS (SELECT part, max(max(ts)) OVER (ORDER BY part) - INTERVAL {DELAY} SECOND AS after FROM p GROUP BY part),
r AS (SELECT p.*, coalesce(p.ts < b.after, FALSE) AS late FROM p LEFT JOIN m b ON b.part = p.part - 1)"""


def session_rows(spark, d):
    """Events fed in three parts by time, every 13th of them with the last part however old it is."""
    done = sinks.known(spark, "live_sessions", d)
    if done is not None:
        return done
    e = base.table(spark, d, "events").select("user_id", "ts", "event_id")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    ends = e.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    e = e.crossJoin(one_row(ends)).withColumn("part", F.when(F.col("event_id") % 13 == 0, 2).otherwise(
        F.least(F.lit(2), F.floor(3 * (at - F.col("lo")) / (F.col("hi") - F.col("lo") + 1)))))
    e = sinks.materialize(e.drop("lo", "hi"), "parted_events")
    parts = [e.filter(F.col("part") == k).drop("part") for k in range(3)]
    return sinks.materialize(fed(parts, lambda s: sessions.live_sessions(s, U, "ts", "event_id", gap_s=GAP, delay_s=DELAY)), "live_sessions", d)


@query("stream_sessions", _PARTED + f""",
g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL {GAP} SECOND THEN 0 ELSE 1 END AS n FROM r WHERE NOT late
      WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, sid
HAVING max(ts) + INTERVAL {GAP} SECOND <= (SELECT max(after) FROM m)""")
def _(spark, d):
    """Sessions that the watermark has closed: those of the rows in time."""
    return session_rows(spark, d).filter("NOT late").select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("n_rows").alias("n"))


@query("stream_late_rows", _PARTED + """
SELECT event_id, user_id, ts FROM r WHERE late""")
def _(spark, d):
    """The side table of the rows that came behind the watermark."""
    return session_rows(spark, d).filter("late").select(
        F.col("row_id").cast("long").alias("event_id"), "user_id", F.col("started").cast("timestamp_ntz").alias("ts"))
