"""Step, episode and score views over the given tables, with their SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.functions.hashing import uniform
from trajspark.operators import alarms, fit, ordered, ranks
from trajspark.operators.joins import one_row
from trajspark.sources import sinks

U = ["user_id"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --------------------------------------------------------------- numeric steps
def steps(spark: SparkSession, d: str) -> DataFrame:
    """``events`` as steps: one trajectory per user, ordered by (ts, event_id)."""
    done = sinks.known(spark, "steps", d)
    if done is not None:
        return done
    ev = table(spark, d, "events")
    return sinks.materialize(
        ordered.positions(ev, U, ["ts", "event_id"], ordered.day_bucket("ts")),
        "steps", d)


def episodes(spark: SparkSession, d: str) -> DataFrame:
    """One row per trajectory with deterministic labels and a split."""
    done = sinks.known(spark, "episodes", d)
    if done is not None:
        return done
    # written once: the split reads the lengths three times, and each time would count all events
    e = sinks.materialize(table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_steps")), "episode_lengths", d)
    bad = F.col("user_id") % 3 == 0
    e = e.select(
        "user_id", "n_steps", (~bad).alias("is_healthy"),
        F.when(bad, F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")))
        .alias("failure_class"),
        F.when(bad, F.floor(F.col("n_steps") / 3).cast("int")).alias("tau"),
        F.concat(F.lit("ds"), (F.col("user_id") % 4).cast("string")).alias("dataset"))
    return sinks.materialize(fit.split_60_20_20(e, "user_id", "split"),
                             "episodes", d)


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Three causal scorers over ``steps``: (monitor, user_id, t, score)."""
    done = sinks.known(spark, "scores", d)
    if done is not None:
        return done
    s = steps(spark, d).select("user_id", "t", "value")
    train = episodes(spark, d).filter("split = 'train'").select("user_id")
    ref = s.join(train, "user_id", "left_semi").agg(
        F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    z = s.crossJoin(one_row(ref)).select(
        "user_id", "t",
        ((F.col("value") - F.col("mu")) / fit.floored_scale(F.col("sd"))).alias("z"))
    z = z.withColumn("az", F.abs("z"))
    out = None
    for name, df in (
            ("absz", z.withColumn("score", F.col("az"))),
            ("cusum", ordered.cusum(z, U, "t", "z", "score", 0.5)),
            ("ewma", ordered.ewma(z, U, "t", "az", "score", 0.3, True))):
        part = df.select(F.lit(name).alias("monitor"), "user_id", "t", "score")
        out = part if out is None else out.unionByName(part)
    return sinks.materialize(out, "scores", d)


def maxima(spark: SparkSession, d: str) -> DataFrame:
    """Per-episode peak score joined to the episode labels; the peaks are written once, as thresholds read them twice."""
    m = sinks.known(spark, "peaks", d)
    if m is None:
        m = sinks.materialize(scores(spark, d).groupBy("monitor", "user_id").agg(
            F.max("score").alias("max_score")), "peaks", d)
    return m.join(episodes(spark, d), "user_id")


def thetas(spark: SparkSession, d: str, budget: float = 0.05) -> DataFrame:
    """Threshold per monitor from the healthy validation episodes."""
    val = maxima(spark, d).filter("split = 'val'")
    return alarms.pick_threshold(val, ["monitor"], "max_score", budget)


def alarm_rows(spark: SparkSession, d: str, split: str | None = "test") -> DataFrame:
    """Alarm outcome per (monitor, episode)."""
    ep = episodes(spark, d)
    if split:
        ep = ep.filter(F.col("split") == split)
    return alarms.evaluate(scores(spark, d), ep, thetas(spark, d), ["monitor"], ["user_id"])


# ------------------------------------------------------------------- SQL twins
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "steps": ((), """
  SELECT user_id, event_id, ts, event_type, value, props,
         (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS t
  FROM events"""),
    "eps0": ((), """
  SELECT user_id, count(*)::INTEGER AS n_steps, user_id % 3 <> 0 AS is_healthy,
         CASE WHEN user_id % 3 = 0 THEN 'c' || (user_id % 5) END AS failure_class,
         CASE WHEN user_id % 3 = 0 THEN (count(*) // 3)::INTEGER END AS tau,
         'ds' || (user_id % 4) AS dataset,
         ('0x' || substr(sha256('split:' || user_id), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM events GROUP BY user_id"""),
    "eps1": (("eps0",), """
  SELECT *, row_number() OVER (PARTITION BY is_healthy ORDER BY u) - 1 AS r,
         count(*) OVER (PARTITION BY is_healthy) AS n FROM eps0"""),
    "episodes": (("eps1",), """
  SELECT user_id, n_steps, is_healthy, failure_class, tau, dataset,
         CASE WHEN NOT is_healthy THEN 'test'
              WHEN r < greatest(round_even(0.6 * n, 0), 1) THEN 'train'
              WHEN r < greatest(round_even(0.6 * n, 0), 1) + greatest(round_even(0.2 * n, 0), 1) THEN 'val'
              ELSE 'test' END AS split
  FROM eps1"""),
    "ref": (("steps", "episodes"), """
  SELECT avg(value) AS mu, stddev_pop(value) AS sd0,
         CASE WHEN stddev_pop(value) < 1e-9 THEN 1.0 ELSE greatest(stddev_pop(value), 1e-3) END AS sd
  FROM steps JOIN episodes USING (user_id) WHERE split = 'train'"""),
    "z": (("steps", "ref"), """
  SELECT user_id, t, (value - mu) / sd AS z, abs((value - mu) / sd) AS az FROM steps, ref"""),
    "cs": (("z",), """
  SELECT user_id, t, sum(z - 0.5) OVER (PARTITION BY user_id ORDER BY t) AS s FROM z"""),
    "scores": (("z", "cs"), """
  SELECT 'absz' AS monitor, user_id, t, az AS score FROM z
  UNION ALL
  SELECT 'cusum', user_id, t, s - least(0.0, min(s) OVER (PARTITION BY user_id ORDER BY t)) FROM cs
  UNION ALL
  SELECT 'ewma', user_id, t,
         sum(CASE WHEN t = 0 THEN 1.0 ELSE 0.3 END * az * pow(0.7, -t))
           OVER (PARTITION BY user_id ORDER BY t) * pow(0.7, t) FROM z"""),
    "maxima": (("scores", "episodes"), """
  SELECT monitor, user_id, max(score) AS max_score, any_value(n_steps) AS n_steps,
         any_value(is_healthy) AS is_healthy, any_value(failure_class) AS failure_class,
         any_value(tau) AS tau, any_value(dataset) AS dataset, any_value(split) AS split
  FROM scores JOIN episodes USING (user_id) GROUP BY monitor, user_id"""),
    "thetas": (("maxima",), """
  SELECT monitor, n, max_score AS theta FROM (
    SELECT monitor, max_score, row_number() OVER (PARTITION BY monitor ORDER BY max_score) - 1 AS i,
           count(*) OVER (PARTITION BY monitor) AS n
    FROM maxima WHERE split = 'val') WHERE i = ceil((1 - 0.05) * (n - 1))"""),
    "first_hit": (("scores", "thetas"), """
  SELECT monitor, user_id, min(CASE WHEN score > theta THEN t END) AS alarm_step
  FROM scores JOIN thetas USING (monitor) GROUP BY monitor, user_id"""),
    "alarms0": (("first_hit", "episodes"), """
  SELECT monitor, user_id, n_steps, is_healthy, failure_class, tau, dataset, split, alarm_step,
         CASE WHEN is_healthy AND alarm_step IS NULL THEN 'correct_silence'
              WHEN is_healthy THEN 'false_alarm'
              WHEN alarm_step IS NULL THEN 'miss'
              WHEN alarm_step < tau THEN 'early_alarm' ELSE 'true_alarm' END AS outcome
  FROM first_hit JOIN episodes USING (user_id)"""),
    "alarms": (("alarms0",), """
  SELECT *, CASE WHEN outcome = 'true_alarm' THEN (alarm_step - tau)::DOUBLE END AS delay,
         CASE WHEN outcome = 'true_alarm' THEN (n_steps - 1 - alarm_step)::DOUBLE END AS lead_steps,
         CASE WHEN outcome = 'true_alarm' THEN (n_steps - 1 - alarm_step) / (n_steps - 1)::DOUBLE END AS saved_frac
  FROM alarms0 WHERE split = 'test'"""),
}


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTE[name] = (deps, body)


def sql(body: str, *needs: str) -> str:
    """``body`` with the shared CTEs it needs in front, in dependency order."""
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for dep in CTE[n][0]:
            visit(dep)
        seen.append(n)

    for n in needs:
        visit(n)
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTE[n][1]})" for n in seen)
    return (f"WITH {head}\n{body}" if head else body)
