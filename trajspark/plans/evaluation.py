"""Queries over scores and alarms: ranking metrics, calibration, policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.functions import hashing, stats
from trajspark.operators import alarms, calibrate, ordered, policy, ranks
from trajspark.plans import base
from trajspark.plans.base import U, cte, sql, table
from trajspark.plans.numeric import R, summary
from trajspark.plans.registry import query

AUC_SQL = """
SELECT {g}, np AS n_pos, nn AS n_neg, CASE WHEN np > 0 AND nn > 0 THEN round((rs - np * (np + 1) / 2.0) / (np * nn), 6) END AS auroc
FROM (SELECT {g}, sum(pos::INTEGER)::BIGINT AS np, sum((NOT pos)::INTEGER)::BIGINT AS nn,
        sum(CASE WHEN pos THEN r ELSE 0 END) AS rs
 FROM (SELECT {g}, pos, rank() OVER (PARTITION BY {g} ORDER BY s) + (count(*) OVER (PARTITION BY {g}, s) - 1) / 2.0 AS r
       FROM ({src})) GROUP BY {g})"""


def auc_out(df, by):
    return df.select(*by, "n_pos", "n_neg", R("auroc").alias("auroc"))


@query("episode_auc", sql(AUC_SQL.format(
    g="monitor", src="SELECT monitor, max_score AS s, NOT is_healthy AS pos FROM maxima WHERE split = 'test'"), "maxima"))
def _(spark, d):
    m = base.maxima(spark, d).filter("split = 'test'")
    return auc_out(ranks.auc(m, ["monitor"], "max_score", ~F.col("is_healthy")), ["monitor"])


@query("label_auc_by_lang", AUC_SQL.format(
    g="lang", src="SELECT lang, n_chars AS s, toxic = 1 AS pos FROM documents JOIN labels USING (doc_id)"))
def _(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return auc_out(ranks.auc(j, ["lang"], "n_chars", F.col("toxic") == 1), ["lang"])


@query("avg_precision", sql("""
SELECT monitor, round(sum(p * (cp / cn)) / max(tp), 6) AS avg_precision FROM (
  SELECT monitor, p, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY monitor) AS tp
  FROM (SELECT monitor, max_score, sum((NOT is_healthy)::INTEGER)::DOUBLE AS p, count(*)::DOUBLE AS n
        FROM maxima WHERE split = 'test' GROUP BY ALL)
  WINDOW w AS (PARTITION BY monitor ORDER BY max_score DESC)) GROUP BY monitor""", "maxima"))
def _(spark, d):
    m = base.maxima(spark, d).filter("split = 'test'")
    return ranks.average_precision(m, ["monitor"], "max_score", ~F.col("is_healthy")).withColumn(
        "avg_precision", R("avg_precision"))


@query("length_confound", sql("""
WITH m AS (SELECT monitor, user_id, n_steps, max_score, is_healthy, n_steps // 2 AS b FROM maxima WHERE split = 'test'),
sp AS (SELECT monitor, corr(rl, rs) AS rho FROM (
   SELECT monitor, rank() OVER (PARTITION BY monitor ORDER BY n_steps) + (count(*) OVER (PARTITION BY monitor, n_steps) - 1) / 2.0 AS rl,
     rank() OVER (PARTITION BY monitor ORDER BY max_score) + (count(*) OVER (PARTITION BY monitor, max_score) - 1) / 2.0 AS rs
   FROM m WHERE is_healthy) GROUP BY monitor),
k AS (SELECT *, row_number() OVER (PARTITION BY monitor, b, is_healthy ORDER BY user_id) AS i,
   count(*) FILTER (is_healthy) OVER (PARTITION BY monitor, b) AS nh,
   count(*) FILTER (NOT is_healthy) OVER (PARTITION BY monitor, b) AS ni FROM m),
mt AS (SELECT * FROM k WHERE i <= least(nh, ni)),
a AS (SELECT monitor, count(*) AS n_matched, sum(CASE WHEN NOT is_healthy THEN r ELSE 0 END) AS rs,
   sum((NOT is_healthy)::INTEGER) AS np, sum(is_healthy::INTEGER) AS nn FROM (
     SELECT *, rank() OVER (PARTITION BY monitor ORDER BY max_score) + (count(*) OVER (PARTITION BY monitor, max_score) - 1) / 2.0 AS r FROM mt)
   GROUP BY monitor)
SELECT monitor, round(rho, 6) AS healthy_spearman, n_matched,
  round((rs - np * (np + 1) / 2.0) / (np * nn), 6) AS length_matched_auroc FROM sp JOIN a USING (monitor)""", "maxima").replace(
    "\nWITH m AS", ",\nm AS", 1))
def _(spark, d):
    m = base.maxima(spark, d).filter("split = 'test'").withColumn("b", F.floor(F.col("n_steps") / 2))
    h = m.filter("is_healthy").withColumn("n_steps", F.col("n_steps").cast("double"))
    r = ranks.with_ranks(h, ["monitor"], "n_steps", "rl")
    r = ranks.with_ranks(r, ["monitor"], "max_score", "rs")
    rho = r.groupBy("monitor").agg(F.corr("rl", "rs").alias("rho"))
    idx = ranks.hash_order(m.withColumn("k", F.col("user_id").cast("double")),
                           ["monitor", "b", "is_healthy"], "k", "i")
    n = m.groupBy("monitor", "b").agg(
        F.least(F.sum(F.col("is_healthy").cast("int")), F.sum((~F.col("is_healthy")).cast("int"))).alias("keep"))
    matched = idx.join(n, ["monitor", "b"]).filter("i < keep")
    auc = ranks.auc(matched, ["monitor"], "max_score", ~F.col("is_healthy"))
    return rho.join(auc, "monitor").select(
        "monitor", R("rho").alias("healthy_spearman"), (F.col("n_pos") + F.col("n_neg")).alias("n_matched"),
        R("auroc").alias("length_matched_auroc"))


PROBS = [0.5 + i * (0.999 - 0.5) / 24 for i in range(25)]


@query("delay_fa_curve", sql("""
, q AS (SELECT i AS q_index, 0.5::DOUBLE + i * (0.999::DOUBLE - 0.5::DOUBLE) / 24 AS quantile FROM range(25) r(i)),
v AS (SELECT monitor, max_score, row_number() OVER (PARTITION BY monitor ORDER BY max_score) - 1 AS i,
  count(*) OVER (PARTITION BY monitor) AS n FROM maxima WHERE split = 'val'),
th AS (SELECT monitor, q_index, quantile, max_score AS theta FROM v, q WHERE i = ceil(quantile * (n - 1))),
fh AS (SELECT monitor, q_index, theta, user_id, min(CASE WHEN score > theta THEN t END) AS a
  FROM scores JOIN th USING (monitor) GROUP BY ALL),
o AS (SELECT *, CASE WHEN NOT is_healthy AND a >= tau THEN 1 ELSE 0 END AS hit FROM fh JOIN episodes USING (user_id) WHERE split = 'test')
SELECT monitor, q_index::INTEGER AS q_index, round(any_value(theta), 6) AS theta,
  round(avg(CASE WHEN is_healthy THEN (a IS NOT NULL)::INTEGER END), 6) AS healthy_fa_rate,
  round(avg(CASE WHEN NOT is_healthy THEN hit END), 6) AS detection_rate,
  median(CASE WHEN hit = 1 THEN (a - tau)::DOUBLE END) AS median_delay,
  median(CASE WHEN hit = 1 THEN (n_steps - 1 - a)::DOUBLE END) AS median_lead
FROM o GROUP BY monitor, q_index""", "maxima", "scores", "episodes").replace("\n\n,", ",", 1))
def _(spark, d):
    th = alarms.threshold_sweep(base.maxima(spark, d).filter("split = 'val'"), ["monitor"], "max_score", PROBS)
    rows = alarms.sweep_alarms(base.scores(spark, d), th, ["monitor"], U)
    rows = alarms.with_outcome(rows.join(base.episodes(spark, d).filter("split = 'test'"), U))
    s = summary(rows, ["monitor", "q_index"])
    return s.join(F.broadcast(th), ["monitor", "q_index"]).select(
        "monitor", "q_index", R("theta").alias("theta"), "healthy_fa_rate", "detection_rate",
        "median_delay", "median_lead")


@query("precision_recall", sql("""
SELECT monitor, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS prec,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS rec FROM (
SELECT monitor, count(*) FILTER (outcome = 'true_alarm') AS tp,
  count(*) FILTER (outcome IN ('false_alarm', 'early_alarm')) AS fp, count(*) FILTER (outcome = 'miss') AS fn
FROM alarms GROUP BY monitor)""", "alarms"))
def _(spark, d):
    return alarms.precision_recall(base.alarm_rows(spark, d), ["monitor"]).withColumns(
        {"prec": R("prec"), "rec": R("rec")})


@query("alarm_rate_by_label", sql("""
SELECT monitor, round(avg(CASE WHEN is_healthy THEN (alarm_step IS NOT NULL)::INTEGER END), 6) AS healthy,
""" + ",\n".join(f"  round(avg(CASE WHEN failure_class = 'c{i}' THEN (alarm_step IS NOT NULL)::INTEGER END), 6) AS c{i}"
                 for i in range(5)) + " FROM alarms GROUP BY monitor", "alarms"))
def _(spark, d):
    a = base.alarm_rows(spark, d).withColumns({
        "label": F.coalesce("failure_class", F.lit("healthy")),
        "alarmed": F.col("alarm_step").isNotNull().cast("double")})
    labels = ["healthy", "c0", "c1", "c2", "c3", "c4"]
    p = a.groupBy("monitor").pivot("label", labels).agg(F.avg("alarmed"))
    return p.select("monitor", *[R(c).alias(c) for c in labels])


@query("class_auc", sql("""
, x AS (SELECT c.failure_class AS cls, m.monitor, m.max_score AS s, NOT m.is_healthy AS pos
  FROM maxima m JOIN (SELECT DISTINCT failure_class FROM maxima WHERE NOT is_healthy) c
  ON m.is_healthy OR m.failure_class = c.failure_class WHERE split = 'test')"""
                           + AUC_SQL.format(g="monitor, cls", src="SELECT * FROM x"), "maxima").replace("\n\n,", ",", 1))
def _(spark, d):
    """Each failure class against the shared healthy episodes."""
    m = base.maxima(spark, d).filter("split = 'test'")
    return auc_out(alarms.class_auc(m, ["monitor"], "max_score", "failure_class"), ["monitor", "cls"])


# ------------------------------------------------------------- calibration
cte("conf", ("maxima",), """
  SELECT x.monitor, x.user_id, x.is_healthy,
    1 - (1 + (SELECT count(*) FROM maxima v WHERE v.split = 'val' AND v.monitor = x.monitor AND v.max_score >= x.max_score))
      / (1.0 + (SELECT count(*) FROM maxima v WHERE v.split = 'val' AND v.monitor = x.monitor)) AS confidence
  FROM maxima x WHERE x.split = 'test'""")


def confidences(spark, d):
    m = base.maxima(spark, d)
    return calibrate.conformal(m.filter("split = 'val'"), m.filter("split = 'test'"), ["monitor"], "max_score")


@query("conformal_confidence", sql("SELECT monitor, user_id, round(confidence, 6) AS confidence FROM conf", "conf"))
def _(spark, d):
    return confidences(spark, d).select("monitor", "user_id", R("confidence").alias("confidence"))


@query("ks_uniform", sql("""
SELECT monitor, round(max(greatest(i / n - confidence, confidence - (i - 1) / n)), 6) AS ks FROM (
  SELECT monitor, confidence, (row_number() OVER (PARTITION BY monitor ORDER BY confidence))::DOUBLE AS i,
   (count(*) OVER (PARTITION BY monitor))::DOUBLE AS n FROM conf WHERE is_healthy) GROUP BY monitor""", "conf"))
def _(spark, d):
    return calibrate.ks_uniform(confidences(spark, d).filter("is_healthy"), ["monitor"], "confidence").withColumn("ks", R("ks"))


@query("null_false_alarm", sql("""
SELECT monitor, round(avg((confidence >= 0.90)::INTEGER), 6) AS fa90, round(avg((confidence >= 0.95)::INTEGER), 6) AS fa95
FROM conf WHERE is_healthy GROUP BY monitor""", "conf"))
def _(spark, d):
    return confidences(spark, d).filter("is_healthy").groupBy("monitor").agg(
        R(F.avg((F.col("confidence") >= 0.90).cast("double"))).alias("fa90"),
        R(F.avg((F.col("confidence") >= 0.95).cast("double"))).alias("fa95"))


REL = """SELECT lang, least(floor(c * 10), 9)::INTEGER AS bin, avg(c) AS mc, avg(toxic) AS ef, count(*) AS n
  FROM (SELECT lang, toxic, n_chars / (n_chars + 3000.0) AS c FROM documents JOIN labels USING (doc_id)) GROUP BY ALL"""


def rel_rows(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") / (F.col("n_chars") + 3000.0)).alias("c")) \
        .join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")


@query("reliability", f"""SELECT lang, bin, (bin + 0.5) / 10.0::DOUBLE AS bin_center, round(mc, 6) AS mean_confidence,
 round(ef, 6) AS empirical_freq, n FROM ({REL})""")
def _(spark, d):
    r = calibrate.reliability(rel_rows(spark, d), ["lang"], "c", F.col("toxic"))
    return r.select("lang", "bin", "bin_center", R("mean_confidence").alias("mean_confidence"),
                    R("empirical_freq").alias("empirical_freq"), "n")


@query("ece", f"SELECT lang, round(sum(n * abs(ef - mc)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM ({REL}) GROUP BY lang")
def _(spark, d):
    return calibrate.ece(rel_rows(spark, d), ["lang"], "c", F.col("toxic")).withColumn("ece", R("ece"))


@query("isotonic")
def _(spark, d):
    j = rel_rows(spark, d)
    return calibrate.isotonic(j.select("c", "toxic"), j.select("doc_id", "c"), "c", "toxic").select(
        "doc_id", R("probability").alias("probability"))


# ---------------------------------------------------------------- policies
cte("verdicts", ("scores", "episodes", "thetas"), """
  SELECT user_id, t, n_steps, is_healthy, tau, failure_class, score > theta * 0.5 AS trig,
    ('0x' || substr(sha256('judge:' || user_id || ':' || t), 1, 13))::BIGINT / 4503599627370496.0
      < CASE WHEN NOT is_healthy AND t >= tau THEN 0.9 ELSE 0.02 END AS pos
  FROM scores JOIN episodes USING (user_id) JOIN thetas USING (monitor) WHERE monitor = 'cusum' AND split = 'test'""")


def verdicts(spark, d):
    e = base.episodes(spark, d).filter("split = 'test'")
    s = base.scores(spark, d).filter("monitor = 'cusum'").join(F.broadcast(base.thetas(spark, d)), "monitor").join(e, U)
    p = F.when(~F.col("is_healthy") & (F.col("t") >= F.col("tau")), 0.9).otherwise(0.02)
    return s.select("user_id", "t", (F.col("score") > F.col("theta") * 0.5).alias("trig"),
                    (hashing.uniform("judge", F.col("user_id"), F.col("t")) < p).alias("pos"))


cte("halts_every", ("verdicts",), """
  SELECT user_id, halted_at, coalesce(halted_at, last) + 1 AS calls FROM (
    SELECT user_id, min(CASE WHEN pos AND prev THEN t END) AS halted_at, max(t) AS last FROM (
      SELECT user_id, t, pos, lag(pos) OVER (PARTITION BY user_id ORDER BY t) AS prev FROM verdicts) GROUP BY user_id)""")
cte("halts_esc", ("verdicts",), """
  WITH RECURSIVE r(user_id, t, streak, cd, calls, h) AS (
    SELECT DISTINCT user_id, -1, 0, 0, 0, NULL::INTEGER FROM verdicts
    UNION ALL
    SELECT r.user_id, v.t,
      CASE WHEN r.cd > 0 OR NOT v.trig OR NOT v.pos THEN 0 ELSE r.streak + 1 END,
      CASE WHEN r.cd > 0 THEN r.cd - 1 WHEN v.trig AND NOT v.pos THEN 3 ELSE 0 END,
      r.calls + CASE WHEN r.cd = 0 AND v.trig THEN 1 ELSE 0 END,
      CASE WHEN r.cd = 0 AND v.trig AND v.pos AND r.streak + 1 >= 2 THEN v.t END
    FROM r JOIN verdicts v ON v.user_id = r.user_id AND v.t = r.t + 1 WHERE r.h IS NULL)
  SELECT user_id, max(h) AS halted_at, max(calls) AS calls FROM r GROUP BY user_id""")
cte("halts_alarm", ("verdicts",), """
  SELECT user_id, min(CASE WHEN trig THEN t END) AS halted_at, 0 AS calls FROM verdicts GROUP BY user_id""")
cte("policy_rows", ("halts_every", "halts_esc", "halts_alarm", "episodes"), """
  SELECT p.*, n_steps, is_healthy, tau,
    NOT is_healthy AND halted_at IS NOT NULL AND halted_at >= tau AS detected FROM (
   SELECT 'never' AS policy, user_id, NULL::INTEGER AS halted_at, 0 AS calls FROM halts_alarm
   UNION ALL SELECT 'halt_on_alarm', user_id, halted_at, calls FROM halts_alarm
   UNION ALL SELECT 'judge_every_step', user_id, halted_at, calls FROM halts_every
   UNION ALL SELECT 'escalate_on_alarm', user_id, halted_at, calls FROM halts_esc) p JOIN episodes USING (user_id)""")
cte("policy_cost", ("policy_rows",), """
  SELECT *, halted_at IS NOT NULL AND NOT coalesce(detected, false) AS wrongful,
    (coalesce(halted_at + 1, n_steps) + calls
     + CASE WHEN halted_at IS NOT NULL AND NOT coalesce(detected, false) THEN n_steps - 1 - halted_at ELSE 0 END)::DOUBLE AS cost
  FROM policy_rows""")


def policy_outcomes(spark, d):
    v = verdicts(spark, d)
    parts = {
        "never": policy.never(v, U),
        "halt_on_alarm": policy.halt_on_alarm(v, U, "t", F.col("trig")),
        "judge_every_step": policy.judge_every_step(v, U, "t", F.col("pos")),
        "escalate_on_alarm": policy.escalate_on_alarm(v, U, "t", F.col("trig"), F.col("pos"))}
    out = None
    for name, df in parts.items():
        df = df.withColumn("policy", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return policy.outcomes(out, base.episodes(spark, d), U)


@query("policy_halt_debounce", sql("SELECT user_id, halted_at, calls::BIGINT AS calls FROM halts_every", "halts_every"))
def _(spark, d):
    return policy.judge_every_step(verdicts(spark, d), U, "t", F.col("pos"))


@query("policy_escalate_cooldown", sql("SELECT user_id, halted_at, calls::BIGINT AS calls FROM halts_esc", "halts_esc"))
def _(spark, d):
    return policy.escalate_on_alarm(verdicts(spark, d), U, "t", F.col("trig"), F.col("pos"))


@query("policy_outcome_cost", sql("""
SELECT policy, user_id, halted_at, calls::BIGINT AS calls, coalesce(detected, false) AS detected, wrongful, cost FROM policy_cost""", "policy_cost"))
def _(spark, d):
    return policy_outcomes(spark, d).select("policy", "user_id", "halted_at", "calls", "detected",
                                            F.col("wrongful_halt").alias("wrongful"), "cost")


@query("policy_summary", sql("""
SELECT policy, round(avg(cost), 6) AS mean_cost, round(avg(calls), 6) AS mean_judge_calls,
  round(avg(CASE WHEN NOT is_healthy THEN coalesce(detected, false)::INTEGER END), 6) AS detection_rate,
  round(avg(CASE WHEN detected THEN n_steps - 1 - halted_at END), 6) AS mean_lead,
  round(avg(wrongful::INTEGER), 6) AS wrongful_halt_rate,
  round(avg(CASE WHEN is_healthy THEN wrongful::INTEGER END), 6) AS healthy_wrongful_halt_rate,
  round(avg(CASE WHEN NOT is_healthy THEN wrongful::INTEGER END), 6) AS early_injected_halt_rate
FROM policy_cost GROUP BY policy""", "policy_cost"))
def _(spark, d):
    s = policy.summarize(policy_outcomes(spark, d), ["policy"])
    return s.select("policy", *[R(c).alias(c) for c in s.columns if c != "policy"])


@query("policy_repricing", sql("""
, s AS (SELECT policy, avg(cost) AS c, avg(calls) AS k FROM policy_cost GROUP BY policy),
e AS (SELECT c AS ec, k AS ek FROM s WHERE policy = 'judge_every_step')
SELECT policy, ratio::DOUBLE AS ratio, round((c - k + ratio * k) / (ec - ek + ratio * ek), 6) AS cost_ratio,
  round(CASE WHEN ek <> k THEN ((c - k) - (ec - ek)) / (ek - k) END, 6) AS break_even
FROM s, e, (VALUES (0.1), (0.5), (1.0), (2.0)) r(ratio)""", "policy_cost").replace("\n\n,", ",", 1))
def _(spark, d):
    s = policy.summarize(policy_outcomes(spark, d), ["policy"]).select("policy", "mean_cost", "mean_judge_calls")
    e = s.filter("policy = 'judge_every_step'").select(
        F.col("mean_cost").alias("ec"), F.col("mean_judge_calls").alias("ek"))
    j = s.crossJoin(F.broadcast(e)).withColumn("ratio", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.5, 1.0, 2.0)])))
    c, k, ec, ek, r = (F.col(x) for x in ("mean_cost", "mean_judge_calls", "ec", "ek", "ratio"))
    return j.select("policy", "ratio", R(policy.cost_at(c, k, r) / policy.cost_at(ec, ek, r)).alias("cost_ratio"),
                    R(policy.break_even(c, k, ec, ek)).alias("break_even"))


SETTINGS = (0.5, 0.8, 0.9, 0.95)
cte("sweep_steps", ("scores", "maxima", "episodes"), """
  SELECT st.ct, x.user_id, x.t, x.run_max, r.n, 1 - (1 + r.n_ge) / (1.0 + r.n) > st.ct AS trig,
    ('0x' || substr(sha256('judge:' || x.user_id || ':' || x.t), 1, 13))::BIGINT / 4503599627370496.0
      < CASE WHEN NOT is_healthy AND x.t >= tau THEN 0.9 ELSE 0.02 END AS pos
  FROM (SELECT user_id, t, max(score) OVER (PARTITION BY user_id ORDER BY t) AS run_max FROM scores WHERE monitor = 'cusum') x
  JOIN episodes e ON e.user_id = x.user_id AND e.split = 'test'
  JOIN LATERAL (SELECT count(*) AS n, count(*) FILTER (max_score >= x.run_max) AS n_ge FROM maxima
                WHERE split = 'val' AND monitor = 'cusum') r ON true,
  (VALUES (0.5), (0.8), (0.9), (0.95)) st(ct)""")
cte("sweep_halts", ("sweep_steps",), """
  WITH RECURSIVE r(ct, user_id, t, streak, cd, calls, h) AS (
    SELECT DISTINCT ct, user_id, -1, 0, 0, 0, NULL::INTEGER FROM sweep_steps
    UNION ALL
    SELECT r.ct, r.user_id, v.t,
      CASE WHEN r.cd > 0 OR NOT v.trig OR NOT v.pos THEN 0 ELSE r.streak + 1 END,
      CASE WHEN r.cd > 0 THEN r.cd - 1 WHEN v.trig AND NOT v.pos THEN 3 ELSE 0 END,
      r.calls + CASE WHEN r.cd = 0 AND v.trig THEN 1 ELSE 0 END,
      CASE WHEN r.cd = 0 AND v.trig AND v.pos AND r.streak + 1 >= 2 THEN v.t END
    FROM r JOIN sweep_steps v ON v.ct = r.ct AND v.user_id = r.user_id AND v.t = r.t + 1 WHERE r.h IS NULL)
  SELECT ct, user_id, max(h) AS halted_at, max(calls) AS calls FROM r GROUP BY ct, user_id""")


@query("policy_sweep", sql("""
, o AS (SELECT ct, calls, is_healthy, NOT is_healthy AND halted_at >= tau AS detected FROM sweep_halts JOIN episodes USING (user_id)),
f AS (SELECT avg(calls) AS k, avg(CASE WHEN NOT is_healthy THEN (halted_at IS NOT NULL AND halted_at >= tau)::INTEGER END) AS det
  FROM halts_every JOIN episodes USING (user_id)),
s AS (SELECT ct, avg(calls) / any_value(k) AS ratio, avg(CASE WHEN NOT is_healthy THEN coalesce(detected, false)::INTEGER END) AS dr,
  any_value(det) AS det FROM o, f GROUP BY ct)
SELECT ct::DOUBLE AS conf_threshold, round(dr, 6) AS detection_rate, round(ratio, 6) AS judge_call_ratio,
  coalesce(ct = (SELECT arg_min(ct, ratio) FROM s WHERE det > 0 AND dr >= 0.8 * det), false) AS chosen FROM s""",
    "sweep_halts", "halts_every", "episodes").replace("\n\n,", ",", 1))
def _(spark, d):
    """Escalation by confidence of the running maximum, at several settings."""
    e = base.episodes(spark, d)
    s = base.scores(spark, d).filter("monitor = 'cusum'").join(e.filter("split = 'test'"), U)
    run = ordered.running(s, U, "t", {"run_max": ordered.Run("max", "score")})
    ref = base.maxima(spark, d).filter("split = 'val' AND monitor = 'cusum'").select(F.col("max_score").alias("run_max"))
    c = calibrate.conformal(ref, run, [], "run_max")
    p = F.when(~F.col("is_healthy") & (F.col("t") >= F.col("tau")), 0.9).otherwise(0.02)
    c = c.select("user_id", "t", "confidence", (hashing.uniform("judge", F.col("user_id"), F.col("t")) < p).alias("pos"),
                 F.explode(F.array(*[F.lit(x) for x in SETTINGS])).alias("conf_threshold"))
    esc = policy.escalate_on_alarm(c, ["conf_threshold", "user_id"], "t",
                                   F.col("confidence") > F.col("conf_threshold"), F.col("pos"))
    esc = esc.select("user_id", "halted_at", "calls", "conf_threshold", F.lit("escalate_on_alarm").alias("policy"))
    full = policy.judge_every_step(verdicts(spark, d), U, "t", F.col("pos")).select(
        "user_id", "halted_at", "calls", F.lit(None).cast("double").alias("conf_threshold"),
        F.lit("judge_every_step").alias("policy"))
    rows = policy.summarize(policy.outcomes(esc.unionByName(full), e, U), ["policy", "conf_threshold"])
    calls = rows.filter("policy = 'judge_every_step'").select(F.col("mean_judge_calls").alias("_k"))
    rows = rows.crossJoin(F.broadcast(calls)).withColumn("judge_call_ratio", F.col("mean_judge_calls") / F.col("_k"))
    pick = policy.pick_operating_point(rows).withColumnRenamed("conf_threshold", "_pick")
    return rows.filter("policy = 'escalate_on_alarm'").crossJoin(F.broadcast(pick)).select(
        "conf_threshold", R("detection_rate").alias("detection_rate"), R("judge_call_ratio").alias("judge_call_ratio"),
        F.coalesce(F.col("conf_threshold") == F.col("_pick"), F.lit(False)).alias("chosen"))
