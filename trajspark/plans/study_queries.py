"""Queries for study tables: joins, accounting, audits, bands, robustness."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajspark.functions import hashing, stats
from trajspark.operators import alarms, joins, paired, ranks, studies
from trajspark.plans import base
from trajspark.plans.base import U, cte, sql, table
from trajspark.plans.numeric import R
from trajspark.plans.registry import query

U01 = "('0x' || substr(sha256('{s}:' || {k}), 1, 13))::BIGINT / 4503599627370496.0"


@query("dedup_conflict", """
WITH r AS (SELECT o_custkey AS k, 1 AS pr, o_orderstatus AS s, round(o_totalprice) AS p FROM orders
  UNION ALL SELECT c_custkey, 2, 'C', round(c_acctbal) FROM customer)
SELECT k, arg_min(s, struct_pack(pr := pr, s := s, p := p)) AS s, count(DISTINCT s || '|' || p) > 1 AS conflict FROM r GROUP BY k""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit(1).alias("pr"), F.col("o_orderstatus").alias("s"),
                                         F.round("o_totalprice").alias("p"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(2).alias("pr"), F.lit("C").alias("s"),
                                           F.round("c_acctbal").alias("p"))
    rows = o.unionByName(c).withColumn("order", F.struct("pr", "s", "p"))
    best, clash = studies.first_wins(rows, ["k"], "order", ["s", "p"])
    return best.select("k", "s").join(clash.select("k", F.lit(True).alias("c")), "k", "left").select(
        "k", "s", F.coalesce("c", F.lit(False)).alias("conflict"))


cte("mon2", ("alarms",), """
  SELECT user_id, dataset, failure_class, is_healthy, tau, n_steps,
    max(CASE WHEN monitor = 'cusum' THEN (outcome = 'true_alarm')::INTEGER END) AS c,
    max(CASE WHEN monitor = 'absz' THEN (outcome = 'true_alarm')::INTEGER END) AS a,
    max(CASE WHEN monitor = 'ewma' THEN (outcome = 'true_alarm')::INTEGER END) AS e FROM alarms GROUP BY ALL""")


def mon2(spark, d):
    a = base.alarm_rows(spark, d)
    hit = (F.col("outcome") == "true_alarm").cast("int")
    return a.groupBy("user_id", "dataset", "failure_class", "is_healthy", "tau", "n_steps").agg(*[
        F.max(F.when(F.col("monitor") == m, hit)).alias(n) for m, n in (("cusum", "c"), ("absz", "a"), ("ewma", "e"))])


@query("aligned_studies", sql("""
SELECT x.user_id, (NOT (x.outcome IS NOT DISTINCT FROM y.outcome))::INTEGER + (NOT (x.alarm_step IS NOT DISTINCT FROM y.alarm_step))::INTEGER AS n_disagree
FROM alarms x JOIN alarms y ON x.user_id = y.user_id AND x.monitor = 'cusum' AND y.monitor = 'ewma'""", "alarms"))
def _(spark, d):
    a = base.alarm_rows(spark, d).select("monitor", "user_id", "outcome", "alarm_step")
    return studies.aligned(a.filter("monitor = 'cusum'"), a.filter("monitor = 'ewma'"), U, ["outcome", "alarm_step"]).select(
        "user_id", "n_disagree")


@query("key_residue", """
WITH m AS (SELECT c_mktsegment AS seg, c_custkey AS k, c_acctbal > 2000 AS a, c_custkey IN (SELECT o_custkey FROM orders) AS b,
   c_nationkey % 3 = 0 AS c FROM customer)
SELECT seg, count(*) AS n_union, count(*) FILTER (a AND b AND c) AS n_common, count(*) FILTER (a AND NOT b AND NOT c) AS only_a,
  count(*) FILTER (b AND NOT a AND NOT c) AS only_b, count(*) FILTER (c AND NOT a AND NOT b) AS only_c FROM m WHERE a OR b OR c GROUP BY seg""")
def _(spark, d):
    """Three sets that overlap: large balances, customers with orders, every third nation."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("seg"), F.col("c_custkey").alias("k"), "c_acctbal", "c_nationkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return studies.key_residue({"a": c.filter("c_acctbal > 2000"), "b": c.join(o, "k", "left_semi"), "c": c.filter("c_nationkey % 3 = 0")}, ["k"], "seg")


@query("semi_anti", """
SELECT n_name, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS with_orders,
  count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def _(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    on = c["c_custkey"] == o["o_custkey"]
    both = c.join(o, on, "left_semi").select("c_nationkey", F.lit(1).alias("w"), F.lit(0).alias("x")).unionByName(
        c.join(o, on, "left_anti").select("c_nationkey", F.lit(0).alias("w"), F.lit(1).alias("x")))
    g = both.groupBy("c_nationkey").agg(F.sum("w").alias("with_orders"), F.sum("x").alias("without"))
    n = joins.small(table(spark, d, "nation"))
    return g.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "with_orders", "without")


BAND = "CASE WHEN n_steps - 1 - tau <= 40 THEN '<=40' WHEN n_steps - 1 - tau <= 45 THEN '41-45' ELSE '>=46' END"
BANDS = ["<=40", "41-45", ">=46"]


def horizons(spark, d):
    m = mon2(spark, d).filter(~F.col("is_healthy"))
    return m.withColumn("band", studies.band(F.col("n_steps") - 1 - F.col("tau"), [40, 45]))


@query("bands_rollup", sql(f"""
, b AS (SELECT dataset, {BAND} AS band, c FROM mon2 WHERE NOT is_healthy),
g AS (SELECT coalesce(dataset, 'ALL') AS arm, band, count(*) AS n, avg(c) AS r FROM b GROUP BY GROUPING SETS ((dataset, band), (band)))
SELECT arm, band, n, round(r, 6) AS rate, round(n / sum(n) OVER (PARTITION BY arm), 6) AS share FROM g""", "mon2").replace("\n\n,", ",", 1))
def _(spark, d):
    g = studies.banded(horizons(spark, d), "dataset", "band", "c")
    return g.select("arm", "band", "n", R("rate").alias("rate"), R("share").alias("share"))


@query("adjacent_contrasts", sql(f"""
, b AS (SELECT dataset, {BAND} AS band, c FROM mon2 WHERE NOT is_healthy),
g AS (SELECT dataset, band, count(*) AS n, avg(c) AS r FROM b GROUP BY ALL)
SELECT h.dataset, h.band || ' vs ' || l.band AS contrast, l.n AS n_low, h.n AS n_high, round(h.r - l.r, 6) AS gap FROM g l JOIN g h ON l.dataset = h.dataset
AND ((l.band = '<=40' AND h.band = '41-45') OR (l.band = '41-45' AND h.band = '>=46')) WHERE l.n >= 2 AND h.n >= 2""", "mon2").replace("\n\n,", ",", 1))
def _(spark, d):
    c = studies.adjacent_contrasts(horizons(spark, d), "dataset", "band", "c", BANDS, 2)
    return c.select("dataset", "contrast", "n_low", "n_high", R("gap").alias("gap"))


@query("leave_one_group_out", """
WITH b AS (SELECT source, n_chars::DOUBLE AS x, toxic::DOUBLE AS y FROM documents JOIN labels USING (doc_id)),
s AS (SELECT DISTINCT source AS dropped FROM b),
c AS (SELECT dropped, source, x - avg(x) OVER w AS xc, y - avg(y) OVER w AS yc, count(*) OVER w AS k FROM b, s WHERE source <> dropped WINDOW w AS (PARTITION BY dropped, source))
SELECT dropped, round(corr(xc, yc), 6) AS r_within FROM c WHERE k >= 2 GROUP BY dropped""")
def _(spark, d):
    """Within-stratum correlation without each group in turn, from group sums only."""
    from trajspark.plans.tests_of_difference import labelled
    r = paired.leave_one_out_corr(labelled(spark, d), "source", "x", "y")
    return r.select("dropped", R("r_within").alias("r_within"))


@query("complementarity", sql("""
SELECT coalesce(failure_class, 'ALL') AS arm, bucket, count(*) AS n, round(avg(e), 6) AS third_rate FROM (SELECT failure_class, e,
  CASE WHEN c = 1 AND a = 1 THEN 'both' WHEN c = 1 THEN 'only_a' WHEN a = 1 THEN 'only_b' ELSE 'neither' END AS bucket FROM mon2 WHERE NOT is_healthy)
GROUP BY GROUPING SETS ((failure_class, bucket), (bucket))""", "mon2"))
def _(spark, d):
    m = mon2(spark, d).filter(~F.col("is_healthy")).withColumns({"ca": F.col("c") == 1, "cb": F.col("a") == 1})
    return studies.complementarity(m, "failure_class", "ca", "cb", "e").withColumn("third_rate", R("third_rate"))


@query("deciding_step", sql("""
SELECT monitor, user_id, arg_max(t, struct_pack(s := score, n := -t)) AS t, round(max(score), 6) AS score FROM scores GROUP BY ALL""", "scores"))
def _(spark, d):
    return studies.deciding_step(base.scores(spark, d), ["monitor", "user_id"], "t", "score", []).withColumn("score", R("score"))


@query("multi_seed", sql("""
SELECT monitor, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, round(min(m), 6) AS worst FROM (
  SELECT monitor, dataset, avg((alarm_step IS NOT NULL)::INTEGER) AS m FROM alarms GROUP BY ALL) GROUP BY monitor""", "alarms"))
def _(spark, d):
    """Mean, sample spread and worst of a metric over replicates (here corpora)."""
    m = base.alarm_rows(spark, d).groupBy("monitor", "dataset").agg(F.avg(F.col("alarm_step").isNotNull().cast("double")).alias("m"))
    return m.groupBy("monitor").agg(R(F.avg("m")).alias("mean"), R(F.stddev_samp("m")).alias("sd"), R(F.min("m")).alias("worst"))


@query("leave_one_class_out", sql("""
SELECT cls, monitor, round(avg(CASE WHEN NOT is_healthy THEN (outcome = 'true_alarm')::INTEGER END), 6) AS detection,
  round(avg(CASE WHEN is_healthy THEN (outcome = 'false_alarm')::INTEGER END), 6) AS fa
FROM alarms a JOIN (SELECT DISTINCT failure_class AS cls FROM alarms WHERE NOT is_healthy) c ON is_healthy OR failure_class = cls GROUP BY cls, monitor""", "alarms"))
def _(spark, d):
    """Each class with the shared healthy rows (healthy rates computed once)."""
    a = base.alarm_rows(spark, d)
    hit = (F.col("outcome") == "true_alarm").cast("double")
    c = a.filter(~F.col("is_healthy")).groupBy(F.col("failure_class").alias("cls"), "monitor").agg(R(F.avg(hit)).alias("detection"))
    h = a.filter("is_healthy").groupBy("monitor").agg(R(F.avg((F.col("outcome") == "false_alarm").cast("double"))).alias("fa"))
    return c.join(h, "monitor").select("cls", "monitor", "detection", "fa")


@query("class_winners", sql("""
, g AS (SELECT failure_class, monitor, avg((outcome = 'true_alarm')::INTEGER) AS det, avg(coalesce(lead_steps, 0)) AS ld FROM alarms WHERE NOT is_healthy GROUP BY ALL)
SELECT failure_class, arg_max(monitor, struct_pack(d := det, l := ld, m := monitor)) AS winner, round(max(det), 6) AS detection FROM g GROUP BY 1""", "alarms").replace("\n\n,", ",", 1))
def _(spark, d):
    g = base.alarm_rows(spark, d).filter(~F.col("is_healthy")).groupBy("failure_class", "monitor").agg(
        F.avg((F.col("outcome") == "true_alarm").cast("double")).alias("d"), F.avg(F.coalesce("lead_steps", F.lit(0.0))).alias("l"))
    return g.groupBy("failure_class").agg(F.max_by("monitor", F.struct("d", "l", "monitor")).alias("winner"), R(F.max("d")).alias("detection"))


@query("horizon_matched", sql("""
SELECT monitor, count(*) AS n, round(avg(CASE WHEN NOT is_healthy THEN (outcome = 'true_alarm')::INTEGER END), 6) AS detection
FROM alarms WHERE is_healthy OR n_steps - 1 - tau >= 42 GROUP BY monitor""", "alarms"))
def _(spark, d):
    a = base.alarm_rows(spark, d).filter(F.col("is_healthy") | (F.col("n_steps") - 1 - F.col("tau") >= 42))
    hit = (F.col("outcome") == "true_alarm").cast("double")
    return a.groupBy("monitor").agg(F.count(F.lit(1)).alias("n"), R(F.avg(F.when(~F.col("is_healthy"), hit))).alias("detection"))


@query("packet_drop", sql("""
, k AS (SELECT s.user_id, s.t, value, tau, row_number() OVER (PARTITION BY s.user_id ORDER BY s.t) - 1 AS nt FROM steps s JOIN episodes USING (user_id)
  WHERE t = 0 OR t = n_steps - 1 OR """ + U01.format(s="drop", k="s.user_id || ':' || s.t") + """ >= 0.2)
SELECT user_id, count(*)::INTEGER AS n_steps, min(CASE WHEN t >= tau THEN nt END)::INTEGER AS tau, round(sum(value * nt), 4) AS checksum FROM k GROUP BY user_id""",
    "steps", "episodes").replace("\n\n,", ",", 1))
def _(spark, d):
    s = base.steps(spark, d).select("user_id", "t", "value")
    kept, ep = studies.step_drop(s, base.episodes(spark, d), U, "t", 0.2, "drop")
    c = kept.groupBy("user_id").agg(R(F.sum(F.col("value") * F.col("new_t")), 4).alias("checksum"))
    return ep.join(c, "user_id").select("user_id", "n_steps", "tau", "checksum")


@query("replay_channel", sql("""
, dn AS (SELECT user_id FROM episodes WHERE split = 'train' ORDER BY user_id LIMIT 1),
dv AS (SELECT t AS dt, value AS dvv, count(*) OVER () AS dl FROM steps JOIN dn USING (user_id))
SELECT user_id, t, dvv AS replayed FROM steps JOIN dv ON t % dl = dt""", "steps", "episodes").replace("\n\n,", ",", 1))
def _(spark, d):
    s = base.steps(spark, d).select("user_id", "t", "value")
    donor = base.episodes(spark, d).filter("split = 'train'").agg(F.min("user_id").alias("user_id"))
    dv = s.join(F.broadcast(donor), "user_id", "left_semi").select(F.col("t").alias("d_t"), F.col("value").alias("d_value"))
    n = dv.agg(F.count(F.lit(1)).alias("d_len"))
    return studies.replay_channel(s, dv.crossJoin(n), U, "t", "value", "replayed").select("user_id", "t", "replayed")


@query("tamper_flag", sql("""
, v AS (SELECT user_id, stddev_pop(value) AS a, stddev_pop(t % 7) AS b FROM steps GROUP BY user_id),
bd AS (SELECT quantile_cont(a, 0.01) AS qa, quantile_cont(b, 0.01) AS qb FROM v JOIN episodes USING (user_id) WHERE split = 'train')
SELECT user_id, a < qa OR b < qb AS tampered FROM v, bd""", "steps", "episodes").replace("\n\n,", ",", 1))
def _(spark, d):
    s = base.steps(spark, d).select("user_id", F.col("value").alias("a"), (F.col("t") % 7).cast("double").alias("b"))
    tr = s.join(base.episodes(spark, d).filter("split = 'train'").select("user_id"), "user_id", "left_semi")
    return studies.tampered(s, studies.tamper_bounds(tr, U, ["a", "b"]), U, ["a", "b"])


@query("accounting", sql("""
, v AS (SELECT 'ds' || (user_id % 4) AS corpus, injector IS NOT NULL AS inj, CASE WHEN n_steps < 55 THEN false
  WHEN injector IS NOT NULL AND (coalesce(applied_count, 0) = 0 OR first_applied_t >= n_steps - 1) THEN false
  WHEN injector IS NULL AND coalesce(success, false) = false THEN false ELSE true END AS ok FROM attempts)
SELECT corpus, count(*) FILTER (ok) AS accepted, count(*) FILTER (ok AND inj) AS injected, count(*) FILTER (NOT ok) AS rejected, count(*) AS attempted FROM v GROUP BY corpus""",
    "attempts").replace("\n\n,", ",", 1))
def _(spark, d):
    from trajspark.operators import validate
    from trajspark.plans.numeric import attempts
    v = attempts(spark, d).select(F.concat(F.lit("ds"), (F.col("user_id") % 4).cast("string")).alias("corpus"),
                                  F.col("injector").isNotNull().alias("is_injected"), validate.acceptance(55).alias("v"))
    return studies.accounting(v.filter("v = 'accepted'"), v.filter("v <> 'accepted'"), "corpus")


@query("data_card", """
SELECT source, count(*) AS n, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, min(n_chars) AS min_chars, median(n_chars) AS median_chars, max(n_chars) AS max_chars,
  bool_or(n_chars > 10000) AS has_long FROM documents GROUP BY source""")
def _(spark, d):
    t = table(spark, d, "documents").select("source", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    g = t.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"),
                                F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"),
                                F.bool_or(F.col("n_chars") > 10000).alias("has_long"))
    m = ranks.quantiles(t, ["source"], "n_chars", {"median_chars": .5}).drop("n")
    return g.join(m, "source")


@query("rejection_rules", sql("""
, r AS (SELECT 'ds' || (user_id % 4) AS corpus, CASE WHEN n_steps < 55 THEN 'too short' WHEN injector IS NULL AND success = false THEN 'not successful'
  WHEN injector IS NULL AND success IS NULL THEN 'unverified' END AS reason FROM attempts)
SELECT corpus, count(*) FILTER (reason = 'too short') AS too_short, count(*) FILTER (reason = 'not successful') AS not_successful,
  count(*) FILTER (reason = 'unverified') AS unverified, round(avg((reason IS NULL)::INTEGER), 6) AS accept_rate FROM r GROUP BY corpus""", "attempts").replace("\n\n,", ",", 1))
def _(spark, d):
    from trajspark.operators import validate
    from trajspark.plans.numeric import attempts
    v = attempts(spark, d).withColumn("v", validate.acceptance(55)).withColumn(
        "corpus", F.concat(F.lit("ds"), (F.col("user_id") % 4).cast("string")))
    n = lambda r: F.sum((F.col("v") == r).cast("int"))
    return v.groupBy("corpus").agg(n("too short").alias("too_short"), n("not successful").alias("not_successful"),
                                   n("unverified").alias("unverified"), R(F.avg(F.col("v").isin(
                                       "accepted", "never applied", "no following step").cast("double"))).alias("accept_rate"))


cte("audited", (), """
  SELECT conv_id, n_listed, inj, tau, success, n_seen, last, ev, ok_text FROM (
   SELECT conv_id, count(*) AS n_seen, max(turn) AS last, bool_and(trim(text) <> '') AS ok_text,
     bool_or((text LIKE '%the%' OR text LIKE '%une%') AND turn >= 1) AS ev FROM conversations GROUP BY conv_id) s
   JOIN (SELECT conv_id, count(*) + (conv_id % 9 = 0)::INTEGER AS n_listed, conv_id % 2 = 0 AS inj, CASE WHEN conv_id % 2 = 0 AND conv_id % 5 <> 0 THEN 1 END AS tau,
     conv_id % 3 <> 0 AS success FROM conversations GROUP BY conv_id) e USING (conv_id)""")


@query("trace_audit", sql("""
SELECT conv_id, mutation, concat_ws(',', CASE WHEN n_seen <> n_listed THEN 'count_mismatch' END, CASE WHEN inj AND tau IS NULL THEN 'missing_onset' END,
  CASE WHEN inj AND tau >= last THEN 'no_post_onset_step' END, CASE WHEN mutation = 'no_op' THEN 'no_op_injection' END,
  CASE WHEN NOT inj AND NOT success THEN 'unsuccessful_healthy' END) AS defects
FROM (SELECT *, CASE WHEN inj AND tau IS NOT NULL AND ev THEN 'confirmed' WHEN inj AND NOT ok_text THEN 'unverifiable' WHEN inj THEN 'no_op' END AS mutation FROM audited)""", "audited"))
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("t"), "text")
    k = F.col("conv_id")
    e = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", (F.col("n") + (k % 9 == 0).cast("int")).alias("n_listed"), F.when(k % 2 == 0, "looping").alias("failure_class"),
        F.when((k % 2 == 0) & (k % 5 != 0), 1).alias("tau"), (k % 3 != 0).alias("success"))
    return studies.audit(e, c, ["conv_id"], ["the", "une"])


@query("reuse_check", """
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'no provenance' WHEN doc_id % 7 = 0 THEN 'provenance changed' WHEN n_chars > 5000 THEN 'file changed' END AS reason FROM documents""")
def _(spark, d):
    t = table(spark, d, "documents")
    cur = t.select("doc_id", hashing.lf_digest(F.col("text")).alias("digest"), F.sha2(F.concat(F.lit("cfg"), "lang"), 256).alias("fingerprint"))
    old = t.select("doc_id", hashing.lf_digest(F.when(F.col("n_chars") > 5000, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("digest"),
                   F.when(F.col("doc_id") % 10 != 0, F.sha2(F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(
                       F.concat(F.lit("cfg"), "lang")), 256)).alias("fingerprint"))
    return studies.reusable(old, cur, ["doc_id"])


@query("prompt_dedup", """
SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)""")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text")
    one = studies.distinct_by_prompt(t, "text", "doc_id").select("doc_id", F.sha2("text", 256).alias("h"))
    n = t.groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("copies"))
    return one.join(n, "h").select("doc_id", "copies")


@query("judge_report", """
WITH a AS (SELECT doc_id, sha256(text) AS k, toxic AS label, n_chars % 3 <> 0 AS v, lang FROM documents JOIN labels USING (doc_id)),
u AS (SELECT k, min(doc_id) AS doc_id FROM a GROUP BY k), q AS (SELECT a.* FROM a JOIN u USING (doc_id)),
w AS (SELECT lang, 'distinct' AS view_, count(*) FILTER (label = 1) AS np, count(*) FILTER (label = 1 AND v) AS tp, count(*) FILTER (label = 0) AS nn, count(*) FILTER (label = 0 AND v) AS fp FROM q GROUP BY lang
 UNION ALL SELECT lang, 'duplicated', count(*) FILTER (label = 1), count(*) FILTER (label = 1 AND v), count(*) FILTER (label = 0), count(*) FILTER (label = 0 AND v) FROM a GROUP BY lang)
SELECT lang, view_, np, nn, round(CASE WHEN np > 0 THEN tp / np END, 6) AS p_detect, round(CASE WHEN nn > 0 THEN fp / nn END, 6) AS p_false FROM w""")
def _(spark, d):
    """Judge rates on distinct prompts beside the duplicated view."""
    a = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        "doc_id", "lang", "text", F.col("toxic").alias("label"), (F.col("n_chars") % 3 != 0).alias("v"))
    both = studies.distinct_by_prompt(a, "text", "doc_id").withColumn("view_", F.lit("distinct")).unionByName(
        a.withColumn("view_", F.lit("duplicated")))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    g = both.groupBy("lang", "view_").agg(n(F.col("label") == 1).alias("np"), n(F.col("label") == 0).alias("nn"),
                                          n((F.col("label") == 1) & F.col("v")).alias("tp"), n((F.col("label") == 0) & F.col("v")).alias("fp"))
    return g.select("lang", "view_", "np", "nn", R(F.when(F.col("np") > 0, F.col("tp") / F.col("np"))).alias("p_detect"),
                    R(F.when(F.col("nn") > 0, F.col("fp") / F.col("nn"))).alias("p_false"))


@query("balanced_sample", sql("""
, c AS (SELECT s.user_id, s.t, is_healthy, CASE WHEN NOT is_healthy AND s.t >= tau THEN 1 ELSE 0 END AS label,
  """ + U01.format(s="bs", k="s.user_id || ':' || s.t") + """ AS u FROM steps s JOIN episodes USING (user_id)),
o AS (SELECT user_id, label, arg_min(t, u) AS t, min(u) AS u FROM c GROUP BY user_id, label)
SELECT user_id, label, t FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY u) AS r FROM o) WHERE r <= 30""", "steps", "episodes").replace("\n\n,", ",", 1))
def _(spark, d):
    """One random step per episode and label, then n per label."""
    s = base.steps(spark, d).select("user_id", "t").join(base.episodes(spark, d), U).withColumns({
        "label": F.coalesce((~F.col("is_healthy") & (F.col("t") >= F.col("tau"))).cast("int"), F.lit(0)),
        "u": hashing.uniform("bs", F.col("user_id"), F.col("t"))})
    one = s.groupBy("user_id", "label").agg(F.min_by("t", "u").alias("t"), F.min("u").alias("u"))
    w = W.partitionBy("label").orderBy("u")
    return one.withColumn("r", F.row_number().over(w)).filter("r <= 30").select("user_id", "label", "t")


@query("class_gain", sql("""
, g AS (SELECT dataset, CASE WHEN failure_class IN ('c0', 'c1') THEN 'content' ELSE 'behavioral' END AS fam, avg(e) - avg(a) AS gain FROM mon2 WHERE NOT is_healthy GROUP BY ALL)
SELECT dataset, round(max(CASE WHEN fam = 'content' THEN gain END), 6) AS content_gain, round(max(CASE WHEN fam = 'behavioral' THEN gain END), 6) AS behavioral_gain FROM g GROUP BY dataset""", "mon2").replace("\n\n,", ",", 1))
def _(spark, d):
    m = mon2(spark, d).filter(~F.col("is_healthy"))
    content = F.col("failure_class").isin("c0", "c1")
    gain = lambda c: F.avg(F.when(c, F.col("e"))) - F.avg(F.when(c, F.col("a")))
    return m.groupBy("dataset").agg(R(gain(content)).alias("content_gain"), R(gain(~content)).alias("behavioral_gain"))


@query("snapshot_diff", """
SELECT coalesce(a.k, b.k) AS path, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS status
FROM (SELECT 'c/' || c_custkey AS k, c_acctbal AS v FROM customer WHERE c_mktsegment <> 'BUILDING') a
FULL JOIN (SELECT 'c/' || c_custkey AS k, c_acctbal + (c_custkey % 3 = 0)::INTEGER AS v FROM customer WHERE c_mktsegment <> 'MACHINERY') b USING (k)
WHERE a.v IS NULL OR b.v IS NULL OR abs(a.v - b.v) > 0.5""")
def _(spark, d):
    """Two snapshots derived from the whole table: some paths gone, added or moved."""
    c = table(spark, d, "customer")
    k = F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).alias("path")
    a = c.filter("c_mktsegment <> 'BUILDING'").select(k, F.col("c_acctbal").alias("v"))
    b = c.filter("c_mktsegment <> 'MACHINERY'").select(k, (F.col("c_acctbal") + (F.col("c_custkey") % 3 == 0).cast("int")).alias("v"))
    return studies.snapshot_diff(a, b, "path", "v", 0.5)


@query("published_values", """
SELECT k, abs(a - v) <= CASE WHEN a = round(a) THEN 0.0 ELSE greatest(0.0005, abs(a) * 0.005) END AS holds,
  n = p AS count_holds FROM (SELECT o_custkey AS k, avg(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1) JOIN
  (SELECT c_custkey AS k, round(c_acctbal, 1)::DOUBLE AS a, c_nationkey AS p FROM customer) USING (k)""")
def _(spark, d):
    """Two columns of another table as the published numbers: a decimal against a mean, a whole number against a count."""
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.avg("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.round("c_acctbal", 1).cast("double").alias("a"),
                                           F.col("c_nationkey").cast("double").alias("p"))
    j = c.join(p, "k")
    ok = lambda got, e: F.abs(F.col(e) - F.col(got)) <= studies.claim_tolerance(F.col(e))
    return j.select("k", ok("v", "a").alias("holds"), ok("n", "p").alias("count_holds"))


@query("top_per_class", sql("""
SELECT failure_class, user_id, horizon FROM (SELECT failure_class, user_id, n_steps - 1 - tau AS horizon,
  row_number() OVER (PARTITION BY failure_class ORDER BY n_steps - 1 - tau DESC, user_id) AS r FROM episodes WHERE NOT is_healthy) WHERE r <= 2""", "episodes"))
def _(spark, d):
    e = base.episodes(spark, d).filter(~F.col("is_healthy")).withColumn("horizon", F.col("n_steps") - 1 - F.col("tau"))
    w = W.partitionBy("failure_class").orderBy(F.col("horizon").desc(), "user_id")
    return e.withColumn("r", F.row_number().over(w)).filter("r <= 2").select("failure_class", "user_id", "horizon")


@query("frozen_vs_recalibrated", sql("""
, m AS (SELECT dataset, user_id, is_healthy, max_score, split FROM maxima WHERE monitor = 'cusum'),
fz AS (SELECT theta FROM thetas WHERE monitor = 'cusum'),
rc AS (SELECT dataset, max_score AS theta FROM (SELECT dataset, max_score, row_number() OVER (PARTITION BY dataset ORDER BY max_score) - 1 AS i,
  count(*) OVER (PARTITION BY dataset) AS n FROM m WHERE split = 'val') WHERE i = ceil((1 - 0.05) * (n - 1))),
a AS (SELECT 'frozen' AS arm, m.*, theta FROM m, fz WHERE split = 'test' UNION ALL SELECT 'recalibrated', m.*, theta FROM m JOIN rc USING (dataset) WHERE split = 'test')
SELECT arm, dataset, count(*) FILTER (is_healthy) AS n_healthy, count(*) FILTER (is_healthy AND max_score > theta) AS k_fa,
  count(*) FILTER (NOT is_healthy) AS n_injected, count(*) FILTER (NOT is_healthy AND max_score > theta) AS k_alarm FROM a GROUP BY arm, dataset""", "thetas").replace("\n\n,", ",", 1))
def _(spark, d):
    """A threshold carried over beside one fitted per corpus, same held-out runs."""
    m = base.maxima(spark, d).filter("monitor = 'cusum'")
    fz = base.thetas(spark, d).filter("monitor = 'cusum'").select("theta")
    rc = alarms.pick_threshold(m.filter("split = 'val'"), ["dataset"], "max_score").select("dataset", "theta")
    t = m.filter("split = 'test'")
    arms = t.crossJoin(F.broadcast(fz)).withColumn("arm", F.lit("frozen")).unionByName(
        t.join(F.broadcast(rc), "dataset").withColumn("arm", F.lit("recalibrated")), allowMissingColumns=True)
    n = lambda c: F.sum(c.cast("int"))
    h, over = F.col("is_healthy"), F.col("max_score") > F.col("theta")
    return arms.groupBy("arm", "dataset").agg(n(h).alias("n_healthy"), n(h & over).alias("k_fa"),
                                              n(~h).alias("n_injected"), n(~h & over).alias("k_alarm"))


@query("regime_comparison", """
WITH c AS (SELECT source, count(*) FILTER (quality = 0) AS an, count(*) FILTER (quality = 0 AND toxic = 1) AS a, count(*) FILTER (quality = 1) AS bn,
  count(*) FILTER (quality = 1 AND toxic = 1) AS b FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, an, bn, round(CASE WHEN an >= 10 AND bn >= 10 THEN least(1.0, (SELECT sum(CASE WHEN a + b - x <= bn THEN exp(
   lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(an + bn - a - b + 1) - lgamma(an - x + 1)
   - lgamma(bn - a - b + x + 1) - (lgamma(an + bn + 1) - lgamma(an + 1) - lgamma(bn + 1))) ELSE 0 END)
   FROM range(a, least(an, a + b) + 1) t(x))) END, 6) AS p_value FROM c""")
def _(spark, d):
    """Two regimes per label; no p-value under the power floor."""
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    n = lambda c: F.sum(c.cast("int"))
    lo, bad = F.col("quality") == 0, F.col("toxic") == 1
    c = j.groupBy("source").agg(n(lo).alias("an"), n(lo & bad).alias("a"), n(~lo).alias("bn"), n(~lo & bad).alias("b"))
    ok = (F.col("an") >= 10) & (F.col("bn") >= 10)
    return c.select("source", "an", "bn", R(F.when(ok, stats.fisher_p("a", "an", "b", "bn"))).alias("p_value"))


@query("repair_outcomes", sql("""
, r AS (SELECT dataset, rep, is_healthy AS was, """ + U01.format(s="fix", k="user_id || ':' || rep") + """ < 0.7 AS now FROM episodes, range(3) t(rep)),
g AS (SELECT dataset, rep, count(*) FILTER (NOT was AND now) AS recovered, count(*) FILTER (was AND NOT now) AS broken FROM r GROUP BY ALL)
SELECT dataset, round(avg(recovered), 6) AS recovered, round(avg(broken), 6) AS broken, round(avg(recovered - broken), 6) AS net FROM g GROUP BY dataset""", "episodes").replace("\n\n,", ",", 1))
def _(spark, d):
    """Recovered minus broken per repeat, then the mean over repeats."""
    e = paired.replicates(base.episodes(spark, d).select("user_id", "dataset", "is_healthy"), 3)
    now = hashing.uniform("fix", F.col("user_id"), F.col("rep")) < 0.7
    n = lambda c: F.sum(c.cast("int"))
    g = e.groupBy("dataset", "rep").agg(n(~F.col("is_healthy") & now).alias("r"), n(F.col("is_healthy") & ~now).alias("b"))
    return g.groupBy("dataset").agg(R(F.avg("r")).alias("recovered"), R(F.avg("b")).alias("broken"), R(F.avg(F.col("r") - F.col("b"))).alias("net"))


# ------------------------------------------------------------------ event time
@query("tumbling_windows", """
SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def _(spark, d):
    g = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), R(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("day"), "event_type", "n", "total")


@query("session_windows", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, sid""")
def _(spark, d):
    g = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("started"), "n")
