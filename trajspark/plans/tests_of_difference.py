"""Queries for paired tests, stratified tests and interval estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.functions import stats
from trajspark.operators import paired
from trajspark.plans import base
from trajspark.plans.base import cte, sql, table
from trajspark.plans.numeric import R
from trajspark.plans.registry import query

cte("pairs", ("alarms",), """
  SELECT user_id, failure_class, dataset,
    max(CASE WHEN monitor = 'cusum' THEN coalesce(lead_steps, 0) END) AS a,
    max(CASE WHEN monitor = 'absz' THEN coalesce(lead_steps, 0) END) AS b,
    bool_or(monitor = 'cusum' AND outcome = 'true_alarm') AS da,
    bool_or(monitor = 'absz' AND outcome = 'true_alarm') AS db
  FROM alarms WHERE NOT is_healthy GROUP BY ALL""")


def pairs(spark, d):
    """Two monitors side by side per injected episode."""
    a = base.alarm_rows(spark, d).filter(~F.col("is_healthy"))
    lead = F.coalesce("lead_steps", F.lit(0.0))
    hit = F.col("outcome") == "true_alarm"
    return a.groupBy("user_id", "failure_class", "dataset").agg(
        F.max(F.when(F.col("monitor") == "cusum", lead)).alias("a"),
        F.max(F.when(F.col("monitor") == "absz", lead)).alias("b"),
        F.bool_or((F.col("monitor") == "cusum") & hit).alias("da"),
        F.bool_or((F.col("monitor") == "absz") & hit).alias("db"))


@query("perm_test", sql("""
, n AS (SELECT rep, avg(CASE WHEN ('0x' || substr(sha256('sign:' || rep || ':' || user_id), 1, 13))::BIGINT
      / 4503599627370496.0 < 0.5 THEN b - a ELSE a - b END) AS m
  FROM pairs, range(400) r(rep) GROUP BY rep),
o AS (SELECT avg(a - b) AS md, count(*) AS n FROM pairs)
SELECT round(md, 6) AS mean_diff, o.n, round((sum((abs(m) >= abs(md) - 1e-12)::INTEGER) + 1) / 401.0, 6) AS p_value
FROM n, o GROUP BY md, o.n""", "pairs").replace("\n\n,", ",", 1))
def _(spark, d):
    r = paired.sign_flip(pairs(spark, d), [], F.col("user_id"), F.col("a") - F.col("b"), 400, "sign")
    return r.select(R("mean_diff").alias("mean_diff"), "n", R("p_value").alias("p_value"))


@query("wilcoxon_pratt", sql("""
, r AS (SELECT d, ad, rank() OVER (ORDER BY ad) + (count(*) OVER (PARTITION BY ad) - 1) / 2.0 AS rk,
   count(*) OVER (PARTITION BY ad) AS k FROM (SELECT a - b AS d, abs(a - b) AS ad FROM pairs)),
s AS (SELECT count(*)::DOUBLE AS n, sum((d = 0)::INTEGER)::DOUBLE AS z0, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS rp,
   sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS rm, sum(CASE WHEN d <> 0 THEN (k * k - 1) / 2.0 ELSE 0 END) AS tie FROM r)
SELECT n::BIGINT AS n, z0::BIGINT AS n_zero, least(rp, rm)::DOUBLE AS statistic,
  round((least(rp, rm) - (n * (n + 1) - z0 * (z0 + 1)) / 4) /
   sqrt((n * (n + 1) * (2 * n + 1) - z0 * (z0 + 1) * (2 * z0 + 1) - tie) / 24), 6) AS z FROM s""", "pairs").replace("\n\n,", ",", 1))
def _(spark, d):
    return paired.wilcoxon_pratt(pairs(spark, d), [], F.col("a") - F.col("b")).withColumn("z", R("z"))


MC = """CASE WHEN n10 + n01 = 0 OR n10 = n01 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(n10 + n01 + 1) - lgamma(i + 1)
   - lgamma(n10 + n01 - i + 1) - (n10 + n01) * ln(2))) FROM range(least(n10, n01) + 1) r(i))) END"""


@query("mcnemar", sql(f"""
SELECT failure_class, n10, n01, round({MC}, 6) AS p_value FROM (
 SELECT failure_class, count(*) FILTER (da AND NOT db) AS n10, count(*) FILTER (db AND NOT da) AS n01 FROM pairs GROUP BY 1)""", "pairs"))
def _(spark, d):
    return paired.mcnemar(pairs(spark, d), ["failure_class"], F.col("da"), F.col("db")).withColumn("p_value", R("p_value"))


@query("stratified_mcnemar", sql(f"""
, c AS (SELECT fam, sum(n10)::BIGINT AS n10, sum(n01)::BIGINT AS n01 FROM (
  SELECT CASE WHEN failure_class IN ('c0', 'c1') THEN 'content' ELSE 'behavioral' END AS fam, dataset,
   count(*) FILTER (da AND NOT db) AS n10, count(*) FILTER (db AND NOT da) AS n01 FROM pairs GROUP BY ALL) GROUP BY fam),
p AS (SELECT *, {MC} AS p_value FROM c),
h AS (SELECT *, row_number() OVER (ORDER BY p_value, fam) AS i, count(*) OVER () AS m FROM p)
SELECT fam, n10, n01, round(p_value, 6) AS p_value,
  round(max(least(1.0, (m - i + 1) * p_value)) OVER (ORDER BY i), 6) AS p_holm FROM h""", "pairs").replace("\n\n,", ",", 1))
def _(spark, d):
    p = pairs(spark, d).withColumn("fam", F.when(F.col("failure_class").isin("c0", "c1"), "content").otherwise("behavioral"))
    per = paired.mcnemar_counts(p, ["fam", "dataset"], F.col("da"), F.col("db"))
    tot = per.groupBy("fam").agg(F.sum("n10").alias("n10"), F.sum("n01").alias("n01")).withColumn(
        "p_value", stats.mcnemar_p("n10", "n01"))
    return paired.adjust(tot, [], "p_value", ["fam"]).select(
        "fam", "n10", "n01", R("p_value").alias("p_value"), R("p_holm").alias("p_holm"))


@query("within_corr", """
SELECT round(corr(xc, yc), 6) AS r_within, count(DISTINCT source) AS n_strata, count(*) AS n FROM (
 SELECT source, x - avg(x) OVER w AS xc, y - avg(y) OVER w AS yc, count(*) OVER w AS k FROM (
  SELECT source, n_chars::DOUBLE AS x, toxic::DOUBLE AS y FROM documents JOIN labels USING (doc_id))
 WINDOW w AS (PARTITION BY source)) WHERE k >= 2""")
def _(spark, d):
    r = paired.within_corr(labelled(spark, d), [], ["source"], "x", "y")
    return r.withColumn("r_within", R("r_within"))


def labelled(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("x")).join(
        table(spark, d, "labels").select("doc_id", F.col("toxic").cast("double").alias("y")), "doc_id")


@query("stratified_perm", """
WITH b AS (SELECT doc_id, source, n_chars::DOUBLE AS x, toxic::DOUBLE AS y,
   row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents JOIN labels USING (doc_id)),
s AS (SELECT rep, source, x, row_number() OVER (PARTITION BY rep, source ORDER BY
   ('0x' || substr(sha256('sp:' || rep || ':' || doc_id), 1, 13))::BIGINT) AS i FROM b, range(20) r(rep)),
c AS (SELECT rep, source, s.x - avg(s.x) OVER (PARTITION BY rep, source) AS xc, y - avg(y) OVER (PARTITION BY rep, source) AS yc,
   count(*) OVER (PARTITION BY rep, source) AS k FROM b JOIN s USING (source, i)),
n AS (SELECT rep, corr(xc, yc) AS r FROM c WHERE k >= 2 GROUP BY rep),
o AS (SELECT corr(xc, yc) AS r0, count(DISTINCT source) AS n_strata, count(*) AS n FROM (
   SELECT source, x - avg(x) OVER w AS xc, y - avg(y) OVER w AS yc, count(*) OVER w AS k FROM b WINDOW w AS (PARTITION BY source)) WHERE k >= 2)
SELECT round(r0, 6) AS r_within, o.n_strata, o.n, round((sum((abs(r) >= abs(r0) - 1e-12)::INTEGER) + 1) / 21.0, 6) AS p_value
FROM n, o GROUP BY ALL""")
def _(spark, d):
    r = paired.stratified_permutation(labelled(spark, d), "source", F.col("doc_id"), "x", "y", 20, "sp")
    return r.withColumns({"r_within": R("r_within"), "p_value": R("p_value")})


@query("holm_bh", sql(f"""
, c AS (SELECT failure_class, dataset, count(*) FILTER (da AND NOT db) AS n10, count(*) FILTER (db AND NOT da) AS n01
   FROM pairs GROUP BY 1, 2),
p AS (SELECT failure_class, dataset, {MC} AS p FROM c),
h AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p, failure_class) AS i, count(*) OVER (PARTITION BY dataset) AS m FROM p)
SELECT dataset, failure_class, round(p, 6) AS p,
  round(max(least(1.0, (m - i + 1) * p)) OVER (PARTITION BY dataset ORDER BY i), 6) AS p_holm,
  round(least(1.0, min(p * m / i) OVER (PARTITION BY dataset ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_bh
FROM h""", "pairs").replace("\n\n,", ",", 1))
def _(spark, d):
    p = paired.mcnemar(pairs(spark, d), ["failure_class", "dataset"], F.col("da"), F.col("db"))
    a = paired.adjust(p, ["dataset"], "p_value", ["failure_class"])
    return a.select("dataset", "failure_class", R("p_value").alias("p"), R("p_holm").alias("p_holm"), R("p_bh").alias("p_bh"))


@query("select_on_validation", """
SELECT lang, arg_max(source, struct_pack(q := q, n := -c)) AS chosen FROM (
 SELECT lang, source, avg(quality) AS q, CAST(substr(source, 4) AS INTEGER) AS c
 FROM documents JOIN labels USING (doc_id) GROUP BY ALL) GROUP BY lang""")
def _(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    m = j.groupBy("lang", "source").agg(F.avg("quality").alias("q")).withColumn(
        "c", F.substring("source", 4, 10).cast("int"))
    return m.groupBy("lang").agg(F.max_by("source", F.struct("q", (-F.col("c")).alias("n"))).alias("chosen"))


@query("fisher_exact", """
WITH c AS (SELECT lang, sum(toxic)::BIGINT AS a, count(*) AS an FROM documents JOIN labels USING (doc_id) GROUP BY lang),
r AS (SELECT sum(a)::BIGINT AS ta, sum(an)::BIGINT AS tn FROM c),
f AS (SELECT lang, a, an, ta - a AS b, tn - an AS bn FROM c, r)
SELECT lang, a AS hits, an AS n, round(least(1.0, (SELECT sum(CASE WHEN a + b - x <= bn THEN exp(
   lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(an + bn - a - b + 1) - lgamma(an - x + 1)
   - lgamma(bn - a - b + x + 1) - (lgamma(an + bn + 1) - lgamma(an + 1) - lgamma(bn + 1))) ELSE 0 END)
   FROM range(a, least(an, a + b) + 1) t(x))), 6) AS p_value FROM f""")
def _(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    c = j.groupBy("lang").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("an"))
    tot = c.agg(F.sum("a").alias("ta"), F.sum("an").alias("tn"))
    f = c.crossJoin(F.broadcast(tot))
    p = stats.fisher_p(F.col("a"), F.col("an"), F.col("ta") - F.col("a"), F.col("tn") - F.col("an"))
    return f.select("lang", F.col("a").alias("hits"), F.col("an").alias("n"), R(p).alias("p_value"))


@query("wilson_interval", """
SELECT source, k, n, round(greatest(0, (p + zz / (2 * n)) / d - h), 6) AS low, round(least(1, (p + zz / (2 * n)) / d + h), 6) AS high FROM (
 SELECT *, 1 + zz / n AS d, 1.96 * sqrt(p * (1 - p) / n + zz / (4.0 * n * n)) / (1 + zz / n) AS h FROM (
  SELECT source, sum(toxic)::BIGINT AS k, count(*) AS n, sum(toxic) / count(*)::DOUBLE AS p, 1.96::DOUBLE * 1.96 AS zz
  FROM documents JOIN labels USING (doc_id) GROUP BY source))""")
def _(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    c = j.groupBy("source").agg(F.sum("toxic").alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return c.select("source", "k", "n", R(lo).alias("low"), R(hi).alias("high"))


@query("exact_interval")
def _(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    c = j.groupBy("source").agg(F.sum("toxic").alias("k"), F.count(F.lit(1)).alias("n"))
    return c.withColumn("ci", stats.exact_interval("k", "n")).select(
        "source", "k", "n", R("ci.low").alias("low"), R("ci.high").alias("high"))


CP = ("CASE " + " ".join(f"WHEN u < {v!r} THEN {k}" for k, v in enumerate(paired._POISSON)) + f" ELSE {len(paired._POISSON)} END")


@query("bootstrap_mean", sql(f"""
, w AS (SELECT monitor, rep, v, {CP} AS w FROM (SELECT monitor, rep, coalesce(lead_steps, 0) AS v,
   ('0x' || substr(sha256('boot:' || rep || ':' || user_id), 1, 13))::BIGINT / 4503599627370496.0 AS u
   FROM alarms, range(200) r(rep) WHERE NOT is_healthy)),
s AS (SELECT monitor, rep, sum(w * v) / sum(w) AS s FROM w WHERE w > 0 GROUP BY monitor, rep)
SELECT monitor, count(*) AS n_rep, round(quantile_cont(s, 0.025), 6) AS ci_low, round(quantile_cont(s, 0.975), 6) AS ci_high FROM s GROUP BY monitor""",
    "alarms").replace("\n\n,", ",", 1))
def _(spark, d):
    a = base.alarm_rows(spark, d).filter(~F.col("is_healthy"))
    b = paired.bootstrap(a, ["monitor"], F.col("user_id"), F.coalesce("lead_steps", F.lit(0.0)), 200, "boot")
    return b.select("monitor", "n_rep", R("ci_low").alias("ci_low"), R("ci_high").alias("ci_high"))


@query("bootstrap_median", sql(f"""
, w AS (SELECT monitor, rep, user_id, v, {CP} AS w FROM (SELECT monitor, rep, user_id, lead_steps AS v,
   ('0x' || substr(sha256('bmed:' || rep || ':' || user_id), 1, 13))::BIGINT / 4503599627370496.0 AS u
   FROM alarms, range(100) r(rep) WHERE lead_steps IS NOT NULL)),
s AS (SELECT monitor, rep, median(v) AS s FROM (SELECT monitor, rep, v, unnest(range(w)) FROM w WHERE w > 0) GROUP BY monitor, rep)
SELECT monitor, count(*) AS n_rep, round(quantile_cont(s, 0.025), 6) AS ci_low, round(quantile_cont(s, 0.975), 6) AS ci_high FROM s GROUP BY monitor""",
    "alarms").replace("\n\n,", ",", 1))
def _(spark, d):
    b = paired.bootstrap(base.alarm_rows(spark, d), ["monitor"], F.col("user_id"), F.col("lead_steps"), 100, "bmed", "median")
    return b.select("monitor", "n_rep", R("ci_low").alias("ci_low"), R("ci_high").alias("ci_high"))


@query("bootstrap_auc_gap", sql(f"""
, e AS (SELECT user_id, NOT any_value(is_healthy) AS pos, max(CASE WHEN monitor = 'cusum' THEN max_score END) AS a,
   max(CASE WHEN monitor = 'absz' THEN max_score END) AS b FROM maxima WHERE split = 'test' GROUP BY user_id),
w AS (SELECT rep, pos, a, b, {CP} AS w FROM (SELECT *, ('0x' || substr(sha256('auc:' || rep || ':' || user_id), 1, 13))::BIGINT
   / 4503599627370496.0 AS u FROM e, range(40) r(rep))),
l AS (SELECT rep, 'a' AS m, pos, a AS s, w FROM w WHERE w > 0 UNION ALL SELECT rep, 'b', pos, b, w FROM w WHERE w > 0),
h AS (SELECT rep, m, s, sum(CASE WHEN pos THEN w ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN pos THEN 0 ELSE w END)::DOUBLE AS q FROM l GROUP BY ALL),
c AS (SELECT rep, m, sum(p * (cq - q / 2)) / (sum(p) * sum(q)) AS auc FROM (
   SELECT *, sum(q) OVER (PARTITION BY rep, m ORDER BY s) AS cq FROM h) GROUP BY rep, m),
g AS (SELECT rep, max(CASE WHEN m = 'a' THEN auc END) - max(CASE WHEN m = 'b' THEN auc END) AS s FROM c GROUP BY rep)
SELECT count(*) AS n_rep, round(quantile_cont(s, 0.025), 6) AS ci_low, round(quantile_cont(s, 0.975), 6) AS ci_high FROM g""",
    "maxima").replace("\n\n,", ",", 1))
def _(spark, d):
    m = base.maxima(spark, d).filter("split = 'test'").groupBy("user_id", "is_healthy").agg(
        F.max(F.when(F.col("monitor") == "cusum", F.col("max_score"))).alias("a"),
        F.max(F.when(F.col("monitor") == "absz", F.col("max_score"))).alias("b"))
    b = paired.bootstrap_auc_gap(m, F.col("user_id"), "a", "b", ~F.col("is_healthy"), 40, "auc")
    return b.select("n_rep", R("ci_low").alias("ci_low"), R("ci_high").alias("ci_high"))


@query("bootstrap_ratio", sql(f"""
, w AS (SELECT monitor, rep, n_steps, lead_steps, {CP} AS w FROM (SELECT monitor, rep, n_steps, lead_steps,
   ('0x' || substr(sha256('brat:' || rep || ':' || user_id), 1, 13))::BIGINT / 4503599627370496.0 AS u
   FROM alarms, range(100) r(rep) WHERE lead_steps IS NOT NULL)),
s AS (SELECT monitor, rep, sum(w * lead_steps) / sum(w * n_steps) AS s FROM w WHERE w > 0 GROUP BY monitor, rep)
SELECT monitor, count(*) AS n_rep, round(quantile_cont(s, 0.05), 6) AS ci_low, round(quantile_cont(s, 0.95), 6) AS ci_high FROM s GROUP BY monitor""",
    "alarms").replace("\n\n,", ",", 1))
def _(spark, d):
    """Interval of a statistic that the caller writes as a Column aggregate: lead steps per step."""
    b = paired.bootstrap(base.alarm_rows(spark, d), ["monitor"], F.col("user_id"), F.col("lead_steps"), 100, "brat", paired.ratio_of("lead_steps", "n_steps"), 0.9)
    return b.select("monitor", "n_rep", R("ci_low").alias("ci_low"), R("ci_high").alias("ci_high"))


@query("clustered_perm_test", sql("""
, c AS (SELECT user_id, max(CASE WHEN arm = 'purchase' THEN m END) - max(CASE WHEN arm = 'click' THEN m END) AS d FROM (
   SELECT user_id, event_type AS arm, avg((value > 40)::INTEGER) AS m FROM steps
   WHERE event_type IN ('purchase', 'click') GROUP BY ALL) GROUP BY user_id HAVING d IS NOT NULL),
n AS (SELECT rep, avg(CASE WHEN ('0x' || substr(sha256('clus:' || rep || ':' || user_id), 1, 13))::BIGINT
   / 4503599627370496.0 < 0.5 THEN -d ELSE d END) AS m FROM c, range(200) r(rep) GROUP BY rep),
o AS (SELECT avg(d) AS md, count(*) AS n FROM c)
SELECT round(md, 6) AS mean_diff, o.n, round((sum((abs(m) >= abs(md) - 1e-12)::INTEGER) + 1) / 201.0, 6) AS p_value FROM n, o GROUP BY md, o.n""",
    "steps").replace("\n\n,", ",", 1))
def _(spark, d):
    """Repeats are averaged per episode and arm before the paired test."""
    s = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "click")).select(
        "user_id", F.col("event_type").alias("arm"), (F.col("value") > 40).cast("double").alias("ok"))
    r = paired.clustered_sign_flip(s, "user_id", "arm", "ok", "purchase", "click", 200, "clus")
    return r.select(R("mean_diff").alias("mean_diff"), "n", R("p_value").alias("p_value"))


@query("chi_square_mix", """
WITH c AS (SELECT lang AS arm, 'q' || quality || 't' || toxic AS cls, count(*)::DOUBLE AS o FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
g AS (SELECT a.arm, k.cls, coalesce(c.o, 0) AS o FROM (SELECT DISTINCT arm FROM c) a CROSS JOIN (SELECT DISTINCT cls FROM c) k
   LEFT JOIN c ON c.arm = a.arm AND c.cls = k.cls),
e AS (SELECT *, sum(o) OVER (PARTITION BY arm) * sum(o) OVER (PARTITION BY cls) / sum(o) OVER () AS e FROM g)
SELECT round(sum((o - e) * (o - e) / e), 6) AS chi2,
  ((count(DISTINCT arm) - 1) * (count(DISTINCT cls) - 1))::BIGINT AS dof FROM e""")
def _(spark, d):
    j = table(spark, d, "documents").select("doc_id", F.col("lang").alias("arm")).join(table(spark, d, "labels"), "doc_id")
    j = j.withColumn("cls", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")))
    return paired.chi_square(j, "arm", "cls").select(R("chi2").alias("chi2"), "dof")


@query("chi_square_p")
def _(spark, d):
    j = table(spark, d, "documents").select("doc_id", F.col("lang").alias("arm")).join(table(spark, d, "labels"), "doc_id")
    c = paired.chi_square(j.withColumn("cls", F.col("toxic")), "arm", "cls")
    return c.select("chi2", "dof", stats.chi2_p("chi2", "dof").alias("p_value"))


@query("paired_contrasts", sql("""
, p AS (SELECT user_id, metric, a, b, a - b AS d FROM (
  SELECT user_id, 'lead' AS metric, a, b FROM pairs UNION ALL SELECT user_id, 'detected', da::INTEGER, db::INTEGER FROM pairs)),
o AS (SELECT metric, avg(a) AS am, avg(b) AS bm, avg(d) AS md, sum((d > 0)::INTEGER)::BIGINT AS wins, count(*) AS n FROM p GROUP BY metric),
nl AS (SELECT metric, rep, avg(CASE WHEN ('0x' || substr(sha256('ctr:' || rep || ':' || user_id), 1, 13))::BIGINT
   / 4503599627370496.0 < 0.5 THEN -d ELSE d END) AS m FROM p, range(200) r(rep) GROUP BY ALL),
pv AS (SELECT metric, (sum((abs(m) >= abs(md) - 1e-12)::INTEGER) + 1) / 201.0 AS pp FROM nl JOIN o USING (metric) GROUP BY metric),
h AS (SELECT *, row_number() OVER (ORDER BY pp, metric) AS i, count(*) OVER () AS mm FROM pv),
bw AS (SELECT metric, rep, d, """ + CP + """ AS w FROM (SELECT metric, rep, d, ('0x' || substr(sha256('ctr-ci:' || rep || ':' || user_id), 1, 13))::BIGINT
   / 4503599627370496.0 AS u FROM p, range(200) r(rep) WHERE d IS NOT NULL)),
bs AS (SELECT metric, rep, sum(w * d) / sum(w) AS s FROM bw WHERE w > 0 GROUP BY metric, rep),
ci AS (SELECT metric, round(quantile_cont(s, 0.025), 6) AS ci_low, round(quantile_cont(s, 0.975), 6) AS ci_high FROM bs GROUP BY metric)
SELECT metric, round(am, 6) AS a_mean, round(bm, 6) AS b_mean, round(md, 6) AS mean_diff, wins, o.n, ci_low, ci_high,
  round(pp, 6) AS p_value, round(max(least(1.0, (mm - i + 1) * pp)) OVER (ORDER BY i), 6) AS p_holm
FROM h JOIN o USING (metric) JOIN ci USING (metric)""", "pairs").replace("\n\n,", ",", 1))
def _(spark, d):
    p = pairs(spark, d)
    long = p.select("user_id", F.inline(F.array(
        F.struct(F.lit("lead").alias("metric"), F.col("a").alias("a"), F.col("b").alias("b")),
        F.struct(F.lit("detected").alias("metric"), F.col("da").cast("double").alias("a"), F.col("db").cast("double").alias("b")))))
    r = paired.contrasts(long, ["metric"], F.col("user_id"), "a", "b", 200, "ctr")
    return r.select("metric", *[R(c).alias(c) for c in ("a_mean", "b_mean", "mean_diff", "ci_low", "ci_high")], "wins", "n",
                    R("p_value").alias("p_value"), R("p_holm").alias("p_holm"))
