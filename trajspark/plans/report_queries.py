"""Queries for report tables of studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.functions import pricing
from trajspark.operators import reports, studies
from trajspark.plans.base import cte, sql, table
from trajspark.plans.numeric import R
from trajspark.plans.registry import query
from trajspark.plans.study_queries import BAND, BANDS, horizons, mon2


def rounded(df, *exact):
    return df.select(*exact, *[R(c).alias(c) for c in df.columns if c not in exact])


@query("judge_by_class", """
WITH a AS (SELECT doc_id, sha256(text) AS k, source, toxic = 1 AS positive, CASE WHEN n_chars % 5 <> 0 THEN n_chars % 3 <> 0 END AS v FROM documents JOIN labels USING (doc_id)),
q AS (SELECT * FROM a WHERE doc_id IN (SELECT min(doc_id) FROM a GROUP BY k)),
g AS (SELECT source, positive, count(*) AS n, count(v) AS answered, count(*) FILTER (v) AS hits FROM q GROUP BY ALL),
p AS (SELECT *, hits / nullif(answered, 0) AS r, 1.96 * 1.96 AS z FROM g)
SELECT source, positive, n, answered, hits, round(r, 6) AS rate,
  round(CASE WHEN answered > 0 THEN greatest(0, (r + z / (2 * answered) - 1.96 * sqrt(r * (1 - r) / answered + z / (4 * answered * answered))) / (1 + z / answered)) END, 6) AS low,
  round(CASE WHEN answered > 0 THEN least(1, (r + z / (2 * answered) + 1.96 * sqrt(r * (1 - r) / answered + z / (4 * answered * answered))) / (1 + z / answered)) END, 6) AS high FROM p""")
def _(spark, d):
    """Judge rates per class on distinct prompts, with Wilson intervals."""
    a = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        "doc_id", "source", "text", (F.col("toxic") == 1).alias("positive"),
        F.when(F.col("n_chars") % 5 != 0, F.col("n_chars") % 3 != 0).alias("v"))
    g = reports.rates_by(studies.distinct_by_prompt(a, "text", "doc_id"), ["source", "positive"], "v")
    return rounded(g, "source", "positive", "n", "answered", "hits")


@query("judge_spend", """
WITH p AS (SELECT 'seg' || r_regionkey AS model, 1.0 + r_regionkey AS i, 4.0 + r_regionkey AS o FROM region WHERE r_regionkey < 4),
c AS (SELECT model, inp, outp, i IS NOT NULL AND cached <= inp AS ok, ((inp - cached) * i + cached * 0.25 + outp * o) / 1e6 AS usd
 FROM (SELECT 'seg' || (o_custkey % 5) AS model, floor(o_totalprice)::BIGINT AS inp, o_custkey AS outp, o_orderkey * 7 AS cached FROM orders) LEFT JOIN p USING (model))
SELECT model, count(*) FILTER (ok) AS calls, count(*) FILTER (NOT ok) AS refused, coalesce(sum(inp) FILTER (ok), 0)::BIGINT AS in_tok,
  coalesce(sum(outp) FILTER (ok), 0)::BIGINT AS out_tok, round(coalesce(sum(usd) FILTER (ok), 0), 4) AS usd FROM c GROUP BY model""")
def _(spark, d):
    """What the recorded calls of each model cost in all."""
    k = F.col("r_regionkey")
    rates = table(spark, d, "region").filter(k < 4).select(
        F.concat(F.lit("seg"), k.cast("string")).alias("model"), (k + 1.0).alias("in_rate"), F.lit(0.25).alias("cached_rate"), (k + 4.0).alias("out_rate"),
        *[F.lit(None).cast("double").alias(c) for c in ("in_hi", "cached_hi", "out_hi")])
    calls = table(spark, d, "orders").select(
        F.concat(F.lit("seg"), (F.col("o_custkey") % 5).cast("string")).alias("model"), F.floor("o_totalprice").alias("in_tok"),
        F.col("o_custkey").alias("out_tok"), (F.col("o_orderkey") * 7).alias("cached_tok"))
    s = reports.spend(pricing.price_calls(calls, rates), ["model"])
    return s.withColumn("usd", R("usd", 4))


@query("contrast_sign_test", sql(f"""
, b AS (SELECT dataset, {BAND} AS band, c FROM mon2 WHERE NOT is_healthy),
g AS (SELECT dataset, band, count(*) AS n, avg(c) AS r FROM b GROUP BY ALL),
x AS (SELECT h.band || ' vs ' || l.band AS contrast, h.r - l.r AS gap FROM g l JOIN g h ON l.dataset = h.dataset
  AND ((l.band = '<=40' AND h.band = '41-45') OR (l.band = '41-45' AND h.band = '>=46')) WHERE l.n >= 2 AND h.n >= 2),
s AS (SELECT contrast, count(*) AS n, count(*) FILTER (gap > 0) AS up, count(*) FILTER (gap < 0) AS down, avg(gap) AS mean_gap FROM x GROUP BY contrast)
SELECT contrast, n, up, down, round(mean_gap, 6) AS mean_gap, round(least(1.0, 2 * (SELECT sum(exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1)
  - (up + down) * ln(2))) FROM range(0, least(up, down) + 1) t(i))), 6) AS p_value FROM s""", "mon2").replace("\n\n,", ",", 1))
def _(spark, d):
    """Adjacent-band gaps of all corpora in one exact sign test per contrast."""
    c = studies.adjacent_contrasts(horizons(spark, d), "dataset", "band", "c", BANDS, 2)
    return rounded(reports.sign_test(c, ["contrast"], "gap"), "contrast", "n", "up", "down")


cte("gainrows", ("mon2",), """
  SELECT *, failure_class IN ('c0', 'c1') AS content, arm FROM (SELECT *, unnest(['own', CASE WHEN dataset <> 'ds3' THEN 'shared' ELSE 'outside' END]) AS arm
  FROM mon2 WHERE NOT is_healthy)""")
_GAIN = """count(*) AS n, count(*) FILTER (content) AS n_content, count(*) FILTER (NOT content) AS n_other,
  avg(e) FILTER (content) - avg(a) FILTER (content) AS content_gain, avg(e) FILTER (NOT content) - avg(a) FILTER (NOT content) AS other_gain,
  avg(c) FILTER (content) AS stream, 1 - avg(a) FILTER (content) AS headroom"""


_CORR = ("covar_pop({x}, content_gain) / nullif(stddev_pop({x}) FILTER (content_gain IS NOT NULL) "
         "* stddev_pop(content_gain) FILTER ({x} IS NOT NULL), 0)")


def gain_rows(spark, d):
    return mon2(spark, d).filter(~F.col("is_healthy")), F.col("failure_class").isin("c0", "c1")


@query("gain_populations", sql(f"""
SELECT arm, n, n_content, n_other, round(content_gain, 6) AS content_gain, round(other_gain, 6) AS other_gain, round(stream, 6) AS stream, round(headroom, 6) AS headroom
FROM (SELECT arm, {_GAIN} FROM gainrows GROUP BY arm)""", "gainrows"))
def _(spark, d):
    """The same gains over a study's own corpora, those both studies share, and the rest."""
    m, content = gain_rows(spark, d)
    return rounded(reports.gains(reports.populations(m, F.col("dataset") != "ds3"), ["arm"], content, "a", "e", "c"), "arm", "n", "n_content", "n_other")


@query("gain_correlations", sql(f"""
SELECT count(*) AS corpora, round({_CORR.format(x='stream')}, 6) AS r_stream, round({_CORR.format(x='headroom')}, 6) AS r_headroom
FROM (SELECT dataset, {_GAIN} FROM gainrows WHERE arm = 'own' GROUP BY dataset)""", "gainrows"))
def _(spark, d):
    """Does the gain of a corpus follow what the stream sees and what was left to catch?"""
    m, content = gain_rows(spark, d)
    g = reports.gains(m, ["dataset"], content, "a", "e", "c")
    return g.agg(F.count(F.lit(1)).alias("corpora"), R(reports.correlation("stream", "content_gain")).alias("r_stream"),
                 R(reports.correlation("headroom", "content_gain")).alias("r_headroom"))


cte("corpora", ("attempts",), """
  SELECT 'ds' || (user_id % 7) AS corpus, count(*) FILTER (n_steps >= 55) AS accepted, count(*) FILTER (n_steps >= 55 AND injector IS NULL) AS healthy,
    count(*) FILTER (n_steps >= 55 AND injector IS NOT NULL) AS injected, count(*) FILTER (n_steps < 55) AS rejected, count(*) AS attempted FROM attempts GROUP BY 1""")
cte("ctotals", ("corpora",), """
  SELECT scope, count(*) FILTER (o) AS corpora, coalesce(sum(accepted) FILTER (o), 0)::BIGINT AS accepted, coalesce(sum(healthy) FILTER (o), 0)::BIGINT AS healthy,
    coalesce(sum(injected) FILTER (o), 0)::BIGINT AS injected, coalesce(sum(rejected) FILTER (o), 0)::BIGINT AS rejected, coalesce(sum(attempted) FILTER (o), 0)::BIGINT AS attempted
  FROM (SELECT *, unnest(['own', 'v1', 'added', 'imported', 'rejecting']) AS scope FROM corpora),
    LATERAL (SELECT CASE scope WHEN 'own' THEN corpus <> 'ds6' WHEN 'v1' THEN corpus < 'ds4' WHEN 'added' THEN corpus IN ('ds4', 'ds5')
      WHEN 'imported' THEN corpus = 'ds6' ELSE corpus <> 'ds6' AND rejected > 0 END AS o) GROUP BY scope""")
RULES = {"own = healthy + injected": ("own.accepted", "own.healthy + own.injected"),
         "own = v1 + added": ("own.accepted", "v1.accepted + added.accepted"),
         "attempted = accepted + rejected": ("rejecting.attempted", "rejecting.accepted + rejecting.rejected"),
         "v1 healthy + injected of all = own": ("v1.healthy + own.injected", "own.accepted")}


def corpus_totals(spark, d):
    from trajspark.plans.numeric import attempts
    a, ok, inj = attempts(spark, d), F.col("n_steps") >= 55, F.col("injector").isNotNull()
    n = lambda c: F.sum(c.cast("int"))
    c = a.groupBy(F.concat(F.lit("ds"), (F.col("user_id") % 7).cast("string")).alias("corpus")).agg(
        n(ok).alias("accepted"), n(ok & ~inj).alias("healthy"), n(ok & inj).alias("injected"), n(~ok).alias("rejected"), F.count(F.lit(1)).alias("attempted"))
    name = F.col("corpus")
    return reports.totals(c, {"own": name != "ds6", "v1": name < "ds4", "added": name.isin("ds4", "ds5"), "imported": name == "ds6",
                              "rejecting": (name != "ds6") & (F.col("rejected") > 0)},
                          ["accepted", "healthy", "injected", "rejected", "attempted"])


@query("accounting_totals", sql("SELECT * FROM ctotals", "ctotals"))
def _(spark, d):
    """Every quoted total, over the scope it is quoted for."""
    return corpus_totals(spark, d)


@query("accounting_identities", sql("""
, w AS (SELECT max(accepted) FILTER (scope = 'own') AS oa, max(healthy) FILTER (scope = 'own') AS oh, max(injected) FILTER (scope = 'own') AS oi,
  max(accepted) FILTER (scope = 'v1') AS va, max(healthy) FILTER (scope = 'v1') AS vh, max(accepted) FILTER (scope = 'added') AS aa,
  max(attempted) FILTER (scope = 'rejecting') AS ra, max(accepted) FILTER (scope = 'rejecting') AS rc, max(rejected) FILTER (scope = 'rejecting') AS rr FROM ctotals),
r AS (SELECT 'own = healthy + injected' AS identity, oa AS lhs, oh + oi AS rhs FROM w UNION ALL SELECT 'own = v1 + added', oa, va + aa FROM w
  UNION ALL SELECT 'attempted = accepted + rejected', ra, rc + rr FROM w UNION ALL SELECT 'v1 healthy + injected of all = own', vh + oi, oa FROM w)
SELECT identity, lhs, rhs, lhs = rhs AS holds FROM r""", "ctotals").replace("\n\n,", ",", 1))
def _(spark, d):
    """Equations that must balance, and one that does not."""
    return reports.identities(corpus_totals(spark, d), RULES)
