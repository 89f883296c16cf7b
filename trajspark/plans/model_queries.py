"""Queries for the fitted scorers (no SQL form: solves, reservoirs, trees)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajspark.functions import hashing, vector
from trajspark.operators import alarms, fit, grouped, models, ordered, ranks
from trajspark.plans import base
from trajspark.plans.base import U, sql, table
from trajspark.plans.numeric import R
from trajspark.plans.registry import query
from trajspark.plans.textual import vecs
from trajspark.sources import sinks

TYPES = ("view", "click", "purchase", "signup", "error")
D = 7
CORPORA = ["ds0", "ds1", "ds2", "ds3"]  # of ``base.episodes``


def step_vectors(spark, d):
    """Standardised 7-dim steps: value, log gap, one-hot of the event type."""
    done = sinks.known(spark, "vectors", d)
    if done is not None:
        return done
    s = base.steps(spark, d).withColumn("us", ordered.micros("ts"))
    s = ordered.lag(s, U, "t", {"p": "us"})
    gap = F.log(F.greatest(F.coalesce((F.col("us") - F.col("p")) / 1e6, F.lit(1.0)), F.lit(1e-3)))
    s = s.select("user_id", "t", F.array(F.col("value"), gap, *[
        (F.col("event_type") == e).cast("double") for e in TYPES]).alias("x"))
    tr = base.episodes(spark, d).filter("split = 'train'").select("user_id")
    z = models.standardize(s, s.join(tr, "user_id", "left_semi"), "x", D, "z").select("user_id", "t", "z")
    return sinks.materialize(z, "vectors", d)


def parts(spark, d):
    return fit.fit_held_split(base.episodes(spark, d).filter("split = 'train'").select("user_id"), "user_id", "held")


def train(spark, d):
    return step_vectors(spark, d).join(
        base.episodes(spark, d).filter("split = 'train'").select("user_id"), "user_id", "left_semi")


@query("mahalanobis")
def _(spark, d):
    m = models.fit_gaussian(train(spark, d), "z", D)
    return step_vectors(spark, d).select("user_id", "t", R(models.mahalanobis(F.col("z"), m), 5).alias("score"))


@query("delta_mahalanobis")
def _(spark, d):
    v = models.with_delta(step_vectors(spark, d), U, "t", "z", "zd")
    tr = base.episodes(spark, d).filter("split = 'train'").select("user_id")
    m = models.fit_gaussian(v.join(tr, "user_id", "left_semi"), "zd", 2 * D)
    return v.select("user_id", "t", R(models.mahalanobis(F.col("zd"), m), 5).alias("score"))


@query("mahalanobis_embeddings")
def _(spark, d):
    """Fitted on one half of the vectors, scores all."""
    m = models.fit_gaussian(vecs(spark, d).filter(hashing.fold_of(F.col("vec_id"), 2, "emb") == 0), "e", 64)
    return vecs(spark, d).select("vec_id", "label", R(models.mahalanobis(F.col("e"), m), 5).alias("score"))


@query("linear_ar")
def _(spark, d):
    v = step_vectors(spark, d)
    m = models.fit_next_step(v, parts(spark, d), U, "t", "z", D)
    return models.next_step_scores(v, U, "t", "z", D, m).withColumn("score", R("score", 4))


@query("delay_embedding")
def _(spark, d):
    v = step_vectors(spark, d)
    m = models.fit_next_step(v, parts(spark, d), U, "t", "z", D, 2, "zero", True, 1e-2, models.WASHOUT)
    return models.next_step_scores(v, U, "t", "z", D, m, 2, "zero").withColumn("score", R("score", 4))


@query("echo_state")
def _(spark, d):
    """Fused, surprise and disagreement streams of one ensemble."""
    v = step_vectors(spark, d)
    m = models.fit_echo_state(v, parts(spark, d), U, "t", "z", D)
    s = models.echo_state_scores(v, U, "t", "z", m)
    return s.select("user_id", "t", *[R(c, 4).alias(c) for c in ("fused", "surprise", "disagreement")])


@query("echo_state_channel_max")
def _(spark, d):
    """One ensemble per channel, fused by their maximum."""
    v = step_vectors(spark, d)
    m = models.fit_echo_states(v, parts(spark, d), U, "t", "z", {"num": (0, 2, 0), "kind": (2, 5, 1)})
    return models.fused_scores(v, U, "t", "z", m).select("user_id", "t", R(F.greatest("num", "kind"), 4).alias("score"))


@query("conceptor")
def _(spark, d):
    v = step_vectors(spark, d)
    m = models.fit_conceptor(v, parts(spark, d), U, "t", "z", D)
    return models.conceptor_scores(v, U, "t", "z", m).withColumn("score", R("score", 4))


@query("isolation_forest")
def _(spark, d):
    tr = train(spark, d)
    f = models.fit_forest(tr, hashing.uniform("forest", F.col("user_id"), F.col("t")), "z")
    return step_vectors(spark, d).select("user_id", "t", R(models.forest_score(F.col("z"), f), 5).alias("score"))


@query("text_embedding")
def _(spark, d):
    c = models.embed_distinct(table(spark, d, "conversations"), "text", "e")
    return c.select("conv_id", "turn", F.size("e").alias("dims"), R(vector.norm(F.col("e")), 6).alias("norm"))


@query("content_similarity")
def _(spark, d):
    """Query, consecutive and drift dissimilarity of each conversation turn."""
    c = models.embed_distinct(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", "e")
    c = ordered.lag(c, ["conv_id"], "turn", {"p": "e"}).withColumn("turn", F.col("turn").cast("int"))
    dis = F.when(F.col("p").isNull(), 0.0).otherwise(1 - vector.cosine(F.col("e"), F.col("p")))
    s = ordered.ewma(c.withColumn("consec", dis).drop("text", "p"), ["conv_id"], "turn", "consec", "drift", 0.4)
    return s.select("conv_id", "turn", R("consec").alias("consec"), R("drift").alias("drift"))


@query("cross_fit")
def _(spark, d):
    """Every episode scored by a model that saw only healthy runs of the other folds; all models from one pass."""
    v = step_vectors(spark, d).join(base.episodes(spark, d).select("user_id", "is_healthy"), "user_id")
    v = v.withColumn("fold", hashing.fold_of(F.col("user_id"), 2, "xfit"))
    sums = grouped.moments(v.filter("is_healthy"), ["fold"], "z", D)
    m = grouped.solved(grouped.without_folds(sums, [], "fold", 2).filter("i = j"), ["i"], D)
    return grouped.scored(v.withColumn("i", F.col("fold").cast("int")), m, ["i"], "z").select("user_id", "t", "fold", R("score", 5).alias("score"))


@query("transfer_matrix")
def _(spark, d):
    """Fit on each corpus, score every corpus: AUROC of the episode peaks.  All models come from one pass."""
    e = base.episodes(spark, d)
    v = step_vectors(spark, d).join(e.select("user_id", "dataset", "is_healthy"), "user_id")
    m = grouped.solved(grouped.moments(v.filter("is_healthy"), ["dataset"], "z", D), ["dataset"], D).withColumnRenamed("dataset", "fitted_on")
    # every corpus meets every model: that is the matrix
    peaks = grouped.scored(v.withColumn("fitted_on", F.explode(F.array(*map(F.lit, CORPORA)))), m, ["fitted_on"], "z",
                           keep=["user_id", "dataset", "is_healthy", "fitted_on"]).groupBy("user_id", "dataset", "is_healthy", "fitted_on").agg(F.max("score").alias("s"))
    peaks = sinks.materialize(peaks, "transfer_peaks")  # the ranks read it several times
    a = ranks.auc(peaks, ["fitted_on", "dataset"], "s", ~F.col("is_healthy"))
    return a.groupBy("fitted_on").pivot("dataset", CORPORA).agg(R(F.max("auroc"), 5))


@query("deployment_calibration", sql("""
, m AS (SELECT dataset, user_id, max_score, ('0x' || substr(sha256('deploy:' || user_id), 1, 13))::BIGINT AS u FROM maxima WHERE monitor = 'cusum' AND is_healthy),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY u) - 1 AS r, count(*) OVER (PARTITION BY dataset) AS n FROM m),
b AS (SELECT *, greatest(round_even(n * 0.6::DOUBLE, 0), 1) AS lo, greatest(round_even(n * 0.2::DOUBLE, 0), 1) AS w FROM r),
v AS (SELECT dataset, max_score, row_number() OVER (PARTITION BY dataset ORDER BY max_score) - 1 AS i, count(*) OVER (PARTITION BY dataset) AS nv
  FROM b WHERE r >= lo AND r < lo + w),
th AS (SELECT dataset, nv, max_score AS theta FROM v WHERE i = ceil((1 - 0.05) * (nv - 1))),
g AS (SELECT dataset, count(*) AS n_healthy FROM m GROUP BY dataset),
o AS (SELECT g.*, nv, theta, CASE WHEN n_healthy < 30 THEN 'too few healthy runs' WHEN theta IS NULL OR theta <= 0 THEN 'degenerate threshold' END AS refused
  FROM g LEFT JOIN th USING (dataset))
SELECT dataset, n_healthy, nv AS n_val, refused, n_healthy < 80 AS warn, CASE WHEN refused IS NULL THEN round(theta, 6) END AS theta FROM o""", "maxima").replace("\n\n,", ",", 1))
def _(spark, d):
    """Per corpus: refusal under 30 healthy runs, warning under 80, threshold."""
    m = base.maxima(spark, d).filter("monitor = 'cusum' AND is_healthy")
    return alarms.calibrate_deployments(m, ["dataset"], "user_id", "max_score").withColumn("theta", R("theta"))
