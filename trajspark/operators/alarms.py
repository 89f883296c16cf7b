"""Thresholds at a false-alarm budget, alarms, outcomes and their summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.operators import ranks


def min_calibration_episodes(budget: Column) -> Column:
    """Smallest healthy count at which a budget can be met: ceil(1/b - 1)."""
    return F.ceil(F.lit(1.0) / budget - F.lit(1.0)).cast("int")


def pick_threshold(maxima: DataFrame, group: Sequence[str], score: str,
                   budget: float = 0.05) -> DataFrame:
    """Threshold = element at rank ceil((1-budget)(n-1)) of the episode maxima."""
    q = ranks.quantiles(maxima, group, score, {"theta": 1.0 - budget}, "higher")
    need = min_calibration_episodes(F.lit(float(budget)))
    return q.select(*group, "n", "theta", (F.col("n") >= need).alias("feasible"))


def pick_threshold_lognormal(maxima: DataFrame, group: Sequence[str], score: str,
                             budget: float = 0.05) -> DataFrame:
    """Log-normal tail threshold; the empirical one when no tail can be fitted."""
    group = list(group)
    emp = pick_threshold(maxima, group, score, budget)
    lg = F.when(F.col(score) > 0, F.log(score))
    tail = maxima.groupBy(*group).agg(
        F.count(lg).alias("n_positive"), F.avg(lg).alias("_m"),
        F.stddev_samp(lg).alias("_s"))
    z = ranks.normal_quantile(1.0 - budget)
    usable = (F.col("n_positive") >= 3) & (F.col("_s") > 0)
    return emp.join(tail, group).select(
        *group, "n", "n_positive", F.col("theta").alias("theta_empirical"),
        F.when(usable, F.exp(F.col("_m") + F.col("_s") * F.lit(z)))
        .otherwise(F.col("theta")).alias("theta_lognormal"))


def finite(score: str = "score") -> Column:
    """False for NaN and infinities: such a step was not scored."""
    c = F.col(score)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def first_alarm(scores: DataFrame, thetas: DataFrame, by: Sequence[str],
                keys: Sequence[str], t: str = "t") -> DataFrame:
    """First step with score strictly above the threshold, per episode.

    ``unscored`` is true when any step has a non-finite score; such an episode
    has no alarm verdict at all and callers send it to the rejects.
    """
    j = scores.join(F.broadcast(thetas), list(by)) if by else \
        scores.crossJoin(F.broadcast(thetas))
    return j.groupBy(*by, *keys).agg(
        F.min(F.when(finite() & (F.col("score") > F.col("theta")), F.col(t)))
        .alias("alarm_step"),
        F.max(~finite()).alias("unscored"))


def outcome(alarm: str = "alarm_step") -> Column:
    a = F.col(alarm)
    return F.when(F.col("is_healthy") & a.isNull(), "correct_silence") \
        .when(F.col("is_healthy"), "false_alarm") \
        .when(a.isNull(), "miss") \
        .when(a < F.col("tau"), "early_alarm").otherwise("true_alarm")


def with_outcome(df: DataFrame) -> DataFrame:
    """Outcome, delay, lead and saved share from alarm_step, tau, n_steps."""
    df = df.withColumn("outcome", outcome())
    hit = F.col("outcome") == "true_alarm"
    lead = (F.col("n_steps") - 1 - F.col("alarm_step")).cast("double")
    return df.withColumns({
        "delay": F.when(hit, (F.col("alarm_step") - F.col("tau")).cast("double")),
        "lead_steps": F.when(hit, lead),
        "saved_frac": F.when(hit, lead / (F.col("n_steps") - 1))})


def evaluate(scores: DataFrame, episodes: DataFrame, thetas: DataFrame,
             by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per (by, episode) with its alarm outcome; ``rejects`` gives those with a non-finite score."""
    hits = first_alarm(scores, thetas, by, keys).filter(~F.col("unscored"))
    return with_outcome(hits.drop("unscored").join(episodes, list(keys)))


def rejects(scores: DataFrame, thetas: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(by, episode) pairs that ``evaluate`` can't judge, with the reason."""
    return first_alarm(scores, thetas, by, keys).filter("unscored").select(
        *dict.fromkeys([*by, *keys]), F.lit("a score is not finite").alias("reason"))


def summarize(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Headline metrics per group; empty subsets give null."""
    by = list(by)
    inj, ok = ~F.col("is_healthy"), F.col("is_healthy")
    hit = F.col("outcome") == "true_alarm"
    agg = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.avg(F.when(ok, (F.col("outcome") == "false_alarm").cast("double"))).alias("healthy_fa_rate"),
        F.avg(F.when(inj, (F.col("outcome") == "early_alarm").cast("double"))).alias("early_alarm_rate"),
        F.avg(F.when(inj, hit.cast("double"))).alias("detection_rate"),
        F.avg("saved_frac").alias("mean_budget_saved"),
        F.avg(F.when(inj, F.coalesce("lead_steps", F.lit(0.0)))).alias("mean_lead_all"),
        F.avg(F.when(inj, F.coalesce("saved_frac", F.lit(0.0)))).alias("mean_budget_saved_all"))
    long = rows.filter(hit).select(
        *by, F.explode(F.create_map(F.lit("d"), F.col("delay"), F.lit("l"), F.col("lead_steps")))
        .alias("which", "v"))
    med = ranks.quantiles(long, [*by, "which"], "v", {"m": .5}).groupBy(*by).agg(
        F.max(F.when(F.col("which") == "d", F.col("m"))).alias("median_delay"),
        F.max(F.when(F.col("which") == "l", F.col("m"))).alias("median_lead"))
    if not by:
        return agg.crossJoin(med)
    on = [agg[c].eqNullSafe(med[c]) for c in by]
    return agg.join(med, on, "left").select(
        *[agg[c] for c in by], *[c for c in agg.columns if c not in by],
        "median_delay", "median_lead")


def threshold_sweep(val_maxima: DataFrame, group: Sequence[str], score: str,
                    probs: Sequence[float]) -> DataFrame:
    """One threshold per (group, quantile)."""
    names = {f"q{i}": p for i, p in enumerate(probs)}
    wide = ranks.quantiles(val_maxima, group, score, names, "higher")
    pairs = F.array(*[F.struct(F.lit(i).alias("q_index"), F.lit(float(p)).alias("quantile"),
                               F.col(f"q{i}").alias("theta"))
                      for i, p in enumerate(probs)])
    return wide.select(*group, F.inline(pairs))


def sweep_alarms(scores: DataFrame, sweep: DataFrame, by: Sequence[str],
                 keys: Sequence[str], t: str = "t") -> DataFrame:
    """First alarm at every threshold of a sweep, in one pass over the scores.

    The thresholds ride along as one small array per group and each becomes
    one running minimum of the aggregate; steps are never multiplied.
    """
    ids = [r[0] for r in sweep.select("q_index").distinct().orderBy("q_index").collect()]
    wide = sweep.groupBy(*by).agg(*[
        F.max(F.when(F.col("q_index") == i, F.col("theta"))).alias(f"_th{i}") for i in ids])
    j = scores.join(F.broadcast(wide), list(by))
    hits = j.groupBy(*by, *keys).agg(*[
        F.min(F.when(finite() & (F.col("score") > F.col(f"_th{i}")), F.col(t))).alias(f"_a{i}")
        for i in ids])
    return hits.select(*by, *keys, F.inline(F.array(*[
        F.struct(F.lit(i).alias("q_index"), F.col(f"_a{i}").alias("alarm_step")) for i in ids])))


def precision_recall(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Precision and recall with early alarms counted as false positives."""
    n = lambda *o: F.sum(F.col("outcome").isin(*o).cast("int"))
    c = rows.groupBy(*by).agg(n("true_alarm").alias("tp"),
                              n("false_alarm", "early_alarm").alias("fp"), n("miss").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumns({
        "prec": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0),
        "rec": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)})


def class_auc(maxima: DataFrame, by: Sequence[str], score: str, cls: str) -> DataFrame:
    """AUROC of each failure class against the shared healthy episodes.

    The healthy histogram is built once; a class adds only its own counts.
    """
    by = list(by)
    inj = ~F.col("is_healthy")
    h = ranks.histogram(maxima, by, score, {"q": (~inj).cast("int")})
    pos = maxima.filter(inj).groupBy(*by, F.col(cls).alias("cls"), score).agg(
        F.count(F.lit(1)).alias("p"))
    j = pos.join(h, [*by, score])
    return j.groupBy(*by, "cls").agg(
        F.sum("p").alias("n_pos"), F.max("total_q").alias("n_neg"),
        F.sum(F.col("p") * (F.col("before_q") + F.col("q") / 2.0)).alias("_w")).select(
        *by, "cls", "n_pos", "n_neg", F.when(
            F.col("n_neg") > 0, F.col("_w") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"))


def nested_alarms(maxima: DataFrame, by: Sequence[str], fold: str, k: int, score: str,
                  budget: float) -> DataFrame:
    """Alarm of each episode at a threshold from the other folds' healthy peaks.

    A healthy peak serves the k - 1 folds it is not in; only peaks (one row
    per episode) are repeated, never steps.  An episode of a fold for which the
    others have no healthy peak stays, with a null alarm and the ``reason``.
    """
    by = list(by)
    other = maxima.filter("is_healthy").select(
        *by, score, F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda x: x != F.col(fold))).alias("_k"))
    th = pick_threshold(other, [*by, "_k"], score, budget).select(
        *by, F.col("_k").cast("int").alias(fold), "theta")
    return maxima.join(th, [*by, fold], "left").withColumns({
        "alarm": F.col(score) > F.col("theta"), "reason": F.when(F.col("theta").isNull(), "no threshold")})


# ---- fixed values: healthy runs a deployment needs, and is advised to have
MIN_HEALTHY, RECOMMENDED_HEALTHY = 30, 80


def calibrate_deployments(maxima: DataFrame, by: Sequence[str], key: str, score: str,
                          budget: float = 0.05) -> DataFrame:
    """Threshold per deployment from a fifth of its healthy runs, or a refusal."""
    from trajspark.functions.hashing import uniform
    by = list(by)
    m = maxima.withColumn("_u", uniform("deploy", F.col(key)))
    r = ranks.hash_order(m, by, "_u", "_r")
    lo = F.greatest(F.rint(F.col("_r_total") * 0.6), F.lit(1.0))
    hi = lo + F.greatest(F.rint(F.col("_r_total") * 0.2), F.lit(1.0))
    th = pick_threshold(r.filter((F.col("_r") >= lo) & (F.col("_r") < hi)), by, score, budget) \
        .select(*by, F.col("n").alias("n_val"), "theta")
    n = maxima.groupBy(*by).agg(F.count(F.lit(1)).alias("n_healthy"))
    bad = F.when(F.col("n_healthy") < MIN_HEALTHY, "too few healthy runs") \
        .when(F.col("theta").isNull() | (F.col("theta") <= 0), "degenerate threshold")
    return n.join(th, by, "left").select(
        *by, "n_healthy", "n_val", bad.alias("refused"),
        (F.col("n_healthy") < RECOMMENDED_HEALTHY).alias("warn"),
        F.when(bad.isNull(), F.col("theta")).alias("theta"))


def scaling_curve(calibration: DataFrame, test: DataFrame, by: Sequence[str], key: str, score: str,
                  sizes: Sequence[int], repeats: int, budget: float, seed: str) -> DataFrame:
    """Realised false-alarm rate by number of calibration runs, over repeats.

    Only peaks (one row per run) are repeated.  The test side is a histogram
    of the peaks per group, met by the few thresholds of that group.
    """
    from trajspark.functions.hashing import uniform
    by = list(by)
    reps = calibration.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn(
        "_u", uniform(seed, F.col("rep"), F.col(key)))
    r = ranks.hash_order(reps, [*by, "rep"], "_u", "_r")
    pick = r.withColumn("n_runs", F.explode(F.filter(
        F.array(*[F.lit(n) for n in sizes]), lambda n: F.col("_r") < n)))
    th = pick_threshold(pick, [*by, "rep", "n_runs"], score, budget).select(*by, "rep", "n_runs", "theta")
    h = test.groupBy(*by, F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    over = F.when(F.col("_s") > F.col("theta"), F.col("_n")).otherwise(0)
    j = h.join(F.broadcast(th), by).groupBy(*by, "rep", "n_runs").agg(
        (F.sum(over) / F.sum("_n")).alias("_fa"))
    return j.groupBy(*by, "n_runs").agg(F.avg("_fa").alias("mean_fa"), F.stddev_samp("_fa").alias("sd_fa"))
