"""Study-level tables: joins, accounting, audits, bands, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from trajspark.functions import stats
from trajspark.functions.text import REAL_SOURCES


def check_vs_monitor(findings: DataFrame, episodes: DataFrame, alarmed: DataFrame,
                     keys: Sequence[str]) -> DataFrame:
    """Per label: how many a check flags, a monitor flags, and p against healthy."""
    keys = list(keys)
    f = findings.select(*keys, F.col("step").alias("_s"))
    per = episodes.join(f, keys, "left").groupBy(*keys).agg(
        (F.count("_s") > 0).alias("flagged"),
        F.coalesce(F.bool_or((F.col("_s") >= F.col("tau")) & (F.col("_s") <= F.col("tau") + 1)), F.lit(False)).alias("near"))
    j = episodes.select(*keys, F.coalesce("failure_class", F.lit("healthy")).alias("label")).join(per, keys).join(alarmed, keys)
    n = lambda c: F.sum(F.col(c).cast("int"))
    g = j.groupBy("label").agg(F.count(F.lit(1)).alias("n"), n("flagged").alias("check_flagged"),
                               n("near").alias("within_one_step"), n("alarmed").alias("monitor_alarmed"))
    h = g.filter("label = 'healthy'").select(F.col("n").alias("_hn"), F.col("check_flagged").alias("_hk"))
    return g.crossJoin(F.broadcast(h)).withColumn(
        "p_vs_healthy", stats.fisher_p("check_flagged", "n", "_hk", "_hn")).drop("_hn", "_hk")


def used_real_tools(calls: DataFrame, keys: Sequence[str], names: Sequence[str], shared: str) -> DataFrame:
    """Runs with a real tool call; a shared name counts by source, else by content."""
    real = F.col("source").isin(*REAL_SOURCES) | (F.col("source").isNull() & F.col("content_is_real"))
    hit = F.col("name").isin(*names) & ((F.col("name") != shared) | F.coalesce(real, F.lit(False)))
    return calls.groupBy(*keys).agg(F.bool_or(hit).alias("used_real"))


# -------------------------------------------------- keys, joins and accounting
def first_wins(records: DataFrame, key: Sequence[str], priority: str, payload: Sequence[str]
               ) -> tuple[DataFrame, DataFrame]:
    """(one record per key from the best source, keys whose sources disagree).

    Both come from aggregates that combine before the shuffle; payloads are compared
    themselves, not by hash.
    """
    p = F.struct(*payload)
    g = records.groupBy(*key).agg(
        F.min_by(F.struct(*[c for c in records.columns if c not in key]), F.col(priority)).alias("_r"),
        F.count_distinct(p).alias("_kinds"))
    best = g.select(*key, "_r.*")
    return best, g.filter("_kinds > 1").select(*key, F.col("_kinds").alias("n_versions"))


def aligned(a: DataFrame, b: DataFrame, key: Sequence[str], check: Sequence[str]) -> DataFrame:
    """Inner join of two studies with the number of disagreeing fields."""
    bb = b.select(*key, *[F.col(c).alias(f"_b_{c}") for c in check])
    j = a.join(bb, list(key))
    wrong = F.lit(0)
    for c in check:
        wrong = wrong + (~F.col(c).eqNullSafe(F.col(f"_b_{c}"))).cast("int")
    return j.withColumn("n_disagree", wrong).drop(*[f"_b_{c}" for c in check])


def key_residue(sets: dict[str, DataFrame], key: Sequence[str], corpus: str) -> DataFrame:
    """Per corpus: union, intersection and per-set residue of key sets."""
    marked = None
    for name, df in sets.items():
        m = df.select(corpus, *key).distinct().withColumn("_set", F.lit(name))
        marked = m if marked is None else marked.unionByName(m)
    per = marked.groupBy(corpus, *key).agg(F.count(F.lit(1)).alias("_n"), *[
        F.bool_or(F.col("_set") == s).alias(f"_in_{s}") for s in sets])
    return per.groupBy(corpus).agg(
        F.count(F.lit(1)).alias("n_union"), F.sum((F.col("_n") == len(sets)).cast("int")).alias("n_common"),
        *[F.sum((F.col(f"_in_{s}") & (F.col("_n") == 1)).cast("int")).alias(f"only_{s}") for s in sets])


def band(x: Column, edges: Sequence[int]) -> Column:
    """Right-closed bands: <=a, a+1-b, ..., >=z."""
    out = F.lit(f">={edges[-1] + 1}")
    for i in range(len(edges) - 1, -1, -1):
        name = f"<={edges[i]}" if i == 0 else f"{edges[i - 1] + 1}-{edges[i]}"
        out = F.when(x <= edges[i], name).otherwise(out)
    return out


def banded(rows: DataFrame, by: str, band_col: str, hit: str) -> DataFrame:
    """Rates per band, per corpus and overall, with the band's share of its corpus."""
    g = rows.groupingSets([[by, band_col], [band_col]], by, band_col).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(hit).cast("double")).alias("rate")).select(
        F.coalesce(F.col(by), F.lit("ALL")).alias("arm"), F.col(band_col).alias("band"), "n", "rate")
    w = W.partitionBy("arm")
    return g.select("arm", "band", "n", "rate", (F.col("n") / F.sum("n").over(w)).alias("share"))


def adjacent_contrasts(rows: DataFrame, by: str, band_col: str, hit: str, bands: Sequence[str],
                       min_n: int) -> DataFrame:
    """Rate of each band minus the band before, inside a corpus, with enough rows."""
    wide = rows.groupBy(by).agg(*[x for i, b in enumerate(bands) for x in (
        F.sum((F.col(band_col) == b).cast("int")).alias(f"n{i}"),
        F.avg(F.when(F.col(band_col) == b, F.col(hit).cast("double"))).alias(f"r{i}"))])
    pairs = F.array(*[F.struct(
        F.lit(f"{bands[i + 1]} vs {bands[i]}").alias("contrast"), F.col(f"n{i}").alias("n_low"),
        F.col(f"n{i + 1}").alias("n_high"), (F.col(f"r{i + 1}") - F.col(f"r{i}")).alias("gap"))
        for i in range(len(bands) - 1)])
    return wide.select(by, F.inline(pairs)).filter((F.col("n_low") >= min_n) & (F.col("n_high") >= min_n))


def accounting(accepted: DataFrame, rejected: DataFrame, corpus: str) -> DataFrame:
    """Accepted, injected, rejected and attempted per corpus."""
    a = accepted.groupBy(corpus).agg(F.count(F.lit(1)).alias("accepted"),
                                     F.sum(F.col("is_injected").cast("int")).alias("injected"))
    r = rejected.groupBy(corpus).agg(F.count(F.lit(1)).alias("rejected"))
    z = F.lit(0)
    return a.join(r, corpus, "full_outer").select(
        corpus, F.coalesce("accepted", z).alias("accepted"), F.coalesce("injected", z).alias("injected"),
        F.coalesce("rejected", z).alias("rejected"),
        (F.coalesce("accepted", z) + F.coalesce("rejected", z)).alias("attempted"))


def complementarity(rows: DataFrame, by: str, a: str, b: str, c: str) -> DataFrame:
    """2x2 of who detects what, with a third arm's rate in each cell, plus ALL."""
    cell = F.when(F.col(a) & F.col(b), "both").when(F.col(a), "only_a").when(F.col(b), "only_b").otherwise("neither")
    return rows.withColumn("cell", cell).groupingSets([[by, "cell"], ["cell"]], by, "cell").agg(
        F.coalesce(F.col(by), F.lit("ALL")).alias("arm"), F.col("cell").alias("bucket"),
        F.count(F.lit(1)).alias("n"), F.avg(F.col(c).cast("double")).alias("third_rate")) \
        .select("arm", "bucket", "n", "third_rate")


def deciding_step(scores: DataFrame, keys: Sequence[str], t: str, score: str, carry: Sequence[str]) -> DataFrame:
    """The step of the highest score (earliest on ties) with its features."""
    best = F.max_by(F.struct(t, score, *carry), F.struct(F.col(score), -F.col(t)))
    return scores.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def audit(entries: DataFrame, steps: DataFrame, keys: Sequence[str], markers: Sequence[str]) -> DataFrame:
    """Defect codes of every listed episode.

    entries: keys, n_listed, failure_class, tau, success.  steps: keys, t, text.
    Mutation evidence is a marker in the text at or after the onset.
    """
    keys = list(keys)
    found = F.lit(False)
    for m in markers:
        found = found | F.col("text").contains(m)
    s = steps.join(entries.select(*keys, "tau"), keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_seen"), F.max("t").alias("last"),
        F.bool_or(found & (F.col("t") >= F.col("tau"))).alias("evidence"),
        F.bool_and(F.trim(F.coalesce("text", F.lit(""))) != "").alias("has_text"))
    j = entries.join(s, keys, "left")
    inj = F.col("failure_class").isNotNull()
    mutation = F.when(inj & F.coalesce("evidence", F.lit(False)), "confirmed") \
        .when(inj & ~F.coalesce("has_text", F.lit(False)), "unverifiable").when(inj, "no_op")
    codes = F.array_compact(F.array(
        F.when(F.coalesce("n_seen", F.lit(0)) != F.col("n_listed"), "count_mismatch"),
        F.when(inj & F.col("tau").isNull(), "missing_onset"),
        F.when(inj & (F.col("tau") >= F.col("last")), "no_post_onset_step"),
        F.when(mutation == "no_op", "no_op_injection"),
        F.when(~inj & ~F.coalesce("success", F.lit(False)), "unsuccessful_healthy")))
    return j.select(*keys, mutation.alias("mutation"), F.array_join(codes, ",").alias("defects"))


def reusable(stored: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Why a stored recording may not be reused; null when it may."""
    c = current.select(*keys, F.col("digest").alias("_d"), F.col("fingerprint").alias("_f"))
    j = stored.join(c, list(keys), "left")
    return j.select(*keys, F.when(F.col("_d").isNull(), "file missing")
                    .when(F.col("fingerprint").isNull(), "no provenance")
                    .when(F.col("fingerprint") != F.col("_f"), "provenance changed")
                    .when(F.col("digest") != F.col("_d"), "file changed").alias("reason"))


def distinct_by_prompt(rows: DataFrame, prompt: str, order: str) -> DataFrame:
    """One row per distinct prompt (the first by ``order``)."""
    rest = [c for c in rows.columns]
    return rows.groupBy(F.sha2(prompt, 256).alias("_k")).agg(
        F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select("_r.*")


def snapshot_diff(stored: DataFrame, current: DataFrame, path: str, value: str, tol: float = 0.0) -> DataFrame:
    """added / removed / changed values by path."""
    s = stored.select(path, F.col(value).alias("_s"))
    c = current.select(path, F.col(value).alias("_c"))
    j = s.join(c, path, "full_outer")
    far = F.abs(F.col("_s") - F.col("_c")) > F.lit(tol)
    return j.select(path, F.when(F.col("_s").isNull(), "added").when(F.col("_c").isNull(), "removed")
                    .when(far, "changed").alias("status")).filter("status IS NOT NULL")


def claim_tolerance(expected: Column) -> Column:
    """Tolerance that follows the printed scale: half of the third decimal, or 0.5%; whole numbers are exact."""
    whole = expected == F.round(expected)
    return F.when(whole, 0.0).otherwise(F.greatest(F.lit(0.0005), F.abs(expected) * F.lit(0.005)))


def step_drop(steps: DataFrame, episodes: DataFrame, keys: Sequence[str], t: str, rate: float, seed: str
              ) -> tuple[DataFrame, DataFrame]:
    """Drop steps at random (first and last kept), re-index, shift the onset."""
    from trajspark.functions.hashing import uniform
    from trajspark.operators import ordered
    keys = list(keys)
    e = episodes.select(*keys, "n_steps", "tau")
    s = steps.join(e, keys)
    keep = (F.col(t) == 0) | (F.col(t) == F.col("n_steps") - 1) | (
        uniform(seed, *[F.col(k) for k in keys], F.col(t)) >= F.lit(rate))
    s = s.withColumn("_k", keep.cast("int"))
    s = ordered.running(s, keys, t, {"_i": ordered.Run("sum", "_k")})
    kept = s.filter("_k = 1").withColumn("new_t", (F.col("_i") - 1).cast("int"))
    ep = kept.groupBy(*keys).agg(
        (F.max("new_t") + 1).alias("n_steps"),
        F.coalesce(F.min(F.when(F.col(t) >= F.col("tau"), F.col("new_t"))),
                   F.lit(None).cast("int")).alias("tau"))
    return kept.drop("_k", "_i", "n_steps", "tau"), ep


def replay_channel(steps: DataFrame, donors: DataFrame, keys: Sequence[str], t: str, value: str,
                   out: str) -> DataFrame:
    """Replace a channel by the donor's, on t modulo the donor length.

    donors: keys, donor columns ``d_t``, ``d_len``, ``d_value`` (one healthy run).
    """
    length = donors.agg(F.max("d_len").alias("_d_len"))
    at = steps.crossJoin(F.broadcast(length)).withColumn("_at", F.pmod(F.col(t), F.col("_d_len")))  # one row beside each
    return at.join(donors.select(F.col("d_t").alias("_at"), F.col("d_value").alias(out)), "_at").drop("_at", "_d_len")


def tamper_bounds(healthy: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """1st percentile of the per-run variability of each channel."""
    from trajspark.operators import ranks
    sd = healthy.groupBy(*keys).agg(*[F.stddev_pop(c).alias(c) for c in cols])
    long = sd.select(F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in cols])))
    return ranks.quantiles(long, ["channel"], "v", {"bound": 0.01})


def tampered(runs: DataFrame, bounds: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Runs with a channel flatter than its bound; a deviation that differs from it by rounding alone equals it.

    Null if no channel is flatter and one has no values or no bound.
    """
    sd = runs.groupBy(*keys).agg(*[F.stddev_pop(c).alias(c) for c in cols])
    long = sd.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in cols])))
    flat = F.col("v") < F.col("bound") * F.lit(1.0 - 1e-12)
    return long.join(F.broadcast(bounds.select("channel", "bound")), "channel", "left").groupBy(*keys).agg(
        F.when(F.bool_or(flat), True).when(F.count(flat) == F.count(F.lit(1)), False).alias("tampered"))
