import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.operators import paired


def rows(seed=1, n=300):
    rng = np.random.default_rng(seed)
    return [(k, "ab"[k % 2], float(np.round(rng.normal(), 1)), float(rng.integers(1, 5)), bool(rng.random() < 0.4)) for k in range(n)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(), "k int, g string, x double, y double, pos boolean").repartition(6)


def weights(df, n, seed):
    return {r.k: r.w for r in df.select("k", paired.draws(n, seed, F.col("k")).alias("w")).collect()}


def test_any_column_aggregate(df):
    w = weights(df, 20, "s")
    want = {"mean": lambda x, y, c: (x * c).sum() / c.sum(), "ratio": lambda x, y, c: (x * c).sum() / (y * c).sum(),
            "q": lambda x, y, c: np.quantile(np.repeat(x, c), 0.3), "corr": lambda x, y, c: np.corrcoef(np.repeat(x, c), np.repeat(y, c))[0, 1]}

    def corr(w):
        m = lambda c: F.sum(w * c) / F.sum(w)
        x, y = F.col("x"), F.col("y")
        return (m(x * y) - m(x) * m(y)) / F.sqrt((m(x * x) - m(x) * m(x)) * (m(y * y) - m(y) * m(y)))

    made = {"mean": paired.mean_of("x"), "ratio": paired.ratio_of("x", "y"), "q": paired.quantile_of("x", 0.3), "corr": corr}
    for name, stat in made.items():
        got = {(r.g, r.rep): r.value for r in paired.resampled(df, ["g"], F.col("k"), stat, 20, "s").collect()}
        for g in "ab":
            own = [r for r in rows() if r[1] == g]
            for rep in range(20):
                c = np.array([w[r[0]][rep] for r in own])
                x, y = (np.array([r[i] for r in own]) for i in (2, 3))
                assert got[g, rep] == pytest.approx(want[name](x, y, c)), (name, g, rep)


def test_auc_of_replicates(spark, df):
    w = weights(df, 15, "auc")
    got = {(r.g, r.rep): r.value for r in paired.auc_replicates(df, ["g"], F.col("k"), "x", F.col("pos"), 15, "auc").collect()}
    for g in "ab":
        own = [r for r in rows() if r[1] == g]
        x, p = np.array([r[2] for r in own]), np.array([r[4] for r in own])
        for rep in range(15):
            c = np.array([w[r[0]][rep] for r in own], float)
            wins = (x[p][:, None] > x[~p]) + 0.5 * (x[p][:, None] == x[~p])
            assert got[g, rep] == pytest.approx(c[p] @ wins @ c[~p] / (c[p].sum() * c[~p].sum()))
    one = paired.auc_replicates(df.filter("pos"), [], F.col("k"), "x", F.col("pos"), 3, "auc").collect()
    assert [r.value for r in one] == [None] * 3
    assert paired.auc_replicates(df.limit(0), ["g"], F.col("k"), "x", F.col("pos"), 3, "auc").count() == 0


def test_replicates_of_rows_are_not_shuffled(df):
    """Between the explode and the first exchange stands a partial aggregate."""
    plan = paired.resampled(df, ["g"], F.col("k"), paired.mean_of("x"), 50, "s")._jdf.queryExecution().executedPlan().toString()
    names = [line.strip(" +-:*()0123456789") for line in plan.splitlines()]
    at = next(k for k, x in enumerate(names) if x.startswith("Exchange hashpartitioning(g"))
    below = next(x for x in names[at + 1:] if x.startswith(("HashAggregate", "ObjectHashAggregate", "Generate")))
    assert "partial_sum" in below and any(x.startswith("Generate") for x in names[at + 1:])
    auc = paired.auc_replicates(df, [], F.col("k"), "x", F.col("pos"), 50, "s")._jdf.queryExecution().executedPlan().toString()
    ranged = next(k for k, x in enumerate(auc.splitlines()) if "rangepartitioning" in x)
    assert "Generate" not in "\n".join(auc.splitlines()[ranged:])  # rows are shuffled once, before any replicate is drawn
