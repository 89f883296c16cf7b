import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.operators import alarms, grouped, models

D = 3


def steps(spark, seed=1, runs=90, deployments=("a", "b", None)):
    rng = np.random.default_rng(seed)
    rows = []
    for r in range(runs):
        g = deployments[r % len(deployments)] if r else "tiny"
        shift = {"a": 0.0, "b": 3.0, None: -2.0, "tiny": 0.0}[g]
        for t in range(int(rng.integers(5, 20))):
            rows.append((g, r, t, (rng.normal(size=D) @ np.array([[1, .5, 0], [0, 1, .2], [0, 0, 2]]) + shift).tolist(), r % 5 != 0))
    return rows, spark.createDataFrame(rows, "g string, run int, t int, v array<double>, is_healthy boolean").repartition(5)


def test_one_pass_gives_the_models_of_each_group(spark):
    rows, df = steps(spark)
    df = df.unionByName(spark.createDataFrame([("a", 1, 99, None, True)], df.schema))
    fits = {r.g: r for r in grouped.solved(grouped.moments(df, ["g"], "v", D), ["g"], D).collect()}
    assert fits.keys() == {"a", "b", None, "tiny"}
    for g, r in fits.items():
        x = np.array([v for a, _, _, v, _ in rows if a == g])
        np.testing.assert_allclose(r["mean"], x.mean(0), atol=1e-9)
        np.testing.assert_allclose(np.reshape(r["cov"], (D, D)), np.cov(x.T, bias=True), atol=1e-9)
        one = models.fit_gaussian(df.where(F.col("g").eqNullSafe(F.lit(g)) & F.col("v").isNotNull()), "v", D)
        np.testing.assert_allclose(np.reshape(r["precision"], (D, D)), one.precision, rtol=1e-6)
        assert r["shrinkage"] == pytest.approx(one.shrinkage, abs=1e-9) and r["n_rows"] == len(x)
    got = grouped.scored(df, grouped.solved(grouped.moments(df, ["g"], "v", D), ["g"], D).where("g = 'a'"), ["g"], "v").collect()
    assert len(got) == len(rows) + 1
    a = fits["a"]
    for r in got:
        if r.g != "a" or r.v is None:
            assert r.score is None
        else:
            x = np.array(r.v) - a["mean"]
            assert r.score == pytest.approx(np.sqrt(x @ np.reshape(a["precision"], (D, D)) @ x))


def test_deployments_get_a_model_or_a_reason(spark, monkeypatch):
    monkeypatch.setattr(alarms, "MIN_HEALTHY", 10)
    rows, df = steps(spark)
    df = df.where("is_healthy OR g = 'tiny'").fillna("none", ["g"])
    runs = df.select("g", "run").distinct()
    out = {r.g: r for r in grouped.calibrated(df, runs, ["g"], "run", "v", D).collect()}
    assert out["tiny"].refused == "too few healthy runs" and out["tiny"].theta is None and out["tiny"]["mean"] is None
    for g in ("a", "b", "none"):
        r = out[g]
        assert r.refused is None and r.warn and r.theta > 0 and r.n_val == round(0.2 * r.n_healthy)
        assert len(r.precision) == D * D


def test_no_score_or_threshold_saw_the_run(spark):
    rows, df = steps(spark, 2, 60)
    runs = df.groupBy("run").agg(F.any_value("is_healthy").alias("is_healthy"))
    out = {r.run: r for r in grouped.nested(df, runs, "run", "v", D, 3, "n", 0.2).collect()}
    healthy = {r: h for _, r, _, _, h in rows}
    fold = {r: x.fold for r, x in out.items()}
    x = {r: np.array([v for _, a, _, v, _ in rows if a == r]) for r in healthy}

    def peak(run, without):
        fit = np.vstack([x[r] for r in x if healthy[r] and fold[r] not in without])
        m, _, p, _ = grouped.gaussian(grouped._sums(fit), D)
        d = x[run] - m
        return np.sqrt(((d @ p) * d).sum(1)).max()

    for k in range(3):
        inner = sorted(peak(r, (k, fold[r])) for r in x if healthy[r] and fold[r] != k)
        theta = inner[int(np.ceil((1 - 0.2) * (len(inner) - 1)))]
        for r in x:
            if fold[r] == k:
                assert out[r].theta == pytest.approx(theta) and out[r].peak == pytest.approx(peak(r, (k,)))
                assert out[r].alarm == (out[r].peak > out[r].theta) and out[r].reason is None
    alone = df.where(F.col("run") == 5).withColumn("is_healthy", F.lit(True))
    lost = grouped.nested(alone, alone.select("run", "is_healthy").distinct(), "run", "v", D, 3, "n", 0.2).collect()
    assert [(r.run, r.alarm, r.reason) for r in lost] == [(5, None, "no model")]


def test_scores_give_out_only_what_is_asked_for(spark):
    rows = [("a", 1, [3.0, 4.0]), ("a", 2, None), (None, 3, [0.0, 2.0]), ("c", 4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "g string, i int, v array<double>")
    m = spark.createDataFrame([("a", [0.0, 0.0], [1.0, 0.0, 0.0, 1.0]), (None, [0.0, 1.0], [4.0, 0.0, 0.0, 4.0])],
                              "g string, mean array<double>, precision array<double>")
    s = grouped.scored(df, m, ["g"], "v", keep=["i"])
    assert s.columns == ["i", "score"]
    assert {r.i: r.score for r in s.collect()} == {1: 5.0, 2: None, 3: 2.0, 4: None}
    assert {(r.g, r.i, r.v and tuple(r.v)): r.score for r in grouped.scored(df, m, ["g"], "v").collect()} == {
        ("a", 1, (3.0, 4.0)): 5.0, ("a", 2, None): None, (None, 3, (0.0, 2.0)): 2.0, ("c", 4, (1.0, 1.0)): None}


def test_runs_without_values_are_neither_flat_nor_not(spark):
    from trajspark.operators import studies
    runs = spark.createDataFrame([(u, None if u == 1 else u * x, (x if u != 2 else 0.0)) for u in (1, 2, 3) for x in (0.0, 1.0)] + [(4, None, 5.0)],
                                 "u int, a double, b double")
    bounds = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "channel string, bound double")
    got = lambda b: {r.u: r.tampered for r in studies.tampered(runs, b, ["u"], ["a", "b"]).collect()}
    assert got(bounds) == {1: None, 2: True, 3: False, 4: True}
    assert got(bounds.filter("channel = 'b'")) == {1: None, 2: True, 3: None, 4: True}
