import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.operators import signal, supervised


def data(seed=1, runs=60):
    rng = np.random.default_rng(seed)
    rows = []
    for r in range(runs):
        healthy, tau = bool(r % 3), 4
        for t in range(10):
            bad = not healthy and t >= tau
            rows.append((r, t, (rng.normal(size=3) + (1.5 if bad else 0.0)).tolist(), healthy, tau))
    return rows


def newton(x, y):
    x = np.column_stack([x, np.ones(len(x))])
    c = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, own = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1), 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + np.diag(own), x.T @ (c * (p - y)) + own * w)
    return w


def test_all_folds_at_once_equal_one_fit_each(spark):
    rows = data()
    df = spark.createDataFrame(rows, "r int, t int, x array<double>, is_healthy boolean, tau int").repartition(4)
    runs = df.select("r", "is_healthy", "tau").distinct()
    out, folds = supervised.judged(df, runs, "r", "t", "x", 3, 3, "s", 0.2)
    got = {r.r: r for r in out.collect()}
    fold = {r: got[r].fold for r in got}
    x, y = np.array([r[2] for r in rows]), np.array([int(not h and t >= tau) for _, t, _, h, tau in rows])
    of = np.array([fold[r[0]] for r in rows])
    run, healthy = np.array([r[0] for r in rows]), np.array([r[3] for r in rows])
    for f in range(3):
        g = (f + 1) % 3
        w = newton(x[(of != f) & (of != g)], y[(of != f) & (of != g)])
        score = x @ w[:-1] + w[-1]
        peak = {r: score[run == r].max() for r in fold}
        level = sorted(peak[r] for r in fold if fold[r] == g and r % 3)
        theta = level[int(np.ceil(0.8 * (len(level) - 1)))]
        row = next(r for r in folds.collect() if r.fold == f)
        null = [peak[r] > theta for r in fold if fold[r] == f and r % 3]
        assert (row.n_level, row.n_null, row.n_alarms) == (len(level), len(null), sum(null)) and row.theta == pytest.approx(theta)
        for r in fold:
            if fold[r] == f:
                assert got[r].peak == pytest.approx(peak[r], abs=1e-6)
                assert got[r].reason == ("null not clean" if row.refused else None)
                assert got[r].alarm == (None if row.refused else bool(peak[r] > theta))


def test_refusals(spark):
    df = spark.createDataFrame(data(), "r int, t int, x array<double>, is_healthy boolean, tau int")
    runs = df.select("r", "is_healthy", "tau").distinct()
    # a null that is nothing like the level's runs: one fold's healthy runs are shifted
    from trajspark.functions.hashing import fold_of
    far = df.withColumn("x", F.when((fold_of(F.col("r"), 3, "s") == 1) & F.col("is_healthy"), F.transform("x", lambda v: v + 9)).otherwise(F.col("x")))
    out, folds = supervised.judged(far, runs, "r", "t", "x", 3, 3, "s", 0.05)
    bad = {r.fold: r for r in folds.collect()}[1]
    assert bad.refused and bad.p_null < 0.05
    assert {(r.alarm, r.reason) for r in out.filter("fold = 1").collect()} == {(None, "null not clean")}
    calm = df.filter("is_healthy")
    out, _ = supervised.judged(calm, runs.filter("is_healthy"), "r", "t", "x", 3, 3, "s", 0.05)
    assert {(r.alarm, r.reason) for r in out.collect()} == {(None, "no model")}
    with pytest.raises(ValueError):
        supervised.judged(df, runs, "r", "t", "x", 3, 2, "s", 0.05)


def test_channel_shares_add_up(spark):
    rng = np.random.default_rng(3)
    rows = [("a", t, rng.normal(size=4).tolist()) for t in range(40)]
    df = spark.createDataFrame(rows, "k string, t int, v array<double>")
    m, p = [0.1, 0.2, 0.3, 0.4], (np.eye(4) * 2 + 0.5).tolist()
    parts = signal.quadratic_parts(F.col("v"), m, p, {"one": [0, 2], "two": [1], "three": [3]})
    whole = [float((np.array(v) - m) @ np.array(p) @ (np.array(v) - m)) for *_, v in rows]
    got = df.orderBy("t").select(sum(list(parts.values())[1:], parts["one"]).alias("d")).collect()
    np.testing.assert_allclose([r.d for r in got], whole)
    shares = signal.channel_shares(df, ["k"], "t", parts).collect()
    assert len(shares) == 40
    for r in shares:
        assert r.one + r.two + r.three == pytest.approx(1.0) and min(r.one, r.two, r.three) >= 0
    err = signal.ensemble_parts({"e": F.col("v"), "m": F.slice("v", 1, 2)}, {"e": 2.0, "m": 0.5})
    first = df.filter("t = 0").select(*(c.alias(n) for n, c in err.items())).first()
    v = np.array(rows[0][2])
    assert first.e == pytest.approx((v ** 2).mean() / 2) and first.m == pytest.approx((v[:2] ** 2).mean() / 0.5)
