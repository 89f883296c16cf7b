"""Segmented scans equal plain loops, whatever the segment length."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.operators import ordered


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if k == 0 else f"e{k}", t, float(v)) for k in range(4)
            for t, v in enumerate(rng.normal(size=200 if k == 0 else 5 + k))]
    return rows, spark.createDataFrame(rows, "k string, t int, v double")


def by_key(rows):
    out = {}
    for k, t, v in rows:
        out.setdefault(k, []).append(v)
    return out


@pytest.mark.parametrize("seg", [4, 7, 4096])
def test_cusum_and_running(series, seg):
    rows, df = series
    got = ordered.cusum(df, ["k"], "t", "v", "c", 0.2, seg)
    got = ordered.running(got, ["k"], "t", {"s": ordered.Run("sum", "v"), "m": ordered.Run("max", "v", False),
                                            "l": ordered.Run("last", "v", False)}, seg)
    got = {(r.k, r.t): r for r in got.collect()}
    assert len(got) == len(rows)
    for k, vs in by_key(rows).items():
        c = 0.0
        for t, v in enumerate(vs):
            c = max(0.0, c + v - 0.2)
            r = got[(k, t)]
            assert abs(r.c - c) < 1e-9
            assert abs(r.s - sum(vs[:t + 1])) < 1e-9
            assert r.m == (max(vs[:t]) if t else None)
            assert r.l == (vs[t - 1] if t else None)


@pytest.mark.parametrize("seg", [5, None])
@pytest.mark.parametrize("first", [True, False])
def test_ewma(series, seg, first):
    rows, df = series
    got = {(r.k, r.t): r.y for r in ordered.ewma(df, ["k"], "t", "v", "y", 0.35, first, seg).collect()}
    for k, vs in by_key(rows).items():
        y = 0.0
        for t, v in enumerate(vs):
            y = v if first and t == 0 else 0.35 * v + 0.65 * y
            assert abs(got[(k, t)] - y) < 1e-9


@pytest.mark.parametrize("seg", [3, 4096])
def test_lag_crosses_segments(series, seg):
    rows, df = series
    got = {(r.k, r.t): r.p for r in ordered.lag(df, ["k"], "t", {"p": "v"}, 2, seg).collect()}
    for k, vs in by_key(rows).items():
        assert [got[(k, t)] for t in range(len(vs))] == [None, None, *vs[:-2]][:len(vs)]


def test_positions(spark):
    df = spark.createDataFrame([("a", 30, 1), ("a", 10, 2), ("a", 11, 3), ("b", 5, 4), ("a", 30, 0)], "k string, ts int, id int")
    got = {r.id: r.t for r in ordered.positions(df, ["k"], ["ts", "id"], F.floor(F.col("ts") / 10)).collect()}
    assert got == {2: 0, 3: 1, 0: 2, 1: 3, 4: 0}


def test_causal(series):
    """A score never changes when later rows are taken away."""
    _, df = series
    full = {(r.k, r.t): r.c for r in ordered.cusum(df, ["k"], "t", "v", "c", 0.1, 8).collect()}
    cut = ordered.cusum(df.filter("t < 4"), ["k"], "t", "v", "c", 0.1, 8).collect()
    assert all(abs(full[(r.k, r.t)] - r.c) < 1e-12 for r in cut)
