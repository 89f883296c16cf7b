from pyspark.sql import functions as F

from trajspark.operators import reports


def test_rates_without_answers_are_null(spark):
    r = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("b", None)], "k string, v boolean")
    got = {x.k: x for x in reports.rates_by(r, ["k"], "v").collect()}
    assert (got["a"].n, got["a"].answered, got["a"].hits, got["a"].rate) == (3, 2, 1, 0.5)
    assert 0.09 < got["a"].low < 0.1 and 0.9 < got["a"].high < 0.91
    assert (got["b"].n, got["b"].answered, got["b"].rate, got["b"].low, got["b"].high) == (1, 0, None, None, None)


def test_sign_test(spark):
    r = spark.createDataFrame([("x", g) for g in (0.1, 0.2, 0.3, 0.4, 0.5, -0.1, 0.0, None)] + [("y", 0.0)], "k string, gap double")
    got = {x.k: (x.n, x.up, x.down, round(x.p_value, 6)) for x in reports.sign_test(r, ["k"], "gap").collect()}
    assert got == {"x": (7, 5, 1, round(2 * 7 / 64, 6)), "y": (1, 0, 0, 1.0)}


def test_correlation_of_pairs(spark):
    r = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (99.0, None), (None, -5.0)], "x double, y double")
    assert abs(r.agg(reports.correlation("x", "y").alias("c")).first().c - 1.0) < 1e-12
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double")
    assert flat.agg(reports.correlation("x", "y").alias("c")).first().c is None


def test_totals_and_identities(spark):
    c = spark.createDataFrame([("a", 3, 1), ("b", 4, None), (None, 10, 10)], "corpus string, accepted int, rejected int")
    t = reports.totals(c, {"own": F.col("corpus").isin("a", "b"), "a": F.col("corpus") == "a", "none": F.col("corpus") == "z"}, ["accepted", "rejected"])
    assert {r.scope: (r.corpora, r.accepted, r.rejected) for r in t.collect()} == {"own": (2, 7, 1), "a": (1, 3, 1), "none": (0, 0, 0)}
    i = reports.identities(t, {"good": ("own.accepted", "a.accepted + a.rejected + a.accepted"), "bad": ("own.accepted", "a.accepted")})
    assert {r.identity: (r.lhs, r.rhs, r.holds) for r in i.collect()} == {"good": (7, 7, True), "bad": (7, 3, False)}


def test_rounding_alone_is_no_tampering(spark):
    """A run whose deviation is the bound but for the last bits, by the order of its rows, is not flatter."""
    from trajspark.operators import studies
    bounds = spark.createDataFrame([("a", 1.974547 * (1 + 4e-16))], "channel string, bound double")
    runs = spark.createDataFrame([(1, 1.974547), (1, -1.974547), (2, 1.97), (2, -1.97)], "u int, a double")
    got = {r.u: r.tampered for r in studies.tampered(runs, bounds, ["u"], ["a"]).collect()}
    assert got == {1: False, 2: True}
