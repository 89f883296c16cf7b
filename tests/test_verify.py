import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from trajspark.functions import money, stats, text
from trajspark.operators import verify
from trajspark.operators.verify import LineItem, TaskSpec

SPEC = TaskSpec(line_items=(LineItem("lookup_flight", 1, 4), LineItem("lookup_hotel", 2, 3)),
                required_tools=("get_weather",), combining_tools=("calculator",),
                result_contracts=(("lookup_flight", r"\$\d+(\.\d+)?|No route found.*"),))


def run(spark, flights, hotels, said, weather=True):
    calls = [("lookup_flight", f"f{i}", f"${v}") for i, v in enumerate(flights)]
    calls += [("lookup_hotel", k, f"${v}/night") for k, v in hotels]
    calls += [("get_weather", "w", "rainy")] if weather else []
    rows = [("e", t, n, a, r, False, True) for t, (n, a, r) in enumerate(calls)]
    c = spark.createDataFrame(rows, "e string, t int, name string, args_key string, result string, is_error boolean, has_result boolean")
    st = spark.createDataFrame([("e", f"the grand total is ${said} USD" if said else "done")], "e string, x string").select(
        "e", money.stated_total(F.col("x")).alias("stated"))
    return verify.total_consistency(c, st, ["e"], "t", SPEC).first(), verify.verify(c, st, ["e"], "t", SPEC).first()


def test_booking_cases(spark):
    f, h = (100, 200, 300, 400), (("a", 10), ("b", 20), ("c", 30))
    t, v = run(spark, f, h, 1120)
    assert t.recomputed == 1120 and t.verdict == "ok" and not v.failed and v.checked
    assert run(spark, f, h, 4935)[1].failed_checks == "total_consistency"
    assert run(spark, f[:3], h, 720)[1].failed_checks == "required_coverage"
    assert not run(spark, f, (*h, ("a", 10)), 1120)[1].failed          # re-queried hotel
    assert not run(spark, (*f, 999), h, 1120)[1].failed                # an unused extra lookup
    assert run(spark, f, h, None)[0].verdict == "no_total"
    assert run(spark, f, h, 1120, weather=False)[1].failed_checks == "required_coverage"


def test_money(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = F.lit
    assert one(money.refused_figure(lit("total $100"))) is None
    assert one(money.refused_figure(lit("total €100"))) == "€100"
    assert one(money.refused_figure(lit("costs 250 EUR"))) == "250 EUR"
    assert one(money.refused_figure(lit("a EUROPEAN trip, section 100 EURekas"))) is None
    assert one(money.stated_total(lit("Total flight cost: $2755, hotel cost: $1836, grand total: $4,591.50"))) == 4591.5
    assert one(money.signed_figures(lit("-$50 and $-20.5 and $1,000"))) == [-50.0, -20.5, 1000.0]
    assert one(money.first_price(lit("502 usd or $3"))) == 502.0


def test_tool_text(spark):
    def parse(s):
        r = spark.createDataFrame([(s,)], "x string").select(text.parse_tool_text("x").alias("p")).first().p
        return [(c.name, c.args, c.result, c.has_result) for c in r.calls], r.reasoning
    assert parse('a [f.x({"q": "b ] c"}) -> r [1] s] z') == ([("f.x", '{"q": "b ] c"}', "r [1] s", True)], "a z")
    assert parse('[g({})] -> out one [h({})]') == ([("g", "{}", "out one", True), ("h", "{}", "", False)], "")
    assert parse("no [brackets] here") == ([], "no [brackets] here")


def test_json_broken(spark):
    rows = [('{"a": 1}', False, False), ('{"a": 1', False, True), ('{"a": 1', True, False), ('{"a": [1, 2}', True, True),
            ('["x", "y', True, False), ('{"a": 1}]', True, True), ("plain", False, False), ('{"a": 1,', True, False),
            ('{"a":1},{"b":2}', False, True)]
    df = spark.createDataFrame(rows, "s string, cut boolean, want boolean")
    for r in df.withColumn("got", text.json_broken(F.col("s"), F.col("cut"))).collect():
        assert r.got == r.want, r


def test_secrets(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    r = spark.createDataFrame([(f"x {key} y password = \"abcdefghij0123456789\"",)], "t string").select(
        text.redact(F.col("t")).alias("r"), text.secret_findings(F.col("t")).alias("f")).first()
    assert "AKIA<redacted>" in r.r and "password=<redacted>" in r.r
    assert {x.label for x in r.f} == {"AWS access key id", "credential assignment"}


def brute(values, multiples=(1, 2), taxes=(0.08, 0.085, 0.10)):
    sums = {0.0}
    for v in values:
        for k in multiples:
            sums |= {round(s + k * v, 2) for s in sums}
    base = {s for s in sums if s} | {round(k * v, 2) for v in values for k in range(1, 5)}
    return base | {round(b * (1 + r), 2) for b in base for r in taxes}


def test_numeric_provenance_brute_force(spark):
    rng = np.random.default_rng(1)
    res, ass, want = [], [], set()
    for e in range(6):
        vals = [float(np.round(x, 2)) for x in rng.uniform(20, 900, size=5)]
        res += [(e, t, 0, v) for t, v in enumerate(vals)]
        for t in range(6):
            for v in [vals[0], vals[0] + vals[1], round((vals[2] + vals[3]) * 1.08, 2), 3 * vals[1], -vals[0],
                      float(np.round(rng.uniform(1000, 9000), 2))]:
                v = round(v, 2)
                ass.append((e, t, v))
                if not any(abs(v - g) <= 0.5 for g in brute(vals[:t])):
                    want.add((e, t, v))
    r = spark.createDataFrame(res, "e int, t int, pos int, value double")
    a = spark.createDataFrame(ass, "e int, t int, value double")
    left = verify.ungrounded(a, verify.grounded_figures(r, ["e"]), ["e"])
    got = {(x.e, x.t, x.value) for x in verify.ungrounded_by_sums(left, r, ["e"], chunk=4).collect()}
    assert got == want


def test_exact_tails():
    assert stats.binom_half_two_sided(0, 0) == 1.0 and stats.binom_half_two_sided(3, 6) == 1.0
    assert abs(stats.binom_half_two_sided(1, 8) - 18 / 256) < 1e-12
    lo, hi = stats.clopper_pearson(0, 10)
    assert lo == 0.0 and abs(hi - (1 - 0.025 ** 0.1)) < 1e-9
    hits = [sum(c) for c in itertools.product([0, 1], repeat=4)]
    assert len(hits) == 16 and abs(stats.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9


def test_selection_of_many_prices(spark):
    """Ten of forty prices: 847,660,528 selections, all within reach of one pass."""
    spec = TaskSpec(line_items=(LineItem("p", 1, 10),), tolerance=1e-6, tolerance_floor=0.001)
    rows = [(e, "p", float(i)) for e in "abc" for i in range(40)]
    priced = spark.createDataFrame(rows, "e string, name string, price double")
    st = spark.createDataFrame([("a", 55.0), ("b", 44.0), ("c", 345.5)], "e string, stated double")
    got = {r.e: r.selection for r in verify.selection(priced, st, ["e"], spec).collect()}
    assert got == {"a": "matches", "b": "mismatch", "c": "mismatch"}  # the smallest sum is 45


def test_selection_brute_force(spark):
    spec = TaskSpec(line_items=(LineItem("a", 2, 2), LineItem("b", 1)), tolerance=0.0, tolerance_floor=0.004)
    rng, rows, said, want = np.random.default_rng(4), [], [], {}
    for e in range(40):
        ps = [round(float(x), 2) for x in rng.uniform(1, 9, 5)] + [3.33, 3.33]
        b = [1.25, 2.5]
        rows += [(e, "a", p) for p in ps] + [(e, "b", p) for p in b]
        sums = {round(2 * sum(c) + sum(b), 2) for c in itertools.combinations(ps, 2)}
        v = float(rng.choice(sorted(sums))) if e % 2 else round(float(rng.uniform(5, 40)), 2)
        said.append((e, v))
        want[e] = "matches" if any(abs(v - x) < 0.004 for x in sums) else "mismatch"
    got = verify.selection(spark.createDataFrame(rows, "e int, name string, price double"),
                           spark.createDataFrame(said, "e int, stated double"), ["e"], spec).collect()
    assert {r.e: r.selection for r in got} == want and set(want.values()) == {"matches", "mismatch"}


def test_sums_of_a_long_episode(spark):
    """More sums than the old limit of 20,000, with a figure that only the last values reach."""
    rng = np.random.default_rng(8)
    vals = [round(float(x), 2) for x in rng.uniform(100, 999, 40)]
    r = spark.createDataFrame([(0, t, 0, v) for t, v in enumerate(vals)] + [(1, 0, 0, 500.0), (1, 1, 0, -120.25)],
                              "e int, t int, pos int, value double")
    a = spark.createDataFrame([(0, 40, round(sum(vals), 2)), (0, 39, round(4 * sum(vals), 2)), (0, 40, 0.9), (1, 2, 379.75), (1, 1, 379.75)],
                              "e int, t int, value double")
    left = {(x.e, x.t, x.value) for x in verify.ungrounded_by_sums(a, r, ["e"]).collect()}
    assert left == {(0, 39, round(4 * sum(vals), 2)), (0, 40, 0.9), (1, 1, 379.75)}


def test_tails_against_exact_sums():
    import math
    from fractions import Fraction
    rng = np.random.default_rng(5)
    for _ in range(300):
        an, bn = (int(x) for x in rng.integers(0, 30, 2))
        a, b = int(rng.integers(0, an + 1)), int(rng.integers(0, bn + 1))
        h, n = a + b, an + bn
        want = float(sum(Fraction(math.comb(h, x) * math.comb(n - h, an - x), math.comb(n, an))
                         for x in range(a, min(an, h) + 1) if an - x <= n - h)) if n else 1.0
        assert abs(stats.fisher_greater(a, an, b, bn) - want) < 1e-11
    lo, hi = stats.clopper_pearson(10_000, 20_000)
    assert 0.493 < lo < 0.5 < hi < 0.507
    assert stats.fisher_greater(500_000, 10**6, 499_000, 10**6) < 0.1
    assert abs(stats.chi2_sf(200.0, 3) / 4.2185411e-43 - 1) < 1e-6  # far out nothing cancels


def test_late_steps_change_nothing(spark, tmp_path):
    from trajspark.streaming import scoring
    schema = "k string, t int, z double"
    spark.createDataFrame([("a", 0, 1.0), ("a", 2, 2.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = scoring.stateful_scores(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["k"], "t", "z")
    scoring.run_available(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    spark.createDataFrame([("a", 1, 9.0), ("a", 3, 0.5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    scoring.run_available(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.t: (r.late, r.cusum) for r in spark.read.schema(s.schema).parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (False, 0.5), 2: (False, 2.0), 1: (True, None), 3: (False, 2.0)}


def test_ungrounded_without_writing_figures(spark):
    """Met on the spot, by buckets, or mixed: the same assertions are left, repeated ones and nulls too."""
    res = spark.createDataFrame([(o, i, 10.37 * (i + 1)) for o in (0, 1) for i in range(3 + 9 * o)], "o int, t int, value double")
    said = spark.createDataFrame([(o, t, 0.9 * v) for o in (0, 1, None) for t in (0, 2, 9) for v in range(10, 90, 9)]
                                 + [(0, 2, 50.0), (0, 2, 50.0), (0, 1, None)], "o int, t int, value double")
    want = sorted(map(str, verify.ungrounded(said, verify.grounded_figures(res, ["o"]), ["o"]).collect()))
    got = [sorted(map(str, verify.ungrounded_by(said, res, ["o"], together=n).collect())) for n in (0, 28, 999)]
    assert got == [want] * 3 and 0 < len(want) < said.count()


def test_few_selections_are_tried_together_and_equal_brute_force(monkeypatch):
    import pyarrow as pa
    spec = TaskSpec(line_items=(LineItem("line", 2, 3), LineItem("all")))
    rng, said, most, tools, want = random.Random(5), [], [], [], []
    for _ in range(400):
        name = rng.choice(["line", "all"])
        prices = [rng.randrange(100, 9000) for _ in range(rng.randrange(1, 6))]
        prices += prices[:rng.randrange(0, 2)]
        k, by = (3, 2) if name == "line" else (len(prices), 1)
        sums = [by * sum(c) for c in itertools.combinations(prices, min(k, len(prices)))]
        said.append(rng.choice(sums) / 100 * rng.choice([1.0, 1.0, 1.02, 1.1]))
        most.append(int(said[-1] * 100 / 0.99) + 101)
        amounts = [{"cents": c, "times": prices.count(c)} for c in sorted(set(prices)) if c <= most[-1]]
        tools.append([{"name": name, "n": len(prices), "s": sum(prices), "amounts": amounts}])
        want.append(any(abs(said[-1] - v / 100) <= max(spec.tolerance * max(abs(v / 100), spec.tolerance_pivot), spec.tolerance_floor) for v in sums))
    amount = pa.list_(pa.struct([("cents", pa.int64()), ("times", pa.int64())]))
    tool = pa.struct([("name", pa.string()), ("n", pa.int64()), ("s", pa.int64()), ("amounts", amount)])
    monkeypatch.setattr(verify, "Sums", None)                      # no set of sums per episode
    got = verify._selection_check(spec).func(pa.array(said), pa.array(most), pa.array(tools, pa.list_(tool)))
    assert got.to_pylist() == want and 50 < sum(want) < 400
