from pyspark.sql import functions as F

from trajspark.operators import repairs


def longest(origins, run):
    """(origin, shared): plain comparison with every original of the same task."""
    best = (0, None)
    for name, steps in sorted(origins.items()):
        n = 0
        while n < min(len(steps), len(run)) and steps[n] == run[n]:
            n += 1
        if n > best[0]:
            best = (n, name)
    return best[1], best[0]


def rows(spark, runs):
    return spark.createDataFrame([(task, run, t, x) for (task, run), steps in runs.items() for t, x in enumerate(steps)],
                                 "task string, run long, t int, text string")


def test_pairs_equal_plain_search(spark):
    alphabet = ["a", "b", None, ""]
    runs = {(task, n): ["own" if n == 13 else alphabet[(t * t if t < n % 5 else n * 7 + t) % 4] for t in range(1 + n % 9)]
            for task in "xy" for n in range(40)}
    first = {k: v for k, v in runs.items() if k[1] % 4 == 0}
    again = {k: v for k, v in runs.items() if k[1] % 4}
    out = repairs.pair_by_prefix(rows(spark, first), rows(spark, again), "run", "t", F.col("text"), ["task"])
    got = {(r.task, r.run): (r.origin, r.shared, r.calls) for r in out.collect()}
    want = {}
    for (task, run), steps in again.items():
        origin, shared = longest({n: s for (k, n), s in first.items() if k == task}, steps)
        want[task, run] = (origin, shared, len(steps) - shared)
    assert got == want
    assert any(v[0] is None for v in want.values()) and any(v[1] > 2 for v in want.values())


def test_hot_prefix_joins_one_owner(spark):
    same = {("x", n): ["go", f"own {n}"] for n in range(500)}
    one = repairs.pair_by_prefix(rows(spark, same), rows(spark, {("x", 900): ["go", "own 77", "z"], ("x", 901): ["go"]}),
                                 "run", "t", F.col("text"))
    assert {r.run: (r.origin, r.shared, r.calls) for r in one.collect()} == {900: (77, 2, 1), 901: (0, 1, 0)}


def test_outcomes_within_repeats(spark):
    data = [("c", "a", 0, False, True, 4), ("c", "a", 0, False, False, 2), ("c", "a", 0, True, False, 9), ("c", "a", 1, False, True, 3),
            ("c", "a", 1, True, True, 9), ("c", "b", 0, False, False, 5), ("c", "b", 0, None, True, 7), ("c", "b", 0, True, None, 7)]
    r = spark.createDataFrame(data, "g string, arm string, rep int, was boolean, now boolean, calls int")
    pop = spark.createDataFrame([("c", 10, 6)], "g string, n_total int, n_correct int")
    got = {x.arm: x.asDict() for x in repairs.arm_outcomes(r, pop, ["g"], "arm", "rep").collect()}
    a = got["a"]
    assert (a["repeats"], a["n_wrong"], a["rate"], a["rate_min"], a["rate_max"]) == (2, 3, 0.75, 0.5, 1.0)
    assert (a["recovered"], a["broken"], a["calls"], a["calls_per_recovery"]) == (1.0, 0.5, 3.0, 4.0)
    assert abs(a["net"] - 0.65) < 1e-12
    assert got["b"]["calls_per_recovery"] is None and got["b"]["ungraded"] == 2 and got["b"]["net"] == 0.6


def test_graders(spark):
    r = spark.createDataFrame([("incomplete", True, False), ("healthy", True, True), ("other", True, False), ("other", None, True)],
                              "label string, a boolean, b boolean")
    got = {x.label: (x.both, x.disagree, x.unexpected) for x in repairs.grader_disagreement(r, "label", "a", "b").collect()}
    assert got == {"incomplete": (1, 1, False), "healthy": (1, 0, False), "other": (1, 1, True)}
