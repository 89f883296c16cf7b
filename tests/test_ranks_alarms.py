import numpy as np
from pyspark.sql import functions as F

from trajspark.operators import alarms, calibrate, policy, ranks


def test_higher_quantile(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("m"))
    assert alarms.pick_threshold(df, [], "m", 0.05).first().theta == 96.0


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    v = np.round(np.concatenate([rng.normal(size=301), rng.exponential(50, size=200), np.zeros(40)]), 3)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    r = ranks.quantiles(df, [], "v", {"a": .1, "b": .5, "c": .975}).first()
    assert np.allclose([r.a, r.b, r.c], np.quantile(v, [.1, .5, .975]))


def test_hand_built_alarm_case(spark):
    meta = [("h1", 10, True, None, None), ("h2", 10, True, None, None), ("i1", 12, False, "goal_drift", 5),
            ("i2", 12, False, "looping", 5), ("i3", 12, False, "grounding_loss", 6), ("i4", 12, False, "goal_drift", 5)]
    spikes = {("h2", 4): 2.0, ("i1", 7): 1.5, ("i2", 3): 1.5, ("i4", 5): 1.5}
    ep = spark.createDataFrame(meta, "e string, n_steps int, is_healthy boolean, failure_class string, tau int")
    sc = spark.createDataFrame([("m", e, t, spikes.get((e, t), 0.1)) for e, n, *_ in meta for t in range(n)],
                               "monitor string, e string, t int, score double")
    th = spark.createDataFrame([("m", 1.0)], "monitor string, theta double")
    rows = alarms.evaluate(sc, ep, th, ["monitor"], ["e"])
    got = {r.e: (r.outcome, r.delay, r.lead_steps, r.saved_frac) for r in rows.collect()}
    assert got["h1"][0] == "correct_silence" and got["h2"][0] == "false_alarm"
    assert got["i1"] == ("true_alarm", 2.0, 4.0, 4 / 11) and got["i4"] == ("true_alarm", 0.0, 6.0, 6 / 11)
    assert got["i2"][0] == "early_alarm" and got["i3"][0] == "miss"
    s = alarms.summarize(rows, ["monitor"]).first()
    assert (s.healthy_fa_rate, s.early_alarm_rate, s.detection_rate) == (.5, .25, .5)
    assert (s.median_delay, s.median_lead, s.mean_lead_all) == (1.0, 5.0, 2.5)
    assert abs(s.mean_budget_saved_all - 10 / 44) < 1e-12


def test_non_finite_scores_are_not_quiet(spark):
    sc = spark.createDataFrame([("a", 0, float("nan")), ("a", 1, 0.1), ("b", 0, 0.2)], "e string, t int, score double")
    th = spark.createDataFrame([(0.15,)], "theta double")
    got = {r.e: (r.alarm_step, r.unscored) for r in alarms.first_alarm(sc, th, [], ["e"]).collect()}
    assert got == {"a": (None, True), "b": (0, False)}


def test_auc_and_conformal(spark):
    df = spark.createDataFrame([(1.0, False), (2.0, False), (2.0, True), (3.0, True)], "s double, y boolean")
    assert ranks.auc(df, [], "s", F.col("y")).first().auroc == 0.875
    ref = spark.createDataFrame([(0.0,), (0.0,), (0.0,)], "s double")
    test = spark.createDataFrame([("x", 0.0), ("y", 1.0)], "e string, s double")
    got = {r.e: r.confidence for r in calibrate.conformal(ref, test, [], "s").collect()}
    assert got == {"x": 0.0, "y": 0.75}


def loop(trig, pos, debounce=2, cooldown=3):
    streak = cool = calls = 0
    for t, (g, p) in enumerate(zip(trig, pos)):
        if cool:
            cool, streak = cool - 1, 0
        elif not g:
            streak = 0
        else:
            calls += 1
            streak = streak + 1 if p else 0
            if streak >= debounce:
                return t, calls
            if not p:
                cool = cooldown
    return None, calls


def test_escalation_machine(spark):
    rng = np.random.default_rng(5)
    runs = {e: (rng.random(60) < .6, rng.random(60) < .45) for e in range(40)}
    df = spark.createDataFrame([(e, t, bool(g[t]), bool(p[t])) for e, (g, p) in runs.items() for t in range(60)],
                               "e int, t int, g boolean, p boolean")
    for seg in (5, 4096):
        out = policy.escalate_on_alarm(df, ["e"], "t", F.col("g"), F.col("p"), seg_rows=seg)
        got = {r.e: (r.halted_at, r.calls) for r in out.collect()}
        assert got == {e: loop(*r) for e, r in runs.items()}


def test_first_segment_runs_from_its_only_start(spark):
    rows = [("e", i, i % 3 != 0, i % 4 == 1 or i in (40, 41)) for i in range(60)]
    df = spark.createDataFrame(rows, "e string, t int, trig boolean, pos boolean")
    args = (df, ["e"], "t", F.col("trig"), F.col("pos"))
    assert {r["_seg"]: len(r["_out"]) for r in policy.segment_runs(*args, seg_rows=25).collect()} == {0: 1, 1: 5, 2: 5}
    streak = wait = calls = 0
    halted = None
    for _, t, trig, pos in rows:
        if halted is None and wait:
            wait -= 1
            streak = 0
        elif halted is None:
            calls += trig
            streak, wait = (streak + 1 if trig and pos else 0), 3 if trig and not pos else 0
            halted = t if streak == 2 else None
    for seg_rows in (7, 25, 4096):
        got = policy.escalate_on_alarm(*args, seg_rows=seg_rows).first()
        assert (got.halted_at, got.calls) == (halted, calls)


def test_shared_tables_read_their_input_once(spark, tmp_path, monkeypatch):
    """The lengths of episodes take one pass over the events, the peaks and the first alarms one pass each over the scores."""
    import re
    import shutil

    from trajspark.plans import base
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path)
    seen, write = {"events": 0, "scores": 0}, base.sinks.materialize

    def note(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        seen["events"] += len(re.findall(r"Relation \[event_id#", plan))
        seen["scores"] += len(re.findall(r"Relation \[monitor#\w+,user_id#\w+,t#", plan))

    def materialize(df, name, scope=""):
        note(df)
        return write(df, name, scope)
    monkeypatch.setattr(base.sinks, "materialize", materialize)
    base.episodes(spark, str(tmp_path))
    assert seen["events"] == 1
    base.scores(spark, str(tmp_path))
    seen["scores"] = 0
    note(base.alarm_rows(spark, str(tmp_path)))
    assert seen["scores"] == 2
