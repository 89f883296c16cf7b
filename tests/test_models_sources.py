import json

import numpy as np
from pyspark.sql import functions as F

from trajspark.functions import hashing
from trajspark.operators import models
from trajspark.sources import audit, imports, steps as src
from trajspark.streaming import baseline


def test_ledoit_wolf(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5)) + 3
    df = spark.createDataFrame([(r.tolist(),) for r in x], "z array<double>")
    m = models.fit_gaussian(df, "z", 5)
    c = x - x.mean(axis=0)
    s = c.T @ c / len(c)
    mu, n = np.trace(s) / 5, len(c)
    delta = ((s - mu * np.eye(5)) ** 2).sum()
    beta = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in c) / n ** 2, delta)
    cov = (1 - beta / delta) * s + beta / delta * mu * np.eye(5)
    assert abs(m.shrinkage - beta / delta) < 1e-9 and np.allclose(np.linalg.inv(cov), m.precision)


def echo_steps(spark, n=14, length=20):
    rng = np.random.default_rng(7)
    rows = [(e, t, rng.normal(size=2).tolist()) for e in range(n) for t in range(length)]
    parts = spark.createDataFrame([(e, "fit" if e < 10 else "held") for e in range(n)], "e int, part string")
    return rows, spark.createDataFrame(rows, "e int, t int, z array<double>"), parts


def test_echo_state_against_a_plain_loop(spark):
    rows, df, parts = echo_steps(spark)
    m = models.fit_echo_state(df, parts, ["e"], "t", "z", 2, K=2, size=8)
    raw = {(r.e, r.t): r.sup for r in models.echo_state_raw(df, ["e"], "t", "z", m).collect()}
    run = np.array([z for e, _, z in rows if e == 0])
    h, pred = np.zeros((2, 8)), None
    for t, u in enumerate(run):
        if t < 3:
            assert raw[(0, t)] is None
        else:
            e = (pred - u) / m.sigma
            assert abs(raw[(0, t)] - (e * e).mean()) < 1e-9
        units, inputs = m.res.drive[:, :8], m.res.drive[:, 8:10]
        h = 0.7 * h + 0.3 * np.tanh(np.einsum("ksr,ks->kr", units, h) + np.einsum("i,kir->kr", u, inputs))
        z = np.concatenate([h, np.broadcast_to(u, (2, 2)), np.ones((2, 1))], axis=1)
        pred = np.einsum("kf,kfd->kd", z, m.readout)


def test_reservoirs_take_tasks_by_cores_and_keep_rows_of_a_null_key(spark):
    rows, df, parts = echo_steps(spark)
    tasks = models.clustered(df, ["e"], "t", 4).rdd.getNumPartitions()
    assert tasks == models.TASKS_PER_CORE * spark.sparkContext.defaultParallelism     # not one task because the bytes are few
    m = models.fit_echo_state(df, parts, ["e"], "t", "z", 2, K=2, size=8)
    nameless = spark.createDataFrame([(None, t, z) for e, t, z in rows if e == 0], df.schema)
    got = [(r.t, r.sup and round(r.sup, 9)) for r in models.echo_state_raw(df.filter("e <= 1").union(nameless), ["e"], "t", "z", m).collect() if r.e in (0, None)]
    assert len(got) == 40 and len(set(got)) == 20


def test_channels_in_one_pass_equal_ensembles_on_their_own(spark):
    _, df, parts = echo_steps(spark)
    both = models.fit_echo_states(df, parts, ["e"], "t", "z", {"a": (0, 1, 0), "b": (1, 1, 3)}, K=2, size=8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")               # a run of 20 rows spans batches
    try:
        got = {(r.e, r.t): r for r in models.fused_scores(df, ["e"], "t", "z", both).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, first, seed in (("a", 1, 0), ("b", 2, 3)):
        own = df.select("e", "t", F.slice("z", first, 1).alias("z"))
        m = models.fit_echo_state(own, parts, ["e"], "t", "z", 1, seed=seed, K=2, size=8)
        want = models.echo_state_scores(own, ["e"], "t", "z", m).collect()
        assert len(want) == 280 and all(abs(got[(r.e, r.t)][name] - r.fused) < 1e-8 for r in want)


def test_linear_predictor_learns(spark):
    rows = [(e, t, [float(np.sin(0.7 * t + e))]) for e in range(12) for t in range(40)]
    df = spark.createDataFrame(rows, "e int, t int, z array<double>")
    parts = spark.createDataFrame([(e, "fit" if e < 9 else "held") for e in range(12)], "e int, part string")
    m = models.fit_next_step(df, parts, ["e"], "t", "z", 1, ridge=1e-6)
    assert m.sigma[0] <= 1.0 and np.abs(m.weights).sum() > 0.5
    out = models.next_step_scores(df, ["e"], "t", "z", 1, m).filter("t < 3").select(F.max("score")).first()[0]
    assert out == 0.0


def test_forest_ranks_an_outlier_first(spark):
    rng = np.random.default_rng(4)
    x = [(i, rng.normal(size=3).tolist()) for i in range(400)] + [(400, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(x, "i int, z array<double>")
    f = models.fit_forest(df.filter("i < 400"), hashing.uniform("u", F.col("i")), "z", trees=20)
    top = df.withColumn("s", models.forest_score(F.col("z"), f)).orderBy(F.desc("s")).first()
    assert top.i == 400


def test_fold_and_draw(spark):
    import hashlib
    r = spark.createDataFrame([("ep-1",)], "e string").select(hashing.fold_of(F.col("e"), 5, "s").alias("f")).first().f
    assert r == int.from_bytes(hashlib.sha256(b"s:ep-1").digest()[:8], "big") % 5


def test_read_steps(spark, tmp_path):
    d = tmp_path / "corpus"
    d.mkdir()
    (d / "ep1.jsonl").write_text('{"text": "a", "latency_s": 1.5}\n\n{"text": "b", "tool_events": []}\n{"text": \n')
    (d / "manifest.json").write_text(json.dumps([{"episode_id": "ep1", "tau": 1, "T": 2}]))
    (d / "rejected.json").write_text(json.dumps([{"episode_id": "x", "reason": "too short (2)"}]))
    good, bad = src.read_steps(spark, str(d))
    rows = {r.t: r for r in good.collect()}
    assert rows[0].text == "a" and rows[1].text == "b" and rows[0].dataset == "corpus" and rows[0].episode_id == "ep1"
    assert rows[0].tool_events is None and rows[1].tool_events == []       # absent differs from empty
    assert [r.line for r in bad.collect()] == [4]
    assert src.read_manifests(spark, str(tmp_path)).first().tau == 1
    assert src.read_rejected(spark, str(tmp_path)).first().dataset == "corpus"


def test_import_by_call_id(spark):
    call = json.dumps([{"id": "c1", "name": "look", "arguments": '{"q": 1}'}])
    res = json.dumps([{"call_id": "c1", "result": "Error: no"}])
    rows = [("e", 0, "user", "", "", "hi"), ("e", 1, "agent", "think", call, ""), ("e", 2, "environment", "", "", res),
            ("e", 3, "agent", "", "", "the answer")]
    t = spark.createDataFrame(rows, "e string, turn int, role string, thought string, action string, content string")
    got = {r.t: r for r in imports.steps_with_call_ids(t, ["e"], "turn").collect()}
    assert got[0].action == "tool_call" and got[0].error and got[0].tool_events[0].result == "Error: no"
    assert got[1].action == "synthesis" and got[1].text == "the answer" and got[1].output_tokens == 2


def test_audit_skips_a_torn_line(spark, tmp_path):
    p = tmp_path / "log"
    p.mkdir()
    (p / "a.json").write_text('{"run_id": "r", "seq": 1, "event": "score", "value": 0.5}\n{"run_id": "r", "se')
    assert [r.seq for r in audit.read(spark, str(p)).collect()] == [1]


def test_rolling_baseline(spark, tmp_path):
    rows = [("d", i, float(i % 9), True, "a") for i in range(12)] + [("d", 12, 99.0, True, "a"), ("d", 13, 1.0, False, "a"),
                                                                     ("d", 14, 5.0, True, "b")]
    df = spark.createDataFrame(rows, "k string, i int, score double, checks_passed boolean, fingerprint string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    from trajspark.streaming import scoring
    scoring.run_available(baseline.rolling_baseline(s, ["k"], "i"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.i: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[7].state == "warming_up" and got[7].threshold is None
    assert got[8].state == "trusted" and got[8].threshold == 8.0
    assert not got[12].admitted and got[12].rejected == 1          # alarming run refused
    assert not got[13].admitted and got[13].rejected == 2          # failed its checks
    assert got[14].state == "recalibrating" and got[14].n == 1     # configuration changed
