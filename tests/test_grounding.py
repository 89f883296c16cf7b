import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark import schema
from trajspark.functions import text
from trajspark.operators import grounding, models, ordered, protocol, signal, studies
from trajspark.sources import audit, sinks, steps as src

WORDS = "alpha beta gamma delta epsilon zeta eta theta kappa lambda weather flight hotel price train".split()


def embed(s):
    return models.embedded([s])[0]


def cos(a, b):
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return float(a @ b) / (na * nb) if na and nb else 1.0


def logged(n=3, length=9):
    rng = np.random.default_rng(3)
    rows = []
    for e in range(n):
        for t in range(length):
            say = lambda k: " ".join(rng.choice(WORDS, k))
            events = [{"name": "get", "args": {"q": say(2)}, "result": say(5) if t % 3 else '{"a": ' + ("1}" if t % 2 else "1"),
                       "result_truncated": False, "is_error": False} for _ in range((t + e) % 3)]
            rows.append((f"e{e}", t, say(4) if t != 2 else "", "plan a trip" if e == 0 else None, events))
    return rows


def frame(spark, rows):
    ev = schema.TOOL_EVENT.simpleString()
    lines = [(e, t, json.dumps({"text": x, "task": task, "tool_events": events})) for e, t, x, task, events in rows]
    df = spark.createDataFrame(lines, "e string, t int, j string")
    return df.select("e", "t", F.from_json("j", f"struct<text:string,task:string,tool_events:array<{ev}>>").alias("s")).select("e", "t", "s.*")


def test_grounding_channel_step_by_step(spark):
    rows = logged()
    s = text.step_calls(frame(spark, rows))
    got = {(r.e, r.t): r.g for r in grounding.grounding_channel(s, ["e"], "t").collect()}
    for e in {r[0] for r in rows}:
        past, alnums, prev, recent, drift, seen = np.zeros(32), [], None, [], 0.0, 0
        for _, t, why, task, events in sorted(r for r in rows if r[0] == e):
            want = np.zeros(9)
            if events:
                emb = embed(" ".join(x["result"] for x in events))
                args = [json.dumps(x["args"], separators=(",", ":")) for x in events]
                want[0] = np.mean([1 - cos(embed(x["result"]), embed(f"get {a}")) for x, a in zip(events, args)])
                want[1] = 1 - cos(emb, embed(why)) if why else 0
                want[2] = 1 - cos(emb, past) if seen else 0
                want[3] = np.mean([x["result"].startswith("{") and not x["result"].endswith("}") for x in events])
                joined = " ".join(x["result"] for x in events)
                al = sum(c.isalnum() or c.isspace() for c in joined) / len(joined)
                want[4] = abs(al - np.mean(alnums)) if alnums else 0
                want[5] = 1 - cos(emb, prev) if prev is not None else 0
                drift = 0.4 * want[2] + 0.6 * drift
                want[6] = drift
                want[7] = 1 - cos(embed(why), np.mean(recent, axis=0)) if why and recent else 0
                past, prev, recent, seen = past + emb, emb, (recent + [emb])[-3:], seen + 1
                alnums.append(al)
            assert np.allclose(got[e, t][:8], want[:8], atol=1e-9), (e, t, got[e, t], want)
            assert got[e, t][8] in (0.0, 1.0)


def test_log_to_scores(spark, tmp_path):
    """One path: step log -> validated rows -> calls -> 60-wide vectors -> a scorer."""
    rows = logged(4, 8)
    for e, t, x, task, events in rows:
        f = tmp_path / "ds" / f"{e}.jsonl"
        f.parent.mkdir(exist_ok=True)
        with f.open("a") as out:
            out.write(json.dumps({"text": x, "task": task, "tool_events": events, "action": "act", "latency_s": 0.5,
                                  "output_tokens": 3, "schema": 5}) + "\n\n")
    (tmp_path / "ds" / "bad.jsonl").write_text('{"text": 1\n{"text": "ok"}\n')
    for _ in range(2):  # a second reader in one session
        s, bad = src.read_steps(spark, str(tmp_path / "ds"))
    assert {(r.episode_id, r.line) for r in bad.collect()} == {("bad", 1)}
    s = s.filter("episode_id <> 'bad'").withColumn("logprobs_available", F.lit(False))
    assert sorted((r.episode_id, r.t) for r in s.collect()) == sorted((e, t) for e, t, *_ in rows)
    keys = ["dataset", "episode_id"]
    calls = sinks.materialize(signal.from_log(sinks.materialize(s, "log"), keys, "t"), "calls")
    v = sinks.materialize(signal.signals(calls, keys, "t", grounded=True).select(
        *keys, "t", F.concat("e", "u", "m", "x", "g").alias("v")), "vectors")
    assert {len(r.v) for r in v.collect()} == {60}
    m = models.fit_gaussian(v, "v", 60)
    assert v.select(models.mahalanobis(F.col("v"), m).alias("d")).filter("d >= 0").count() == len(rows)


def test_step_numbers_over_many_blocks(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "long.jsonl").write_text("".join(json.dumps({"text": f"step {k}"}) + "\n" for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = src.read_steps(spark, str(tmp_path / "c"))[0].select("t", "text").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.t, r.text) for r in got) == [(k, f"step {k}") for k in range(3000)]


@pytest.mark.parametrize("alpha", [1.0, 0.5, 0.01, 0.003])
def test_ewma_over_segments(spark, alpha):
    x = np.random.default_rng(0).normal(size=700)
    df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], "k string, t int, x double")
    got = {r.t: r.y for r in ordered.ewma(df, ["k"], "t", "x", "y", alpha, seg_rows=64).collect()}
    y = 0.0
    for t, v in enumerate(x):
        y = alpha * v + (1 - alpha) * y
        assert abs(got[t] - y) < 1e-9


def test_cross_fit_sees_usable_rows_of_other_folds_only(spark):
    df = spark.createDataFrame([(k, k % 3 != 0) for k in range(60)], "id int, healthy boolean")
    seen = []

    def make(rows):
        mine = {r.id for r in rows.select("id").collect()}
        seen.append(mine)
        return lambda d: d.withColumn("n", F.lit(len(mine)))
    out = protocol.cross_fit(df, "id", 3, "s", make, F.col("healthy")).collect()
    fold = {r.id: r.fold for r in out}
    assert len(out) == 60
    for i, mine in enumerate(seen):
        assert mine == {k for k in range(60) if k % 3 and fold[k] != i}


def test_refusals(spark):
    df = spark.createDataFrame([(1, "step"), (2, "nonsense"), (3, None)], "id int, event string")
    assert {(r.id, r.reason) for r in audit.refused(df, F.col("event")).collect()} == {(2, "unknown event nonsense"), (3, "no event")}
    v = spark.createDataFrame([(100.0, 100.4), (0.5, 0.5004), (7.0, 7.0)], "a double, b double")
    ok = v.select((F.abs(F.col("a") - F.col("b")) <= studies.claim_tolerance(F.col("a"))).alias("ok"))
    assert [r.ok for r in ok.collect()] == [False, True, True]

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "yarn"
            getConf = staticmethod(lambda: Cluster.conf)
    with pytest.raises(ValueError):
        sinks.shared_dir(Cluster)
    with pytest.raises(ValueError):
        models.fit_next_step(v, v, ["a"], "a", "b", 64, 3, quadratic=True)
    with pytest.raises(ValueError):
        models.Reservoirs(1, 1, 4, 0, 1.0, 0.3, 0.5, 0.5)


def test_scale_without_fallback(spark):
    """The plain MAD of a dim that is mostly constant is 0: its steps are at the cap; with the fallback they are not."""
    from trajspark.operators import fusion
    df = spark.createDataFrame([(i, 0.0 if i < 6 else float(i), float(i)) for i in range(9)] + [(9, -1.0, 9.0)], "t int, flat double, even double")
    for fallback, want in ((True, False), (False, True)):
        out = fusion.grounding_score(["flat", "even"], fusion.dim_stats(df, ["flat", "even"], fallback), df).orderBy("t").collect()
        assert all(r.z_flat == fusion.Z_CAP for r in out[:9]) == want and out[9].z_flat == 0.0
        assert out[9].z_even == (9 - 4.5) / (1.4826 * 2.5)


def test_texts_leave_a_batch_piece_by_piece(spark):
    """A Python worker never holds a batch, or the windows of a long text, as a whole; the results are those of each text alone."""
    import tracemalloc

    import pyarrow as pa
    long = [f"{i} " + "näive text " * 9000 for i in range(12)]
    said = "".join(f"say [f(q) -> {x}]" for x in ("one", "two"))
    most = lambda some: np.full((len(some), 1), float(sum(len(x.encode()) for x in some)))
    df = spark.createDataFrame([(i, x, [x], [said]) for i, x in enumerate(long)], "i int, x string, a array<string>, b array<string>").coalesce(1)
    got = df.select(models.embedding(most)("x")[0].alias("n")).collect()
    assert 0 < max(r.n for r in got) <= max(text.PIECE_BYTES, max(len(x.encode()) for x in long))
    for r in df.select("x", "a", models.embedding()("x").alias("v"), models.mean_gap()("a", "b").alias("gap")).collect():
        assert np.allclose(r.v, embed(r.x)) and r.gap == pytest.approx(1 - cos(embed(r.x), embed(said)))
    parts = list(text.parse_tool_text.func(iter([pa.array([*long, None, said])])))
    assert len(parts) > 1 and [x for p in parts for x in p.to_pylist()] == [
        {"calls": calls, "reasoning": why} for calls, why in map(text._parse, [*long, "", said])]
    tracemalloc.start()
    whole = models.embedded(["ab ΑΣ" * 600000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and np.allclose(whole[0] @ whole[0], 1.0)
