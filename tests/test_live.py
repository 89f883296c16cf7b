import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_grounding import logged
from trajspark import schema
from trajspark.operators import signal
from trajspark.sources import sinks
from trajspark.streaming import gate, scoring, sessions, step_vectors


def log(spark, rows):
    import json
    ev = schema.TOOL_EVENT.simpleString()
    lines = [(e, t, json.dumps({"text": x, "task": task, "tool_events": events, "action": "act", "latency_s": 0.25 * t + 0.5,
                                "output_tokens": 3 + t, "error": t == 4})) for e, t, x, task, events in rows]
    df = spark.createDataFrame(lines, "e string, t int, j string")
    fields = f"text string, task string, tool_events array<{ev}>, action string, latency_s double, output_tokens int, error boolean"
    return df.select("e", "t", F.from_json("j", f"struct<{fields}>").alias("s")).select(
        "e", "t", "s.*", F.lit(None).cast("array<double>").alias("token_logprobs"))


class Feed:
    """A stream fed part by part; every part is a run of its own, so state comes back from the checkpoint."""

    def __init__(self, spark, root, make):
        self.spark, self.root, self.make = spark, f"{root}/{uuid.uuid4().hex}", make

    def add(self, part):
        part.write.mode("append").parquet(f"{self.root}/in")
        out = self.make(self.spark.readStream.schema(part.schema).parquet(f"{self.root}/in"))
        scoring.run_available(out, f"{self.root}/out", f"{self.root}/state")
        return self.spark.read.schema(out.schema).parquet(f"{self.root}/out")


@pytest.fixture(scope="module")
def rows():
    out = logged(4, 12)
    # calls repeated in later steps, and twice in one step
    return [(e, t, x, task, events + events[:1] + ([{**out[1][4][0], "result": "again " + x}] if t % 4 == 3 and out[1][4] else []))
            for e, t, x, task, events in out]


def test_live_vectors_equal_the_log(spark, rows, tmp_path):
    s = sinks.materialize(log(spark, rows), "log")
    named = s.withColumnRenamed("e", "run")
    calls = sinks.materialize(signal.from_log(named, ["run"], "t"), "calls")
    want = {(r.run, r.t): r for r in signal.signals(calls, ["run"], "t", grounded=True).collect()}
    feed = Feed(spark, tmp_path, lambda d: step_vectors.live_signals(d, ["run"], "t"))
    for cut in ("t < 3", "t >= 3 AND t < 8", "t >= 8"):
        got = feed.add(named.filter(cut))
    got = {(r.run, r.t): r for r in got.collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        for c, n in schema.WIDTHS.items():
            assert len(got[k][c]) == n
            np.testing.assert_allclose(got[k][c], w[c], atol=1e-9, err_msg=f"{k} {c}")
    assert max(r.x[3] for r in got.values()) > 0 and max(r.g[2] for r in got.values()) > 0


def test_late_and_repeated_steps_change_nothing(spark, rows, tmp_path):
    named = sinks.materialize(log(spark, rows).withColumnRenamed("e", "run"), "log")
    make = lambda d: step_vectors.live_signals(d, ["run"], "t")
    straight = Feed(spark, tmp_path, make)
    straight.add(named.filter("t <= 5"))
    want = {(r.run, r.t): r.x for r in straight.add(named.filter("t > 5")).filter("NOT late").collect()}
    mixed = Feed(spark, tmp_path, make)
    mixed.add(named.filter("t <= 5"))
    got = mixed.add(named.filter("t > 5 OR t = 2")).collect()
    assert sorted((r.run, r.t) for r in got if r.late) == sorted((f"e{k}", 2) for k in range(4))
    assert all(r.x is None for r in got if r.late)
    for r in got:
        if not r.late:
            np.testing.assert_allclose(r.x, want[r.run, r.t], atol=1e-12)


class Kept(dict):
    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.__getitem__, dict.__setitem__, dict.__delitem__

    def iterator(self):
        return iter(self.items())


def test_silent_episodes_of_a_bucket_go_and_the_others_stay():
    timers, own = [], step_vectors.Vectors("t", idle_ms=70)
    own.handle = type("Handle", (), {"registerTimer": staticmethod(timers.append)})
    own.episodes = Kept({("a",): (0, None), ("b",): (50, None)})
    own.seen = Kept({("a", "look", "x"): (0,), ("b", "look", "x"): (1,)})
    now = type("Now", (), {"getCurrentProcessingTimeInMs": staticmethod(lambda: 100)})
    assert not list(own.handleExpiredTimer((1,), now, None))
    assert list(own.episodes) == [("b",)] and list(own.seen) == [("b", "look", "x")] and timers == [120]


def test_live_vectors_of_one_bucket_equal_those_of_many(spark, rows, tmp_path):
    """Episodes share a call and keep their own state; a null key is a key like others."""
    s = sinks.materialize(log(spark, rows).select(F.nullif("e", F.lit("e1")).alias("run"), F.lit(2 ** 53 + 1).alias("k"), "*").drop("e"), "log")
    got = []
    for buckets in (1, 256):
        feed = Feed(spark, tmp_path, lambda d: step_vectors.live_signals(d, ["run", "k"], "t", buckets=buckets))  # noqa: B023
        feed.add(s.filter("t < 5"))
        got.append({(r.run, r.k, r.t): r for r in feed.add(s.filter("t >= 5")).collect()})
    assert got[0].keys() == got[1].keys() and len(got[0]) == 48 and (None, 2 ** 53 + 1, 0) in got[0]
    for k, r in got[0].items():
        np.testing.assert_allclose([*r.x, *r.g], [*got[1][k].x, *got[1][k].g], atol=1e-12)


def in_parts(rows, parts, delay, gap):
    """Sessions and late rows by definition: per part, what is behind the watermark of the parts before."""
    top, late, kept = None, [], {}
    for part in range(parts):
        for key, ts, i, p in rows:
            if p == part:
                if top is not None and ts < top - delay:
                    late.append(i)
                else:
                    kept.setdefault(key, []).append(ts)
        seen = [ts for _, ts, _, p in rows if p == part]
        top = max([*seen, *([top] if top is not None else [])])
    out = []
    for key, times in kept.items():
        run = []
        for ts in sorted(times):
            if run and ts - run[-1] >= gap:
                out.append((key, run[0], run[-1] + gap, len(run)))
                run = []
            run.append(ts)
        out.append((key, run[0], run[-1] + gap, len(run)))
    return sorted(x for x in out if x[2] <= top - delay), sorted(late)


@pytest.mark.parametrize("seed", [1, 2])
def test_live_sessions_and_late_rows(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(400):
        ts = int(rng.integers(0, 300_000))
        part = min(2, ts // 100_000)
        if rng.random() < 0.2:
            part = int(rng.integers(part, 3))  # comes later than it should
        rows.append((f"k{rng.integers(0, 6)}", 1_700_000_000 + ts, i, part))
    df = spark.createDataFrame(rows, "k string, s long, i long, part int").withColumn("ts", F.timestamp_seconds("s"))
    feed = Feed(spark, tmp_path, lambda d: sessions.live_sessions(d, ["k"], "ts", "i", gap_s=3600, delay_s=7200))
    for part in range(3):
        got = feed.add(df.filter(F.col("part") == part).drop("part", "s"))
    got = got.collect()
    want, late = in_parts(rows, 3, 7200, 3600)
    assert sorted(int(r.row_id) for r in got if r.late) == late and late
    assert sorted((r.k, int(r.started.timestamp()), int(r.closed.timestamp()), r.n_rows) for r in got if not r.late) == want


def test_sessions_of_many_keys_share_a_few_rows_of_state(spark, tmp_path):
    rng, t0 = np.random.default_rng(3), 1_700_000_000
    keys = [None, 2 ** 53 + 1, *range(70)]
    rows = [(keys[int(rng.integers(len(keys)))], "ab"[i % 2], t0 + int(rng.integers(0, 100_000)) + 100_000 * (i // 500), i, i // 500) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, w string, s long, i long, part int").withColumn("ts", F.timestamp_seconds("s"))
    for part in range(2):
        df.filter(F.col("part") == part).drop("part", "s").write.mode("append").parquet(f"{tmp_path}/in")
        d = spark.readStream.schema("k long, w string, ts timestamp, i long").parquet(f"{tmp_path}/in")
        q = sessions.live_sessions(d, ["k", "w"], "ts", "i", gap_s=3600, delay_s=7200, buckets=3).writeStream.format("parquet").option(
            "checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) == 3
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    want, late = in_parts([((str(k), w), s, i, p) for k, w, s, i, p in rows], 2, 7200, 3600)
    assert sorted(((str(r.k), r.w), int(r.started.timestamp()), int(r.closed.timestamp()), r.n_rows) for r in got if not r.late) == want
    assert sorted(int(r.row_id) for r in got if r.late) == late


def test_gate_in_the_stream_equals_the_gate_over_the_log(spark, tmp_path):
    rows = [r for k in range(8) for r in [(f"r{k}{e}", t, x, task, ev) for e, t, x, task, ev in logged(3, 8)]]
    named = sinks.materialize(log(spark, rows).withColumnRenamed("e", "run"), "log")
    calls = sinks.materialize(signal.from_log(named, ["run"], "t"), "calls")
    whole = sinks.materialize(signal.signals(calls, ["run"], "t", grounded=True).select("run", "t", *"eumxg"), "whole")
    levels = gate.fit(whole.filter("run LIKE 'r0%' OR run LIKE 'r1%'"), ["run"], "t")
    want = {(r.run, r.t): r for r in gate.gated(whole, levels).collect()}
    feed = Feed(spark, tmp_path, lambda d: gate.gated(step_vectors.live_signals(d, ["run"], "t"), levels))
    feed.add(named.filter("t < 4"))
    got = {(r.run, r.t): r for r in feed.add(named.filter("t >= 4")).collect()}
    assert got.keys() == want.keys() and levels.trip >= 1.0 and levels.theta > 0
    for k, w in want.items():
        np.testing.assert_allclose([got[k][c] for c in ("behaviour", "content", "display")], [w[c] for c in ("behaviour", "content", "display")], atol=1e-6)
        assert w.alarm == (w.display > 1.0) and w.display >= max(w.behaviour, w.content) - 1e-12
        b, g = w.behaviour, w.content
        assert w.display == pytest.approx(max(b, g, 1.5 if levels.lexical and w.lexical > 0 else 0.0))
