"""Whole step vectors of live trajectories.

What a step has by itself (calls, embeddings, character statistics) is computed in
the scan of the stream.  What depends on earlier steps lives in typed state: per
episode one entry of a map (sums, last vectors, the last result vectors) and an entry
of another map for each call made so far.  The calls are the only part that grows with
an episode; they stay in the state store and only those that a step asks for are read.

Episodes are dealt over buckets, and a bucket is one call per batch, so an episode costs
its steps and one look into the state and no call of its own.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trajspark import schema
from trajspark.functions import text
from trajspark.operators import features, grounding, models, signal

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANNELS = ("e", "u", "m", "x", "g")
#: how keys become text and come back
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def observed(steps: DataFrame, keys: Sequence[str], t: str,
             embed: Callable[[list[str]], np.ndarray] = models.embedded) -> DataFrame:
    """All that the state needs of a step in the log's own schema; no shuffle, no state."""
    d = grounding.observed(signal.base_channels(signal.observed(steps)), embed)
    return d.select(
        *keys, t, "e", "u", "m", "tool_success", "tool_latency", F.col("n_calls").cast("long").alias("n_calls"),
        F.transform("calls", lambda c: F.struct(c["name"].alias("name"), c["args"].alias("args"))).alias("signatures"),
        features.context_use(signal.token_count(), F.col("text")).alias("used"), "anchor",
        text.content_words(F.col("anchor")).alias("anchor_words"), *(c for c in grounding.OBSERVED if c != "anchor"))


def gap(a: np.ndarray, b: np.ndarray) -> float:
    """1 - cosine; 0 if a side has no length."""
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return 1.0 - float(a @ b) / size if size > 0 else 0.0


_WIDTH = schema.WIDTHS["e"]


class _Episode:
    """What is kept of one episode: a few numbers, four vectors and the vectors of the last result steps."""

    def __init__(self, anchor: np.ndarray, words: Sequence[str]):
        self.last, self.n, self.results, self.words = -1, 0, 0, set(words)
        self.used = self.alnum = self.drift = 0.0
        self.prev, self.total, self.result_total, self.anchor = np.zeros(_WIDTH), np.zeros(_WIDTH), np.zeros(_WIDTH), anchor
        self.recent: list[np.ndarray] = []

    def row(self, at_ms: int) -> tuple:
        numbers = np.concatenate([[self.used, self.alnum, self.drift], self.prev, self.total, self.result_total, self.anchor, *self.recent])
        return at_ms, self.last, self.n, self.results, sorted(self.words), numbers.tobytes()

    @classmethod
    def of(cls, row: tuple) -> _Episode:
        _, last, n, results, words, packed = row
        numbers = np.frombuffer(packed)
        prev, total, result_total, anchor, *recent = numbers[3:].reshape(-1, _WIDTH)
        own = cls(anchor, words)
        own.last, own.n, own.results = last, n, results
        own.used, own.alnum, own.drift = numbers[:3].tolist()
        own.prev, own.total, own.result_total, own.recent = prev, total, result_total, recent
        return own

    def step(self, r, repeated: int) -> tuple[list[float], list[float]]:
        """Channels x and g of the next step."""
        e, g = np.array(r.e), np.zeros(len(grounding.DIMS))
        self.used += r.used
        norm = float(np.linalg.norm(self.total))
        x = [1.0 - float(e @ self.prev) if self.n else 0.0, float(e @ self.anchor), r.tool_success, float(repeated), r.tool_latency,
             min(self.used / schema.CONTEXT_BUDGET_TOKENS, schema.CONTEXT_RATIO_CAP), float(r.n_calls),
             float(e @ self.total) / norm if self.n and norm > 0 else 1.0]
        if r.has:
            said, why = np.array(r.said), np.array(r.why)
            self_gap = gap(said, self.result_total) if self.results else 0.0
            self.drift = grounding.DRIFT_ALPHA * self_gap + (1 - grounding.DRIFT_ALPHA) * self.drift
            g[:] = (r.query, gap(said, why) if r.reasoned else 0.0, self_gap, r.json,
                    (abs(r.alnum - self.alnum / self.results) if self.results else 0.0) + r.junk,
                    gap(said, self.recent[-1]) if self.recent else 0.0, self.drift,
                    gap(why, np.sum(self.recent, axis=0)) if r.reasoned and self.recent else 0.0,
                    float(any(self.words.isdisjoint(w) for w in r.strange)))
            self.results, self.alnum, self.result_total = self.results + 1, self.alnum + r.alnum, self.result_total + said
            self.recent = [*self.recent, said][-grounding.MEMORY_STEPS:]
        self.n, self.prev, self.total = self.n + 1, e, self.total + e
        return x, g.tolist()


class Vectors(StatefulProcessor):
    """Rows of ``observed`` to rows of channels, in step order, the episodes (``key``) of one bucket per call."""

    def __init__(self, t: str, idle_ms: int | None = None, embed: Callable[[list[str]], np.ndarray] = models.embedded):
        self.t, self.idle_ms, self.embed = t, idle_ms, embed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.episodes = handle.getMapState("episodes", "key string", "at_ms long, last long, n long, results long, words array<string>, numbers binary")
        self.seen = handle.getMapState("seen", "key string, name string, args string", "first long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["key", self.t], kind="stable", ignore_index=True)
        now = timerValues.getCurrentProcessingTimeInMs() if self.idle_ms is not None else 0
        whole = map(namedtuple("Step", pdf.columns)._make, zip(*(pdf[c].tolist() for c in pdf.columns)))
        runs = {k: list(steps) for k, steps in groupby(whole, lambda r: r.key)}
        stored = {k: self.episodes.getValue((k,)) for k in runs if self.episodes.containsKey((k,))}
        heads = [steps[0] for k, steps in runs.items() if k not in stored]
        begun = {r.key: _Episode(a, r.anchor_words) for r, a in zip(heads, self.embed([r.anchor for r in heads]))} if heads else {}
        out = []
        for k, steps in runs.items():
            own, calls = begun.get(k) or _Episode.of(stored[k]), {}
            for r in steps:
                at = int(getattr(r, self.t))
                if at <= own.last:
                    out.append((k, at, None, None, None, None, None, True))
                    continue
                x, g = own.step(r, self._repeated(k, r.signatures, at, calls, k in begun))
                own.last = at
                out.append((k, at, r.e, r.u, r.m, x, g, False))
            self.episodes.updateValue((k,), own.row(now))
        if self.idle_ms is not None and not list(self.handle.listTimers()):
            self.handle.registerTimer(now + self.idle_ms)
        yield pd.DataFrame(out, columns=["key", self.t, *CHANNELS, "late"])

    def _repeated(self, key: str, signatures, at: int, calls: dict[tuple, int], begun: bool) -> int:
        """Calls of the step that an earlier step made already; the step's own are noted.  ``calls``: those of this batch."""
        repeats = 0
        for s in signatures if signatures is not None else ():
            call = (key, s["name"], s["args"])
            if call not in calls:
                if not begun and self.seen.containsKey(call):
                    calls[call] = self.seen.getValue(call)[0]
                else:
                    calls[call] = at
                    self.seen.updateValue(call, (at,))
            if calls[call] < at:
                repeats += 1
        return repeats

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Drops the episodes that have been silent for ``idle_ms``; the next timer is for the one silent longest."""
        now = timerValues.getCurrentProcessingTimeInMs()
        ends = {k[0]: row[0] + self.idle_ms for k, row in list(self.episodes.iterator())}
        gone = {k for k, end in ends.items() if end <= now}
        for call in [c for c in self.seen.keys() if c[0] in gone]:
            self.seen.removeKey(tuple(call))
        for k in gone:
            self.episodes.removeKey((k,))
        if len(gone) < len(ends):
            self.handle.registerTimer(min(end for k, end in ends.items() if k not in gone))
        yield from ()

    def close(self) -> None:
        pass


def typed_state(spark: SparkSession) -> None:
    """Choose the RocksDB state store, which typed state needs; the session's own choice of it stays."""
    if "RocksDB" not in spark.conf.get(STORE, ""):
        spark.conf.set(STORE, ROCKSDB)


def live_signals(steps: DataFrame, keys: Sequence[str], t: str, idle_ms: int | None = None,
                 embed: Callable[[list[str]], np.ndarray] = models.embedded, buckets: int = 256) -> DataFrame:
    """``keys, t, e, u, m, x, g, late`` per step of a stream in the log's own schema: what ``signal.signals`` gives for the log.

    Steps of one micro-batch are put in order; one at or before the last step taken
    changes nothing and comes out with ``late`` set and null channels.  ``idle_ms``
    drops the state of a silent episode (not for streams that end).  ``buckets`` stays what it is over restarts.
    """
    keys = list(keys)
    typed_state(steps.sparkSession)
    of = T.StructType([steps.schema[k] for k in keys])
    out = T.StructType([T.StructField("key", T.StringType()), T.StructField(t, T.LongType()),
                        *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in CHANNELS), T.StructField("late", T.BooleanType())])
    d = observed(steps, keys, t, embed).withColumn("key", F.to_json(F.struct(*keys), EXACT)).drop(*keys)
    got = d.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(
        Vectors(t, idle_ms, embed), out, "append", "None" if idle_ms is None else "ProcessingTime")
    got = got.withColumn("_of", F.from_json("key", of, EXACT))
    return got.select(*[F.col("_of")[k].alias(k) for k in keys], t, *CHANNELS, "late")
