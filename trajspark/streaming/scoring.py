"""Causal per-step scoring of live trajectories, keyed by episode.

A stream row is one step.  State per open episode is a handful of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = T.StructType([T.StructField("n", T.LongType()), T.StructField("last", T.LongType()), T.StructField("prev", T.DoubleType()),
                       T.StructField("ewma", T.DoubleType()), T.StructField("cusum", T.DoubleType()),
                       T.StructField("peak", T.DoubleType())])


def output_schema(df: DataFrame, keys: Sequence[str], t: str) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in keys], df.schema[t],
                         *[T.StructField(c, T.DoubleType()) for c in ("delta", "ewma", "cusum", "peak")],
                         T.StructField("late", T.BooleanType())])


def stateful_scores(steps: DataFrame, keys: Sequence[str], t: str, z: str, alpha: float = 0.3,
                    slack: float = 0.5, idle_ms: int | None = None) -> DataFrame:
    """delta, EWMA of |z| (first-value start), CUSUM of z and its running peak.

    ``idle_ms`` drops the state of a silent episode.  Such a query never runs
    dry, so it is for continuous triggers, not for "process what is there".
    Steps of one micro-batch are put in order before they are applied, so the
    values equal those of the batch operators on the same rows.  A step from a
    position that was passed already (or a repeated one) changes nothing: it comes
    out with ``late`` set and null scores, for the caller to count or reject.
    """
    keys = list(keys)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last, prev, ew, cu, peak = state.get if state.exists else (0, -1, 0.0, 0.0, 0.0, 0.0)
        pdf = pd.concat(list(frames)).sort_values(t)
        rows = []
        for at, v in zip(pdf[t].tolist(), pdf[z].to_numpy(float)):
            if at <= last:
                rows.append((None, None, None, None, True))
                continue
            delta = v - prev if n else 0.0
            ew = alpha * abs(v) + (1 - alpha) * ew if n else abs(v)
            cu = max(0.0, cu + v - slack)
            peak = max(peak, cu)
            n, last, prev = n + 1, at, v
            rows.append((delta, ew, cu, peak, False))
        state.update((n, int(last), float(prev), float(ew), float(cu), float(peak)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        out = pd.DataFrame(rows, columns=["delta", "ewma", "cusum", "peak", "late"])
        out.insert(0, t, pdf[t].to_numpy())
        for i, k in enumerate(keys):
            out.insert(i, k, key[i])
        yield out

    slim = steps.select(*keys, t, z)
    return slim.groupBy(*keys).applyInPandasWithState(
        run, output_schema(slim, keys, t), _STATE, "append",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def alarms(scored: DataFrame, score: str, theta: float, unit: float | None = None) -> DataFrame:
    """Online alarm with the score in display units (1.0 = alarm)."""
    scale = F.lit(unit if unit is not None else theta)
    return scored.withColumns({"display": F.col(score) / scale, "alarm": F.col(score) > F.lit(theta)})


def gate(behaviour: Column, content: Column, trip: Column, lexical: Column) -> Column:
    """Display score of the content gate; a lexical miss overrides."""
    from trajspark.operators import fusion
    return fusion.content_gate(behaviour, content, trip, lexical)


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that is there, append it as Parquet, stop."""
    q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start(path)
    q.awaitTermination()
