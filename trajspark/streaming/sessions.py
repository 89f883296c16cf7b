"""Live sessions by event time, with a side table of late rows.

A session is a run of rows of one key with less than ``gap`` between neighbours.  It
is given out once the watermark (latest event time of the batches before, less the
delay) has reached its last row plus the gap; then its state goes.  A row behind the
watermark is late: it changes no session and comes out as a row of its own, so that
late rows can be counted exactly or replayed.  As no row that is taken can belong to
a session given out before, sessions are those of the rows in time.

Spark drops rows behind its own watermark before an operator sees them.  So its
watermark is set ``HORIZON`` further back, and the operator adds the horizon again;
timers are set back in the same way.  Rows older than that are dropped by Spark.

Keys are dealt over buckets, and a bucket is one call and one row of state per
batch, so a key costs its rows and its open sessions and no call of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trajspark.streaming.step_vectors import EXACT, typed_state

HORIZON_DAYS = 3650
_BACK = HORIZON_DAYS * 86_400_000  # in milliseconds


def merged(sessions: pd.DataFrame, gap: int) -> pd.DataFrame:
    """Sessions (``key, first, last, n``) of which overlapping or near ones of a key became one; times in microseconds."""
    s = sessions.sort_values(["key", "first"], kind="stable", ignore_index=True)
    far = s["last"].groupby(s["key"]).cummax()
    new = (s["key"] != s["key"].shift()) | (s["first"] - far.shift(fill_value=0) >= gap)
    return s.groupby(new.cumsum(), sort=False).agg(key=("key", "first"), first=("first", "first"), last=("last", "max"), n=("n", "sum"))


_STATE = T.StructType([T.StructField("key", T.ArrayType(T.StringType())), *(T.StructField(c, T.BinaryType()) for c in ("first", "last", "n"))])


def _held(state: GroupState) -> pd.DataFrame:
    key, *numbers = state.get if state.exists else ([], b"", b"", b"")
    return pd.DataFrame({"key": pd.Series(list(key), dtype=object)} | {c: np.frombuffer(v, np.int64) for c, v in zip(("first", "last", "n"), numbers)})


def live_sessions(rows: DataFrame, keys: Sequence[str], ts: str, row_id: str, *, gap_s: int, delay_s: int, buckets: int = 1024) -> DataFrame:
    """``keys, started, closed, n_rows, row_id, late``: closed sessions (``row_id`` null) and late rows.

    ``rows`` is a stream; ``row_id`` (any type) names a late row.  A null key is a key like others; rows without a time are
    left out.  The open sessions of a bucket of keys are one row of state; ``buckets`` stays what it is over restarts.
    """
    keys, gap = list(keys), gap_s * 1_000_000
    typed_state(rows.sparkSession)
    of = T.StructType([rows.schema[k] for k in keys])
    slim = rows.where(F.col(ts).isNotNull()).select(F.to_json(F.struct(*keys), EXACT).alias("key"), F.col(ts).cast("timestamp").alias("_ts"),
                                                    F.col(row_id).cast("string").alias("row_id"))
    slim = slim.withColumns({"bucket": F.pmod(F.xxhash64("key"), F.lit(buckets)), "at_us": F.unix_micros("_ts")})
    slim = slim.withWatermark("_ts", f"{HORIZON_DAYS * 86_400 + delay_s} seconds")
    out = T.StructType([T.StructField("key", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("started_us", "closed_us", "n_rows")),
                        T.StructField("row_id", T.StringType()), T.StructField("late", T.BooleanType())])

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        mark = (mark + _BACK) * 1000 if mark > 0 else None
        held = _held(state)
        for pdf in () if state.hasTimedOut else frames:
            behind = pdf["at_us"] < mark if mark is not None else pd.Series(False, index=pdf.index)
            late, at = pdf[behind], pdf.loc[~behind, "at_us"]
            held = merged(pd.concat([held, pd.DataFrame({"key": pdf.loc[~behind, "key"], "first": at, "last": at, "n": 1})]), gap)
            if len(late):
                yield pd.DataFrame({"key": late["key"], "started_us": late["at_us"], "closed_us": late["at_us"], "n_rows": 1,
                                    "row_id": late["row_id"], "late": True})
        over = held["last"] + gap <= mark if mark is not None else pd.Series(False, index=held.index)
        done, held = held[over], held[~over]
        if len(held):
            state.update((held["key"].tolist(), *(held[c].to_numpy(np.int64).tobytes() for c in ("first", "last", "n"))))
            # Spark calls once its watermark is past the timer: one millisecond less, as a session ends at the mark
            state.setTimeoutTimestamp(max(-(-int(held["last"].min() + gap) // 1000) - _BACK - 1, 1))
        elif state.exists:
            state.remove()
        if len(done):
            yield pd.DataFrame({"key": done["key"], "started_us": done["first"], "closed_us": done["last"] + gap, "n_rows": done["n"],
                                "row_id": None, "late": False})
    got = slim.groupBy("bucket").applyInPandasWithState(run, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    got = got.withColumn("_of", F.from_json("key", of, EXACT))
    return got.select(*[F.col("_of")[k].alias(k) for k in keys], F.timestamp_micros("started_us").alias("started"),
                      F.timestamp_micros("closed_us").alias("closed"), "n_rows", "row_id", "late")
