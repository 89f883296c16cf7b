"""Self-calibrating healthy reference per deployment, as keyed state.

Each row is one completed run: its peak score, whether the deterministic
checks passed, and the fingerprint of the serving configuration.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = T.StructType([
    T.StructField("fingerprint", T.StringType()), T.StructField("scores", T.ArrayType(T.DoubleType())),
    T.StructField("offers", T.ArrayType(T.BooleanType())), T.StructField("rejected", T.LongType()),
    T.StructField("recalibrating", T.BooleanType())])

_OUT = [T.StructField("admitted", T.BooleanType()), T.StructField("state", T.StringType()),
        T.StructField("n", T.LongType()), T.StructField("rejected", T.LongType()),
        T.StructField("threshold", T.DoubleType()), T.StructField("realized_fa", T.DoubleType()),
        T.StructField("drift_fa", T.DoubleType())]


def _threshold(scores: list[float], budget: float, need: int) -> float | None:
    """Element at rank ceil((1 - budget)(n - 1)) once the budget is reachable."""
    n = len(scores)
    return sorted(scores)[math.ceil((1 - budget) * (n - 1))] if n >= need else None


def rolling_baseline(runs: DataFrame, keys: Sequence[str], order: str, budget: float = 0.10,
                     window: int = 200, drift_multiple: float = 2.0, admit_alarming: bool = False) -> DataFrame:
    """One snapshot row per run: admitted, state, threshold, in-sample and prequential rates.

    The state of a deployment is at most ``window`` scores, so a deployment
    with a huge share of the runs costs no more memory than any other.
    """
    keys = list(keys)
    need = math.ceil(1.0 / budget - 1.0)
    out = T.StructType([*[runs.schema[k] for k in keys], runs.schema[order], *_OUT])

    def drift(offers: list[bool]) -> float | None:
        return sum(offers) / len(offers) if len(offers) >= need else None

    def status(scores: list[float], offers: list[bool], recal: bool) -> str:
        if len(scores) < need:
            return "recalibrating" if recal else "warming_up"
        d = drift(offers)
        return "drifting" if d is not None and d > drift_multiple * budget else "trusted"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fp, scores, offers, rejected, recal = state.get if state.exists else (None, [], [], 0, False)
        scores, offers, rows = list(scores), list(offers), []
        pdf = pd.concat(list(frames)).sort_values(order)
        for o, score, ok, now in zip(pdf[order], pdf["score"], pdf["checks_passed"], pdf["fingerprint"]):
            if fp is not None and now != fp:
                scores, offers, rejected, recal = [], [], 0, True
            fp = now
            admitted = False
            theta = _threshold(scores, budget, need)
            alarmed = theta is not None and score > theta
            if ok and theta is not None:
                offers = [*offers, bool(alarmed)][-window:]
            if not ok or (alarmed and not admit_alarming and status(scores, offers, recal) == "trusted"):
                rejected += 1
            else:
                scores, admitted = [*scores, float(score)][-window:], True
                recal = recal and len(scores) < need
            theta = _threshold(scores, budget, need)
            real = None if theta is None else sum(s > theta for s in scores) / len(scores)
            rows.append((*key, o, admitted, status(scores, offers, recal), len(scores), rejected, theta, real, drift(offers)))
        state.update((fp, scores, offers, rejected, recal))
        yield pd.DataFrame(rows, columns=[f.name for f in out.fields])

    slim = runs.select(*keys, order, "score", "checks_passed", "fingerprint")
    return slim.groupBy(*keys).applyInPandasWithState(run, out, _STATE, "append", GroupStateTimeout.NoTimeout)
