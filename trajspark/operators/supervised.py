"""Supervised fusion of score streams, judged on runs that neither fit nor level has seen.

Logistic weights of all fold combinations are found together: each Newton step is one
pass over the rows that adds up gradient and curvature per combination, so nothing
but sums of the models' size reaches the driver, whatever the number of folds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.functions import hashing, stats
from trajspark.operators import alarms, fusion

#: Weight of half the squared coefficients (not the intercept), Newton steps at most, and when they end.
PENALTY, STEPS, DONE = 1.0, 30, 1e-8


def equalised(streams: DataFrame, levels: dict[str, float], lexical: str | None, clip: float = fusion.GROUNDED_CLIP) -> list[Column]:
    """Each stream in units of its healthy-rare level and clipped; the lexical flag as it is."""
    out = [F.greatest(F.least(F.col(c) / F.lit(q), F.lit(clip)), F.lit(-clip)) for c, q in levels.items()]
    return out + ([F.col(lexical).cast("double")] if lexical else [])


def _at(arrays: list[list[float]], i: Column) -> Column:
    return F.element_at(F.array(*(F.array(*map(F.lit, a)) for a in arrays)), i + 1)


def fit_without(rows: DataFrame, x: str, n: int, label: str, fold: str, left_out: Sequence[frozenset[int]]) -> list[np.ndarray | None]:
    """Class-balanced logistic weights (intercept last) for each set of folds left out; None where only one class is left.

    ``x``: array of ``n`` features.
    """
    sets = F.array(*(F.array(*(F.lit(f) for f in sorted(s))) for s in left_out))
    d = rows.select(F.concat(F.col(x), F.array(F.lit(1.0))).alias("_x"), F.col(label).cast("double").alias("_y"), F.explode(F.filter(
        F.transform(sets, lambda s, i: F.when(~F.array_contains(s, F.col(fold).cast("int")), i)), lambda i: i.isNotNull())).alias("_s"))
    counts = {r["_s"]: (r["n"], r["p"]) for r in d.groupBy("_s").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("p")).collect()}
    live = [k for k in range(len(left_out)) if k in counts and 0 < counts[k][1] < counts[k][0]]
    w = np.zeros((len(left_out), n + 1))
    balance = [[c[0] / (2 * (c[0] - c[1])), c[0] / (2 * c[1])] if k in live else [0.0, 0.0]
               for k in range(len(left_out)) for c in [counts.get(k, (0, 0))]]
    d = d.filter(F.col("_s").isin(live)).withColumn("_c", F.element_at(_at(balance, F.col("_s")), F.col("_y").cast("int") + 1))
    todo, pairs = set(live), [(i, j) for i in range(n + 1) for j in range(i, n + 1)]
    for _ in range(STEPS if live else 0):
        now = _at(w.tolist(), F.col("_s"))
        p = 1.0 / (1.0 + F.exp(-F.aggregate(F.zip_with("_x", now, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)))
        e = d.filter(F.col("_s").isin(sorted(todo))).withColumn("_p", p)
        sums = e.groupBy("_s").agg(
            *(F.sum(F.col("_c") * (F.col("_p") - F.col("_y")) * F.col("_x")[i]).alias(f"g{i}") for i in range(n + 1)),
            *(F.sum(F.col("_c") * F.col("_p") * (1 - F.col("_p")) * F.col("_x")[i] * F.col("_x")[j]).alias(f"h{i}_{j}") for i, j in pairs)).collect()
        for r in sums:
            k, own = r["_s"], np.append(np.full(n, PENALTY), 0.0)
            h = np.diag(own)
            for i, j in pairs:
                h[i, j] += r[f"h{i}_{j}"]
                h[j, i] = h[i, j]
            step = np.linalg.solve(h, np.array([r[f"g{i}"] for i in range(n + 1)]) + own * w[k])
            w[k] -= step
            if np.abs(step).max() < DONE * max(1.0, np.abs(w[k]).max()):
                todo.discard(k)
        if not todo:
            break
    return [w[k] if k in live else None for k in range(len(left_out))]


@F.pandas_udf(T.DoubleType())
def _tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Chance of ``k`` or more of ``n`` at rate ``p``."""
    return pd.Series([stats._binom_tail_ge(int(a), int(b), float(c)) if a > 0 else 1.0 for a, b, c in zip(k, n, p)])


def judged(steps: DataFrame, runs: DataFrame, key: str, t: str, x: str, n: int, k: int, salt: str, budget: float,
           sure: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(runs, folds): alarms of a supervised fusion, and whether each fold's level holds on a clean null.

    ``steps``: ``key``, ``t`` and ``n`` features ``x``; ``runs``: ``key``, ``is_healthy``, ``tau``.  Steps of an unhealthy run
    from tau on are positive.  The model of fold f is fitted without f and the fold g after it; its level comes from the
    healthy runs of g, and the healthy runs of f are the null.  If so many of them alarm that a rate of ``budget`` would show
    that with a chance under ``sure``, the fold is refused: its runs have no alarm but the reason.  So has a fold without
    both classes, or without healthy runs to set a level on.  ``k`` is 3 or more.
    """
    if k < 3:
        raise ValueError("three folds at least: one to fit on, one for the level, one to judge")
    r = runs.select(key, "is_healthy", "tau").withColumn("fold", hashing.fold_of(F.col(key), k, salt))
    s = steps.select(key, t, x).join(r, key).withColumn("_y", (~F.col("is_healthy") & (F.col(t) >= F.col("tau"))).cast("int"))
    weights = fit_without(s, x, n, "_y", "fold", [frozenset((f, (f + 1) % k)) for f in range(k)])
    known = [f for f in range(k) if weights[f] is not None]
    flat = [w.tolist() if w is not None else [0.0] * (n + 1) for w in weights]
    # a run is scored by its own fold's model, a healthy one also by that of the fold before, whose level it helps to set
    models = F.when(F.col("is_healthy"), F.array(F.col("fold"), F.pmod(F.col("fold") + k - 1, F.lit(k)))).otherwise(F.array("fold"))
    e = s.withColumn("model", F.explode(models)).filter(F.col("model").isin(known))
    logit = F.aggregate(F.zip_with(F.concat(F.col(x), F.array(F.lit(1.0))), _at(flat, F.col("model")), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    peaks = e.groupBy(key, "is_healthy", "fold", "model").agg(F.max(logit).alias("peak"))
    th = alarms.pick_threshold(peaks.filter("fold <> model"), ["model"], "peak", budget).select("model", F.col("n").alias("n_level"), "theta")
    own = r.join(peaks.filter("fold = model").select(key, "peak"), key, "left").join(th.withColumnRenamed("model", "fold"), "fold", "left")
    null = own.filter("is_healthy AND peak IS NOT NULL AND theta IS NOT NULL").groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_null"), F.sum((F.col("peak") > F.col("theta")).cast("int")).alias("n_alarms"))
    folds = null.withColumn("p_null", _tail("n_alarms", "n_null", F.lit(budget))).withColumn("refused", F.col("p_null") < sure)
    folds = folds.join(th.withColumnRenamed("model", "fold"), "fold")
    out = own.join(folds.select("fold", "refused"), "fold", "left")
    reason = F.when(~F.col("fold").isin(known), "no model").when(F.col("theta").isNull(), "no level").when(F.col("peak").isNull(), "no steps").when(
        F.col("refused"), "null not clean").when(F.col("refused").isNull(), "no null")
    return (out.select(key, "fold", "is_healthy", "peak", "theta", F.when(reason.isNull(), F.col("peak") > F.col("theta")).alias("alarm"), reason.alias("reason")),
            folds.select("fold", "n_level", "theta", "n_null", "n_alarms", "p_null", "refused"))
