"""One Gaussian model per group, all groups in one pass over the rows.

A group's rows are summed up to what mean, covariance and shrinkage need: counts,
first moments, the upper triangle of second ones, and the sums of |x|^2 x and |x|^4.
Such sums add, so models of "all but fold k" or "all but folds j and k" come from the
folds' sums without another look at the rows.  Groups are solved and rows scored in
parallel; no model reaches the driver, and the number of groups has no bound.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.functions import hashing
from trajspark.operators import alarms, ranks
from trajspark.sources import sinks

#: Bytes of sums that a task holds before it gives them out.
HELD_BYTES = 64 << 20
#: Tasks among which the rows of one group may be dealt.
SALTS = 16


def _length(dims: int) -> int:
    return 3 + 2 * dims + dims * (dims + 1) // 2


def _sums(x: np.ndarray) -> np.ndarray:
    """[n, sum |x|^2, sum |x|^4, sum x, sum |x|^2 x, upper triangle of sum x x']."""
    q = (x * x).sum(1)
    return np.concatenate([[len(x), q.sum(), (q * q).sum()], x.sum(0), q @ x, (x.T @ x)[np.triu_indices(x.shape[1])]])


def gaussian(sums: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, covariance, precision (Ledoit-Wolf) and shrinkage from the sums of a group."""
    n, p = sums[0], dims
    m, s3 = sums[3:3 + p] / n, sums[3 + p:3 + 2 * p] / n
    s = np.zeros((p, p))
    s[np.triu_indices(p)] = sums[3 + 2 * p:] / n
    second = s + s.T - np.diag(np.diag(s))
    mm = float(m @ m)
    cov = second - np.outer(m, m)
    fourth = sums[2] / n - 4 * m @ s3 + 4 * m @ second @ m + 2 * mm * sums[1] / n - 4 * mm * mm + mm * mm
    mu, size = np.trace(cov) / p, (cov * cov).sum()
    delta, beta = size - p * mu * mu, (fourth - size) / n
    shrink = 0.0 if delta <= 0 else float(min(max(beta, 0.0), delta) / delta)
    precision = np.linalg.pinv((1.0 - shrink) * cov + shrink * mu * np.eye(p))
    return m, cov, precision, shrink


def moments(df: DataFrame, keys: Sequence[str], vec: str, dims: int) -> DataFrame:
    """``keys, sums``: one row per group (rows with a null vector are left out)."""
    keys = list(keys)
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    most = max(1, HELD_BYTES // (8 * _length(dims)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def given():
            return pd.DataFrame([(*k, v) for k, v in held.items()], columns=schema.fieldNames())

        for b in batches:
            for k, part in b.groupby(keys, dropna=False, sort=False):
                s = _sums(np.vstack(part[vec].to_numpy()))
                k = tuple(None if x is None or x is pd.NaT or x != x else x for x in k)
                held[k] = held[k] + s if k in held else s
            if len(held) >= most:
                yield given()
                held.clear()
        if held:
            yield given()

    return added(df.where(F.col(vec).isNotNull()).select(*keys, vec).mapInPandas(run, schema), keys)


def added(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``sums`` added up per group: first in ``SALTS`` shares of a group, then those."""
    keys = list(keys)
    schema = T.StructType([*(parts.schema[k] for k in keys), parts.schema["sums"]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1][[*keys]].copy()
        out["sums"] = [np.sum(np.vstack(pdf["sums"].to_numpy()), axis=0)]
        return out

    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("sums"), F.lit(SALTS)))
    shares = salted.groupBy(*keys, "_salt").applyInPandas(run, schema)
    return shares.groupBy(*keys).applyInPandas(run, schema)


def solved(sums: DataFrame, keys: Sequence[str], dims: int) -> DataFrame:
    """``keys, n_rows, mean, cov, precision`` (row by row) and ``shrinkage`` per group."""
    keys = list(keys)
    array = T.ArrayType(T.DoubleType())
    schema = T.StructType([*(sums.schema[k] for k in keys), T.StructField("n_rows", T.LongType()), T.StructField("mean", array),
                           T.StructField("cov", array), T.StructField("precision", array), T.StructField("shrinkage", T.DoubleType())])

    def run(batches):
        for b in batches:
            rows = []
            for s in b["sums"]:
                m, cov, precision, shrink = gaussian(np.asarray(s), dims)
                rows.append((int(s[0]), m, cov.ravel(), precision.ravel(), shrink))
            yield pd.concat([b[keys].reset_index(drop=True), pd.DataFrame(rows, columns=["n_rows", "mean", "cov", "precision", "shrinkage"])], axis=1)

    return sums.mapInPandas(run, schema)


def scored(df: DataFrame, models: DataFrame, keys: Sequence[str], vec: str, out: str = "score", keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the Mahalanobis distance of ``vec`` in its group's model (null without one).

    Rows of a group are dealt among ``SALTS`` tasks; each gets one copy of the model, which comes first in the sort.
    ``keep``: columns to give out, all by default; they pass as Arrow columns and are never turned into Python objects.
    """
    keys, columns = list(keys), list(keep if keep is not None else df.columns)
    salt = F.pmod(F.xxhash64(vec), F.lit(SALTS)).cast("int")
    own = models.select(*keys, "mean", "precision").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("_kind", F.lit(0))
    slim = df.select(*dict.fromkeys([*columns, *keys, vec]))
    both = slim.withColumns({"_salt": salt, "_kind": F.lit(1)}).unionByName(own, allowMissingColumns=True)
    schema = T.StructType([*(df.schema[c] for c in columns), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mean, precision = None, None, None
        for b in batches:
            by = pa.Table.from_batches([b]).select([*keys, "_salt", "_kind"]).to_pandas()
            code, kind = by.groupby([*keys, "_salt"], dropna=False, sort=False).ngroup().to_numpy(), by["_kind"].to_numpy()
            cut = np.flatnonzero((code[1:] != code[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(kind)]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                here = tuple(part.column(k)[0].as_py() for k in [*keys, "_salt"])
                if here != at:
                    at, mean = here, None
                if kind[lo] == 0:
                    mean = np.array(part.column("mean")[0].as_py())
                    precision = np.array(part.column("precision")[0].as_py()).reshape(len(mean), -1)
                    continue
                score = np.full(hi - lo, np.nan)
                fine = part.column(vec).is_valid().to_numpy(zero_copy_only=False)
                if mean is not None and fine.any():
                    x = part.column(vec).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(fine.sum(), -1) - mean
                    score[fine] = np.sqrt(np.maximum(((x @ precision) * x).sum(1), 0.0))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(score, from_pandas=True)], [*columns, out])

    return both.repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt", "_kind").mapInArrow(run, schema)


def calibrated(steps: DataFrame, runs: DataFrame, by: Sequence[str], key: str, vec: str, dims: int, budget: float = 0.05) -> DataFrame:
    """A model and a threshold per deployment from its own healthy runs, or a refusal.

    ``runs`` (``by``, ``key``) are the healthy runs; 60 of 100 are fitted on, 20 give the threshold, 20 are left for the
    caller (``split``).  One row per deployment: ``n_healthy, n_val, n_rows, mean, cov, precision, theta, refused, warn``;
    a refused one has a reason and no model.
    """
    by = list(by)
    r = ranks.hash_order(runs.select(*by, key).withColumn("_u", hashing.uniform("deploy", F.col(key))), by, "_u", "_r")
    lo = F.greatest(F.rint(F.col("_r_total") * 0.6), F.lit(1.0))
    hi = lo + F.greatest(F.rint(F.col("_r_total") * 0.2), F.lit(1.0))
    parts = r.select(*by, key, F.when(F.col("_r") < lo, "train").when(F.col("_r") < hi, "val").otherwise("test").alias("split"))
    s = steps.select(*by, key, vec).join(parts, [*by, key])
    fit = solved(moments(s.where("split = 'train'"), by, vec, dims), by, dims)
    val = scored(s.where("split = 'val'"), fit, by, vec, keep=[*by, key])
    peaks = val.groupBy(*by, key).agg(F.max("score").alias("peak"))
    th = alarms.pick_threshold(peaks, by, "peak", budget).select(*by, F.col("n").alias("n_val"), "theta")
    n = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_healthy"))
    out = n.join(fit, by, "left").join(th, by, "left")
    bad = F.when(F.col("n_healthy") < alarms.MIN_HEALTHY, "too few healthy runs").when(
        F.col("theta").isNull() | (F.col("theta") <= 0), "degenerate threshold")
    kept = {c: F.when(bad.isNull(), F.col(c)) for c in ("mean", "cov", "precision", "theta")}
    return out.select(*by, "n_healthy", "n_val", "n_rows", bad.alias("refused"), (F.col("n_healthy") < alarms.RECOMMENDED_HEALTHY).alias("warn"),
                      *(c.alias(name) for name, c in kept.items()))


def without_folds(sums: DataFrame, by: Sequence[str], fold: str, k: int) -> DataFrame:
    """``by, i, j, sums`` for i <= j: the sums of all folds but i and j, from the sums per fold."""
    sets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(k) for j in range(i, k)))
    d = sums.withColumn("_s", F.explode(F.filter(sets, lambda s: (s["i"] != F.col(fold)) & (s["j"] != F.col(fold)))))
    return added(d.select(*by, F.col("_s.i").alias("i"), F.col("_s.j").alias("j"), "sums"), [*by, "i", "j"])


def nested(steps: DataFrame, runs: DataFrame, key: str, vec: str, dims: int, k: int, salt: str, budget: float) -> DataFrame:
    """Alarm of each run at a threshold that saw neither it nor, through any model, its fold.

    ``runs``: ``key`` and ``is_healthy``.  Runs fall into ``k`` folds.  A run of fold f is scored by the model of all healthy
    runs outside f.  Its threshold comes from the healthy runs of each other fold g, scored by the model that saw neither
    f nor g.  One row per run: ``key, fold, peak, theta, alarm, reason``; where the other folds give no score or threshold
    the alarm is null and the reason says so.
    """
    r = runs.select(key, "is_healthy").withColumn("fold", hashing.fold_of(F.col(key), k, salt))
    s = steps.select(key, vec).join(r, key)
    models = solved(without_folds(moments(s.where("is_healthy"), ["fold"], vec, dims), [], "fold", k), ["i", "j"], dims)
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda x: F.col("is_healthy") | (x == F.col("fold")))
    s = s.withColumn("held", F.explode(others)).withColumns({"i": F.least("fold", "held").cast("int"), "j": F.greatest("fold", "held").cast("int")})
    each = scored(s, models, ["i", "j"], vec, keep=[key, "fold", "held"])
    peaks = sinks.materialize(each.groupBy(key, "fold", "held").agg(F.max("score").alias("peak")), "nested_peaks")  # read for levels and for runs
    th = alarms.pick_threshold(peaks.where("fold <> held AND peak IS NOT NULL"), ["held"], "peak", budget).select(F.col("held").alias("fold"), "theta")
    own = peaks.where("fold = held").select(key, "fold", "peak")
    reason = F.when(F.col("peak").isNull(), "no model").when(F.col("theta").isNull(), "no threshold")
    return own.join(th, "fold", "left").select(key, "fold", "peak", "theta", F.when(reason.isNull(), F.col("peak") > F.col("theta")).alias("alarm"),
                                               reason.alias("reason"))
