"""Model scorers: distributed sufficient statistics, small solves, Arrow scoring.

Fits reduce the steps to matrices of model size (features x features) inside
the tasks; only their sum reaches the driver.  Scoring ships the small model
to the tasks.  Ordered models run per (episode, segment) with a warm-up of
earlier steps, so a long episode is spread over tasks.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark import schema
from trajspark.functions import text as texts
from trajspark.functions.hashing import uniform
from trajspark.operators import fit, ordered, ranks
from trajspark.sources import sinks

# ---- fixed values -----------------------------------------------------------
WASHOUT = schema.WASHOUT_STEPS
RESERVOIR = {"K": 8, "size": 128, "radius": 0.9, "leak": 0.3, "input": 0.5, "density": 0.1,
             "ridge": 1e-2, "beta": 0.5, "alpha": 0.35, "slack": 0.5}
#: most columns of a quadratic block that one task's matrix of sums takes
MAX_QUADRATIC_COLUMNS = 4096
#: share of a reservoir's start that may be left when a segment begins, and rows of a segment
FORGOTTEN = 1e-12
SEG_ROWS = 8192

_GRAM = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("i", T.IntegerType()),
                      T.StructField("row", T.ArrayType(T.DoubleType()))])


def _matrix(s: pd.Series) -> np.ndarray:
    return np.vstack(s.to_numpy()) if len(s) else np.zeros((0, 0))


# --------------------------------------------------------- sums of outer products
def gram(df: DataFrame, build: Callable[[pd.DataFrame], Iterator[tuple[int, np.ndarray, np.ndarray]]],
         cols: int) -> dict[int, np.ndarray]:
    """Sum of left' * right per part id, as model-sized matrices.

    Every task adds up its own matrices; the rows of the matrices are then
    summed element-wise by a normal aggregate.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, left, right in build(b):
                g = left.T @ right
                total[part] = total[part] + g if part in total else g
        for part, g in total.items():
            yield pd.DataFrame({"part": np.int32(part), "i": np.arange(len(g), dtype=np.int32), "row": list(g)})

    rows = df.mapInPandas(run, _GRAM).groupBy("part", "i").agg(
        F.array(*[F.sum(F.col("row")[j]) for j in range(cols)]).alias("row"))
    out: dict[int, list] = {}
    for r in rows.collect():
        out.setdefault(r["part"], []).append((r["i"], r["row"]))
    return {p: np.array([x for _, x in sorted(v)]) for p, v in out.items()}


# ---------------------------------------------------------------- Mahalanobis
@dataclass(frozen=True)
class Gaussian:
    mean: np.ndarray
    precision: np.ndarray
    shrinkage: float


def fit_gaussian(df: DataFrame, vec: str, n_dims: int) -> Gaussian:
    """Ledoit-Wolf mean and precision in two passes (centre, then moments)."""
    first = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(vec)[i]).alias(f"m{i}") for i in range(n_dims)]).first()
    n, mean = first["n"], np.array([first[f"m{i}"] for i in range(n_dims)])

    def build(b: pd.DataFrame):
        x = _matrix(b[vec]) - mean
        yield 0, x, x
        sq = (x * x).sum(axis=1)
        yield 1, sq[:, None], np.repeat(sq[:, None], n_dims, axis=1) / n_dims
    g = gram(df.select(vec), build, n_dims)
    s = g[0] / n
    p = n_dims
    mu = np.trace(s) / p
    delta = (s * s).sum() - p * mu * mu
    beta = (g[1].sum() / n - (s * s).sum()) / n
    shrink = 0.0 if delta <= 0 else float(min(max(beta, 0.0), delta) / delta)
    cov = (1.0 - shrink) * s
    cov[np.diag_indices(p)] += shrink * mu
    return Gaussian(mean, np.linalg.pinv(cov), shrink)


def mahalanobis(vec: Column, model: Gaussian) -> Column:
    mean, prec = model.mean, model.precision

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        d = _matrix(x) - mean
        return pd.Series(np.sqrt(np.maximum(np.einsum("ij,ij->i", d @ prec, d), 0.0)))
    return score(vec)


def with_delta(df: DataFrame, keys: Sequence[str], t: str, vec: str, out: str) -> DataFrame:
    """[z ; z - previous z], the first difference being zero."""
    j = ordered.lag(df, keys, t, {"_pv": vec})
    d = F.zip_with(F.col(vec), F.coalesce("_pv", vec), lambda a, b: a - b)
    return j.withColumn(out, F.concat(F.col(vec), d)).drop("_pv")


def standardize(df: DataFrame, healthy: DataFrame, vec: str, n_dims: int, out: str) -> DataFrame:
    """Z-scored vectors; the reference is one row of healthy means and scales."""
    st = healthy.agg(
        F.array(*[F.avg(F.col(vec)[i]) for i in range(n_dims)]).alias("_m"),
        F.array(*[fit.floored_scale(F.stddev_pop(F.col(vec)[i])) for i in range(n_dims)]).alias("_sd"))
    return df.crossJoin(F.broadcast(st)).withColumn(out, F.zip_with(
        F.zip_with(F.col(vec), F.col("_m"), lambda a, m: a - m), F.col("_sd"), lambda a, s: a / s)).drop("_m", "_sd")


# ----------------------------------------------------- ordered runs inside tasks
#: tasks per core: a reservoir's row is dear, so bytes say nothing about how many tasks it takes
TASKS_PER_CORE = 4


def clustered(df: DataFrame, keys: Sequence[str], t: str, warmup: int, seg_rows: int = SEG_ROWS) -> DataFrame:
    """Rows sorted by (episode, segment, t) inside tasks, with warm-up copies (segments are never shorter than those)."""
    lb = ordered.look_back(df, keys, t, warmup, max(seg_rows, warmup))
    tasks = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return lb.df.repartition(tasks, *keys, "_seg").sortWithinPartitions(*keys, "_seg", t)


@dataclass(frozen=True)
class Runs:
    """Whole (episode, segment) runs one after the other: their rows, and of each run its first row and its length."""

    table: pa.Table
    first: np.ndarray
    length: np.ndarray

    def numbers(self, name: str) -> np.ndarray:
        return self.table.column(name).to_numpy()

    def vectors(self, name: str) -> np.ndarray:
        flat = self.table.column(name).combine_chunks().flatten()
        return flat.to_numpy(zero_copy_only=False).reshape(self.table.num_rows, -1)

    @property
    def follows(self) -> np.ndarray:
        """Rows with one before them in their run."""
        out = np.ones(self.table.num_rows, bool)
        out[self.first] = False
        return out


def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = 4096) -> Iterator[Runs]:
    """The sorted rows of a task as whole runs, about ``rows`` rows or a batch at a time."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> Iterator[Runs]:
        table = pa.Table.from_batches(held).combine_chunks()
        n = table.num_rows
        new = np.zeros(n, bool)
        new[0] = True
        for c in (*keys, "_seg"):
            v = table.column(c).combine_chunks()
            none = v.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= pc.fill_null(pc.not_equal(v[1:], v[:-1]), False).to_numpy(zero_copy_only=False) | (none[1:] != none[:-1])
        first = np.flatnonzero(new)
        end = n if last else int(first[-1])
        if end:
            first = first if last else first[:-1]
            yield Runs(table.slice(0, end), first, np.diff(first, append=end))
        held[:] = table.slice(end).to_batches() if end < n else []

    for b in batches:
        if b.num_rows:
            held.append(b)
            if sum(h.num_rows for h in held) >= rows:
                yield from cut(False)
    if held:
        yield from cut(True)


def spectral_radius(w: np.ndarray, doublings: int = 14) -> float:
    """Growth per step of the powers of ``w``, by squaring."""
    log, m = 0.0, w
    for i in range(doublings):
        n = np.linalg.norm(m)
        if n == 0.0:
            return 0.0
        log += np.log(n) / 2.0 ** i
        m = (m / n) @ (m / n)
    return float(np.exp(log))


class Reservoirs:
    """K leaky-tanh reservoirs.  A state holds the units, the input and a constant 1 side by
    side, so one matrix drives the units and the state itself is what readouts see."""

    def __init__(self, n_in: int, k: int, size: int, seed: int, radius: float, leak: float,
                 scale: float, density: float) -> None:
        self.k, self.size, self.n_in, self.leak = k, size, n_in, leak
        self.width = size + n_in + 1
        self.drive = np.zeros((k, self.width, size))
        for j, own in enumerate(self.drive):
            rng = np.random.default_rng([seed, n_in, size, j])
            links = rng.choice(size * size, rng.binomial(size * size, density), replace=False)
            units = np.zeros(size * size)
            units[links] = rng.standard_normal(len(links))
            own[:size] = units.reshape(size, size)
            own[:size] *= radius / (spectral_radius(own[:size]) or 1.0)
            own[size:-1] = scale * rng.choice((-1.0, 1.0), (n_in, size))
        keeps = 1.0 - leak * (1.0 - radius)
        if not 0.0 <= keeps < 1.0:
            raise ValueError("leak and radius give a reservoir that does not forget its start")
        #: steps after which what is left of a start is below FORGOTTEN
        self.warmup = int(np.ceil(np.log(FORGOTTEN) / np.log(max(keeps, 1e-9))))

    def walk(self, runs: Runs, inputs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All runs in lockstep: (rows, their states (K, rows, size + inputs + 1)), overwritten by the next step."""
        order = np.argsort(-runs.length, kind="stable")
        first, length = runs.first[order], runs.length[order]
        now = np.zeros((self.k, len(first), self.width))
        now[..., -1] = 1.0
        pulled, twice = np.empty((self.k, len(first), self.size)), 2.0 * self.drive
        with np.errstate(over="ignore"):
            for s in range(int(length[0])):
                live = int(np.searchsorted(-length, -s))
                rows, at, x = first[:live] + s, now[:, :live], pulled[:, :live]
                at[..., self.size:-1] = inputs[rows]
                np.matmul(at, twice, out=x)
                # leak * tanh(y) = leak - 2 leak / (exp(2 y) + 1), which takes less than half the time of tanh
                np.exp(x, out=x)
                x += 1.0
                np.divide(2.0 * self.leak, x, out=x)
                units = at[..., :self.size]
                units *= 1.0 - self.leak
                units += self.leak
                units -= x
                yield rows, at


@dataclass(frozen=True)
class EchoState:
    """A fitted ensemble: readouts, residual scales and score normalisers."""

    res: Reservoirs
    readout: np.ndarray            # (K, F, D)
    sigma: np.ndarray              # (D,)
    sup: tuple[float, float]
    dis: tuple[float, float]
    first: int = 0                 # where its inputs begin in the vector of a step

    def inputs(self, vectors: np.ndarray) -> np.ndarray:
        return vectors[:, self.first:self.first + self.res.n_in]

    def predicted(self, runs: Runs, inputs: np.ndarray) -> np.ndarray:
        """(rows, K, D): what each member expects at a row from the row before; 0 at the first of a run."""
        out = np.zeros((len(inputs) + 1, self.res.k, self.res.n_in))
        for rows, at in self.res.walk(runs, inputs):
            out[rows + 1] = (at @ self.readout).transpose(1, 0, 2)
        out[runs.first] = 0.0
        return out[:-1]


class _Products:
    """Sums of state' * [state, next input] per member, added up in blocks of states."""

    def __init__(self, k: int, width: int, n_in: int, rows: int = 4096):
        self.sums = np.zeros((k, width, width + n_in))
        self.left, self.right, self.n = np.empty((k, rows, width)), np.empty((rows, n_in)), 0

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        while len(right):
            m = min(len(right), len(self.right) - self.n)
            self.left[:, self.n:self.n + m], self.right[self.n:self.n + m] = left[:, :m], right[:m]
            left, right, self.n = left[:, m:], right[m:], self.n + m
            if self.n == len(self.right):
                self.flush()

    def flush(self) -> np.ndarray:
        for own, left in zip(self.sums, self.left[:, :self.n]):
            own[:, :left.shape[1]] += left.T @ left
            own[:, left.shape[1]:] += left.T @ self.right[:self.n]
        self.n = 0
        return self.sums


def fit_echo_state(steps: DataFrame, parts: DataFrame, keys: Sequence[str], t: str, vec: str, n_in: int,
                   seed: int = 0, **over) -> EchoState:
    """Next-step ridge readouts on ``part = 'fit'``, normalisers on 'held'.

    Features at t predict t + 1; the first predicted step is the washout.
    """
    return fit_echo_states(steps, parts, keys, t, vec, {"": (0, n_in, seed)}, **over)[""]


def fit_echo_states(steps: DataFrame, parts: DataFrame, keys: Sequence[str], t: str, vec: str,
                    channels: dict[str, tuple[int, int, int]], **over) -> dict[str, EchoState]:
    """One ensemble per channel (first number of it in ``vec``, how many, seed); all of them take each pass together."""
    cfg = {**RESERVOIR, **over}
    keys = list(keys)
    blank = {c: EchoState(Reservoirs(n, cfg["K"], cfg["size"], seed, cfg["radius"], cfg["leak"], cfg["input"], cfg["density"]),
                          np.zeros(0), np.ones(n), (0.0, 1.0), (0.0, 1.0), first) for c, (first, n, seed) in channels.items()}
    warmup = max(m.res.warmup for m in blank.values())

    def part(name: str) -> DataFrame:
        return steps.join(parts.filter(F.col("part") == name).select(*keys), keys, "left_semi").select(*keys, t, vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [_Products(m.res.k, m.res.width, m.res.n_in) for m in blank.values()]
        for r in _runs(batches, keys):
            z = r.vectors(vec)
            # a row is used if the one after it is its run's own and behind the washout
            use = np.append((r.follows & (r.numbers(t) >= WASHOUT) & r.numbers("_own"))[1:], False)
            for m, sums in zip(blank.values(), total):
                u = m.inputs(z)
                for rows, at in m.res.walk(r, u):
                    on = use[rows]
                    if on.all():
                        sums.add(at, u[rows + 1])
                    elif on.any():
                        sums.add(at[:, on], u[rows[on] + 1])
        for c, sums in enumerate(total):
            for k, m in enumerate(sums.flush()):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(m), c * cfg["K"] + k, np.int32)), pa.array(np.arange(len(m), dtype=np.int32)), pa.array(list(m))], _GRAM.names)
    width = max(m.res.width + m.res.n_in for m in blank.values())
    sums = clustered(part("fit"), keys, t, warmup).mapInArrow(run, _GRAM).groupBy("part", "i").agg(
        F.array(*[F.sum(F.get("row", F.lit(j))) for j in range(width)]).alias("row")).collect()
    fitted = {}
    for c, (name, m) in enumerate(blank.items()):
        f, mats = m.res.width, np.zeros((m.res.k, m.res.width, m.res.width + m.res.n_in))
        for r in sums:
            if r["part"] // m.res.k == c:
                mats[r["part"] % m.res.k, r["i"]] = r["row"][:f + m.res.n_in]
        readout = np.stack([np.linalg.solve(x[:, :f] + cfg["ridge"] * np.eye(f), x[:, f:]) for x in mats])
        fitted[name] = replace(m, readout=readout)

    mom = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()),
                        T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("q", T.ArrayType(T.DoubleType()))])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _runs(batches, keys):
            z, use = r.vectors(vec), r.follows & (r.numbers(t) >= WASHOUT) & r.numbers("_own")
            for c, m in enumerate(fitted.values()):
                u = m.inputs(z)
                e = (m.predicted(r, u) - u[:, None])[use]
                yield pa.RecordBatch.from_arrays([
                    pa.array([c], pa.int32()), pa.array([e.shape[0] * e.shape[1]], pa.int64()),
                    pa.array([e.sum(axis=(0, 1))]), pa.array([(e * e).sum(axis=(0, 1))])], mom.names)
    most = max(m.res.n_in for m in fitted.values())
    for r in clustered(part("held"), keys, t, warmup).mapInArrow(moments, mom).groupBy("part").agg(
            F.sum("n").alias("n"), *[F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in "sq" for i in range(most)]).collect():
        name = list(fitted)[r["part"]]
        s, q = (np.array([r[f"{c}{i}"] for i in range(fitted[name].res.n_in)]) / r["n"] for c in "sq")
        sd = np.sqrt(np.maximum(q - s ** 2, 0.0))
        fitted[name] = replace(fitted[name], sigma=np.where(sd < schema.DEGENERATE_EPS, 1.0, np.maximum(sd, 1e-3)))
    # written once: the quantiles read it several times
    raw = sinks.materialize(echo_states_raw(part("held"), keys, t, vec, fitted), "echo_state_held")
    long = raw.select(F.inline(F.array(*[F.struct(F.lit(c).alias("s"), F.col(c).alias("v")) for m in fitted for c in _raw_names(m)])))
    loc = {r["s"]: (r["loc"], r["scale"]) for r in fit.robust_iqr(long.filter("v IS NOT NULL"), ["s"], "v").collect()}
    return {name: replace(m, **{s: loc[c] for s, c in zip(("sup", "dis"), _raw_names(name))}) for name, m in fitted.items()}


def _raw_names(channel: str) -> tuple[str, str]:
    return (f"{channel}_sup", f"{channel}_dis") if channel else ("sup", "dis")


def echo_state_raw(steps: DataFrame, keys: Sequence[str], t: str, vec: str, model: EchoState) -> DataFrame:
    """Raw surprise and disagreement per step; null inside the washout."""
    return echo_states_raw(steps, keys, t, vec, {"": model})


def echo_states_raw(steps: DataFrame, keys: Sequence[str], t: str, vec: str, ensembles: dict[str, EchoState]) -> DataFrame:
    """``<channel>_sup`` and ``<channel>_dis`` per step, all channels in one pass."""
    keys = list(keys)
    d = clustered(steps.select(*keys, t, vec), keys, t, max(m.res.warmup for m in ensembles.values()))
    out = T.StructType([*[d.schema[k] for k in keys], d.schema[t],
                        *[T.StructField(c, T.DoubleType()) for name in ensembles for c in _raw_names(name)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _runs(batches, keys):
            z, own = r.vectors(vec), r.numbers("_own")
            wash = (~r.follows | (r.numbers(t) < WASHOUT))[own]
            cols = [c.combine_chunks() for c in r.table.select([*keys, t]).filter(pa.array(own)).columns]
            for m in ensembles.values():
                u = m.inputs(z)
                p = m.predicted(r, u)[own]
                e = (p - u[own][:, None]) / m.sigma
                cols += [pa.array((e * e).mean(axis=(1, 2)), mask=wash), pa.array((p / m.sigma).std(axis=1).mean(axis=1), mask=wash)]
            yield pa.RecordBatch.from_arrays(cols, out.names)
    return d.mapInArrow(run, out)


def _streams(channel: str, model: EchoState, beta: float) -> dict[str, Column]:
    zs, zd = ((F.col(c) - loc) / scale for c, (loc, scale) in zip(_raw_names(channel), (model.sup, model.dis)))
    return {"fused": zs + beta * zd, "surprise": zs, "disagreement": zd}


def echo_state_scores(steps: DataFrame, keys: Sequence[str], t: str, vec: str, model: EchoState,
                      use_cusum: bool = True, beta: float = RESERVOIR["beta"]) -> DataFrame:
    """fused, surprise and disagreement streams; washout steps score 0."""
    # Written once: the reservoirs must not run again for every reader.
    raw = sinks.materialize(echo_state_raw(steps, keys, t, vec, model), "echo_state_raw")
    streams = _streams("", model, beta)
    if use_cusum:
        # a washout step must leave the accumulator at 0
        slack = RESERVOIR["slack"]
        z = ordered.cusums(raw, keys, t, {o: F.coalesce(c, F.lit(slack)) for o, c in streams.items()}, slack)
    else:
        z = raw
        for o, c in streams.items():
            z = ordered.ewma(z, keys, t, F.coalesce(c, F.lit(0.0)), o, RESERVOIR["alpha"])
    return z.drop("sup", "dis")


def fused_scores(steps: DataFrame, keys: Sequence[str], t: str, vec: str, ensembles: dict[str, EchoState],
                 beta: float = RESERVOIR["beta"]) -> DataFrame:
    """The fused stream of each channel, named like it; washout steps score 0."""
    raw = sinks.materialize(echo_states_raw(steps, keys, t, vec, ensembles), "echo_state_raw")
    slack = RESERVOIR["slack"]
    z = ordered.cusums(raw, keys, t, {c: F.coalesce(_streams(c, m, beta)["fused"], F.lit(slack)) for c, m in ensembles.items()}, slack)
    return z.select(*keys, t, *ensembles)


# ------------------------------------------------------- linear next-step scorers
def delay_features(df: DataFrame, keys: Sequence[str], t: str, vec: str, n_in: int, lags: int,
                   pad: str) -> DataFrame:
    """Column ``_x``: the last ``lags`` vectors, newest first.

    The head is padded with the first vector or with zeros.
    """
    lb = ordered.look_back(df, keys, t, lags - 1)
    first = F.first(F.col(vec)).over(lb.window(-(lags - 1)))
    zero = F.array(*[F.lit(0.0)] * n_in)
    fill = first if pad == "first" else zero
    past = [F.col(vec)] + [F.coalesce(F.lag(F.col(vec), j).over(lb.order), fill) for j in range(1, lags)]
    return lb.with_columns({"_x": F.concat(*past)})


def n_quadratic(n: int) -> int:
    return n * (n + 1) // 2


def _expand(x: np.ndarray, quadratic: bool) -> np.ndarray:
    parts = [np.ones((len(x), 1)), x]
    if quadratic:
        i, j = np.triu_indices(x.shape[1])
        parts.append(x[:, i] * x[:, j])
    return np.concatenate(parts, axis=1)


@dataclass(frozen=True)
class NextStep:
    weights: np.ndarray
    quadratic: bool
    sigma: np.ndarray
    loc: float
    scale: float


def next_step_pairs(df: DataFrame, keys: Sequence[str], t: str, vec: str, n_in: int, lags: int, pad: str) -> DataFrame:
    """(keys, t, _x, _y): features of step t - 1 beside the vector of step t."""
    f = delay_features(df, keys, t, vec, n_in, lags, pad)
    return ordered.lag(f, keys, t, {"_px": "_x"}).select(*keys, t, F.col("_px").alias("_x"), F.col(vec).alias("_y"))


def fit_next_step(df: DataFrame, parts: DataFrame, keys: Sequence[str], t: str, vec: str, n_in: int,
                  lags: int = 3, pad: str = "first", quadratic: bool = False, ridge: float = 1.0,
                  train_from: int | None = None) -> NextStep:
    """Ridge predictor by normal equations; residual scale and null on 'held'.

    A quadratic block over 4,096 columns is refused.
    """
    if quadratic and n_quadratic(n_in * lags) > MAX_QUADRATIC_COLUMNS:
        raise ValueError(f"{n_quadratic(n_in * lags)} quadratic columns; at most {MAX_QUADRATIC_COLUMNS}: use fewer lags or inputs")
    pairs = next_step_pairs(df, keys, t, vec, n_in, lags, pad).join(parts.select(*keys, "part"), list(keys))
    f = 1 + n_in * lags + (n_quadratic(n_in * lags) if quadratic else 0)
    start = lags if train_from is None else train_from

    def build(b: pd.DataFrame):
        z = _expand(_matrix(b["_x"]), quadratic)
        yield 0, z, np.concatenate([z, _matrix(b["_y"])], axis=1)
    g = gram(pairs.filter((F.col("part") == "fit") & (F.col(t) >= start)).select("_x", "_y"), build, f + n_in)[0]
    w = np.linalg.solve(g[:, :f] + ridge * np.eye(f), g[:, f:])
    held = pairs.filter((F.col("part") == "held") & (F.col(t) >= WASHOUT))
    e = held.withColumn("_e", residual(F.col("_x"), F.col("_y"), w, quadratic))
    sd = e.agg(*[F.stddev_pop(F.col("_e")[i]).alias(f"s{i}") for i in range(n_in)]).first()
    sd = np.array([sd[f"s{i}"] for i in range(n_in)])
    sigma = np.where(sd < schema.DEGENERATE_EPS, 1.0, np.maximum(sd, 1e-3))
    r = fit.robust_iqr(e.withColumn("v", mean_square(F.col("_e"), sigma)), [], "v").first()
    return NextStep(w, quadratic, sigma, r["loc"], r["scale"])


def residual(x: Column, y: Column, w: np.ndarray, quadratic: bool) -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series(list(_expand(_matrix(xs), quadratic) @ w - _matrix(ys)))
    return run(x, y)


def mean_square(e: Column, sigma: np.ndarray) -> Column:
    n = len(sigma)
    parts = [F.pow(e[i] / F.lit(float(s)), F.lit(2.0)) for i, s in enumerate(sigma)]
    return sum(parts[1:], parts[0]) / F.lit(float(n))


def next_step_scores(df: DataFrame, keys: Sequence[str], t: str, vec: str, n_in: int, model: NextStep,
                     lags: int = 3, pad: str = "first", slack: float = 0.5) -> DataFrame:
    p = next_step_pairs(df, keys, t, vec, n_in, lags, pad)
    live = (F.col(t) >= WASHOUT) & F.col("_x").isNotNull()
    dummy = F.array(*[F.lit(0.0)] * (n_in * lags))
    e = residual(F.coalesce("_x", dummy), F.col("_y"), model.weights, model.quadratic)
    z = (mean_square(F.col("_e"), model.sigma) - model.loc) / model.scale
    d = p.withColumn("_e", e).select(*keys, t, F.when(live, z).otherwise(slack).alias("_z"))
    return ordered.cusum(d, keys, t, "_z", "score", slack).drop("_z")


# ------------------------------------------------------------------- conceptor
@dataclass(frozen=True)
class Conceptor:
    res: Reservoirs
    matrix: np.ndarray | None      # None: a channel that never moved
    aperture: float
    loc: float
    scale: float


def pick_aperture(corr: np.ndarray) -> float | None:
    """Aperture to which the conceptor's squared norm responds most (healthy spectrum only).

    With singular values s = l / (l + 1 / a^2) the slope of the sum of s^2 in log a
    is 4 times the sum of s^2 (1 - s); its top is bracketed on a grid over the whole
    spectrum and then narrowed.
    """
    spectrum = np.linalg.eigvalsh(corr)
    spectrum = spectrum[spectrum > schema.DEGENERATE_EPS]
    if not len(spectrum):
        return None

    def slope(log_a: np.ndarray) -> np.ndarray:
        s = 1.0 / (1.0 + np.exp(-2.0 * np.atleast_1d(log_a))[:, None] / spectrum)
        return (s * s * (1.0 - s)).sum(axis=1)

    low, high = -0.5 * np.log(spectrum.max()) - 2.0, -0.5 * np.log(spectrum.min()) + 2.0
    for _ in range(4):
        grid = np.linspace(low, high, 201)
        top = int(np.argmax(slope(grid)))
        low, high = grid[max(top - 1, 0)], grid[min(top + 1, 200)]
    return float(np.exp((low + high) / 2.0))


def fit_conceptor(steps: DataFrame, parts: DataFrame, keys: Sequence[str], t: str, vec: str, n_in: int,
                  seed: int = 0, aperture: float | None = None, **over) -> Conceptor:
    cfg = {**RESERVOIR, **over}
    keys, size = list(keys), cfg["size"]
    res = Reservoirs(n_in, 1, size, seed, cfg["radius"], cfg["leak"], cfg["input"], cfg["density"])
    own = clustered(steps.join(parts.filter("part = 'fit'").select(*keys), keys, "left_semi").select(*keys, t, vec), keys, t, res.warmup)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = _Products(1, size, 0), 0
        for r in _runs(batches, keys):
            use = (r.numbers(t) >= WASHOUT) & r.numbers("_own")
            for rows, at in res.walk(r, r.vectors(vec)):
                h = at[:, use[rows], :size]
                total.add(h, np.empty((h.shape[1], 0)))
            n += int(use.sum())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat([0, 1], [size, 1]).astype(np.int32)), pa.array(np.append(np.arange(size), 0).astype(np.int32)),
            pa.array([*total.flush()[0], np.full(size, float(n))])], _GRAM.names)
    sums = own.mapInArrow(run, _GRAM).groupBy("part", "i").agg(
        F.array(*[F.sum(F.col("row")[j]) for j in range(size)]).alias("row")).collect()
    n = next(r["row"][0] for r in sums if r["part"] == 1)
    corr = np.array([r["row"] for r in sorted((r for r in sums if r["part"] == 0), key=lambda r: r["i"])]) / n
    a = aperture if aperture is not None else pick_aperture(corr)
    if a is None:
        return Conceptor(res, None, 0.0, 0.0, 1.0)
    c = corr @ np.linalg.inv(corr + a ** -2 * np.eye(size))
    part = Conceptor(res, c, a, 0.0, 1.0)
    held = conceptor_raw(steps.join(parts.filter("part = 'held'").select(*keys), keys, "left_semi"), keys, t, vec, part)
    r = fit.robust_iqr(sinks.materialize(held.filter("raw IS NOT NULL"), "conceptor_held"), [], "raw").first()
    return Conceptor(res, c, a, r["loc"], r["scale"])


def conceptor_raw(steps: DataFrame, keys: Sequence[str], t: str, vec: str, model: Conceptor) -> DataFrame:
    """Share of the state outside the healthy subspace; null in the washout."""
    keys = list(keys)
    d = clustered(steps.select(*keys, t, vec), keys, t, model.res.warmup)
    out = T.StructType([*[d.schema[k] for k in keys], d.schema[t], T.StructField("raw", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _runs(batches, keys):
            v, own = np.empty(r.table.num_rows), r.numbers("_own")
            for rows, at in model.res.walk(r, r.vectors(vec)):
                h = at[0, :, :model.res.size]
                inside = h @ model.matrix.T
                v[rows] = 1.0 - (inside * inside).sum(axis=1) / np.maximum((h * h).sum(axis=1), schema.DEGENERATE_EPS)
            kept = [c.combine_chunks() for c in r.table.select([*keys, t]).filter(pa.array(own)).columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(v[own], mask=(r.numbers(t) < WASHOUT)[own])], out.names)
    return d.mapInArrow(run, out)


def conceptor_scores(steps: DataFrame, keys: Sequence[str], t: str, vec: str, model: Conceptor,
                     slack: float = 0.5) -> DataFrame:
    if model.matrix is None:
        return steps.select(*keys, t, F.lit(0.0).alias("score"))
    z = (F.col("raw") - model.loc) / model.scale
    raw = sinks.materialize(conceptor_raw(steps, keys, t, vec, model), "conceptor_raw")
    d = raw.select(*keys, t, F.coalesce(z, F.lit(slack)).alias("_z"))
    return ordered.cusum(d, keys, t, "_z", "score", slack).drop("_z")


# ------------------------------------------------------------ isolation forest
SAMPLE = 256


def _tree(x: np.ndarray, rng: np.random.Generator) -> pd.DataFrame:
    """Random splits down to depth log2(n): arrays (dim, cut, left, right, size)."""
    nodes: list[list[float]] = []
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    stack = [(x, 0, -1, 0)]
    while stack:
        rows, depth, parent, side = stack.pop()
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(rows)])
        if parent >= 0:
            nodes[parent][2 + side] = me
        lo, hi = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        free = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(free):
            continue
        d = int(rng.choice(free))
        cut = float(rng.uniform(lo[d], hi[d]))
        nodes[me][0], nodes[me][1] = d, cut
        stack.append((rows[rows[:, d] < cut], depth + 1, me, 0))
        stack.append((rows[rows[:, d] >= cut], depth + 1, me, 1))
    return pd.DataFrame(nodes, columns=["dim", "cut", "left", "right", "size"])


def _mean_path(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + 0.5772156649015329) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def fit_forest(df: DataFrame, draw: Column, vec: str, trees: int = 100, seed: int = 0,
               sample: int = SAMPLE) -> list[np.ndarray]:
    """Trees on random samples of ``sample`` rows each (all rows, if there are fewer).

    ``draw`` identifies a row.  A tree takes the rows with the smallest hashes of
    (seed, tree, draw), at any size of the input; hashes that cannot be among
    them by a wide margin are dropped where they are made.
    """
    few = min(1.0, (4.0 * sample + 100.0) / max(df.count(), 1))
    mark = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(seed), k, F.col("_u")), 11) / F.lit(2.0 ** 53)
    drawn = df.select(draw.alias("_u"), vec).select(vec, F.explode(F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda k: F.struct(k.alias("tree"), mark(k).alias("d"))),
        lambda x: x["d"] <= few)).alias("x")).select(vec, "x.tree", "x.d")
    ranked = ranks.hash_order(drawn, ["tree"], "d", "_r").filter(F.col("_r") < sample).select("tree", vec)
    out = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
                        *[T.StructField(c, T.DoubleType()) for c in ("dim", "cut", "left", "right", "size")]])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf[vec])
        x = x[np.lexsort(x.T)]
        tree = int(pdf["tree"].iloc[0])
        t = _tree(x, np.random.default_rng([seed, tree])).astype(float)
        t.insert(0, "node", np.arange(len(t), dtype=np.int32))
        t.insert(0, "tree", np.int32(tree))
        return t
    nodes = ranked.groupBy("tree").applyInPandas(grow, out).toPandas().sort_values(["tree", "node"])
    return [g[["dim", "cut", "left", "right", "size"]].to_numpy() for _, g in nodes.groupby("tree")]


def forest_score(vec: Column, forest: list[np.ndarray]) -> Column:
    """Anomaly score 2^(-path / expected path) - 0.5: higher is more anomalous."""
    norm = float(_mean_path(np.array([forest[0][0, 4]]))[0]) or 1.0

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        m = _matrix(x)
        total = np.zeros(len(m))
        for t in forest:
            at, depth = np.zeros(len(m), int), np.zeros(len(m))
            live = t[at, 0] >= 0
            while live.any():
                i = np.flatnonzero(live)
                node = t[at[i]]
                left = m[i, node[:, 0].astype(int)] < node[:, 1]
                at[i] = np.where(left, node[:, 2], node[:, 3]).astype(int)
                depth[i] += 1
                live = t[at, 0] >= 0
            total += depth + _mean_path(t[at, 4])
        return pd.Series(2.0 ** (-total / len(forest) / norm) - 0.5)
    return score(vec)


# ------------------------------------------------------------------ embedding
BUCKETS = 512
#: characters whose windows are counted at a time
PIECE_CHARS = 1 << 18


@functools.cache
def _projection(dims: int) -> np.ndarray:
    return np.random.default_rng(2026).standard_normal((BUCKETS, dims)) / np.sqrt(BUCKETS)


def embedded(texts: Sequence[str | None], dims: int = schema.WIDTHS["e"]) -> np.ndarray:
    """One unit row per text (zeros for a text without any letters' window: none is that short, as ends are padded).

    The lower-cased text with two blanks at either end is cut into windows of three characters; each
    window adds or takes one in one of 512 buckets, and the counts are projected to ``dims`` numbers.
    Characters are taken ``PIECE_CHARS`` at a time, those of one long text too.
    """
    out = np.empty((len(texts), dims))
    at = 0
    while at < len(texts):
        some, size = [], 0
        while at + len(some) < len(texts) and (not some or (len(some) < 1024 and size < PIECE_CHARS)):
            some.append(f"  {(texts[at + len(some)] or '').lower()}  ")
            size += len(some[-1])
        joined, ends = "".join(some), np.cumsum([0, *map(len, some)])
        counts = np.zeros(len(some) * BUCKETS)
        for begin in range(0, size - 2, PIECE_CHARS):
            codes = np.frombuffer(joined[begin:begin + PIECE_CHARS + 2].encode("utf-32-le", "surrogatepass"), "<u4")
            row = np.repeat(np.arange(len(some)), np.diff(np.clip(ends - begin, 0, len(codes))))
            h = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA6B) ^ codes[2:] * np.uint32(0xC2B2AE35)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            whole = row[:-2] == row[2:]
            place = row[:-2] * BUCKETS + ((h >> np.uint32(8)) % np.uint32(BUCKETS))
            counts += np.bincount(place[whole], np.where(h[whole] >> np.uint32(31), -1.0, 1.0), len(counts))
        v = counts.reshape(len(some), BUCKETS) @ _projection(dims)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        out[at:at + len(some)] = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
        at += len(some)
    return out


def embedding(embed: Callable[[list[str]], np.ndarray] = embedded):
    """Arrow function text -> vector; each distinct text of a batch goes to ``embed`` once, a piece of the batch at a time."""
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(text: pa.Array) -> pa.Array:
        if not len(text):
            return pa.array([], pa.list_(pa.float64()))
        coded = pc.fill_null(text, "").dictionary_encode()
        v = np.concatenate([embed(some) for some in texts.pieces(coded.dictionary)])[coded.indices.to_numpy()]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel(), pa.float64()))
    return run


embed_text = embedding()


def mean_gap(embed: Callable[[list[str]], np.ndarray] = embedded):
    """Arrow function (texts, texts) -> mean of 1 - cosine over the pairs of two arrays; null without pairs."""
    @F.arrow_udf(T.DoubleType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
        if not n.sum():
            return pa.nulls(len(a), pa.float64())
        x, y = (np.concatenate([embed(some) for some in texts.pieces(side.flatten())]) for side in (a, b))
        size = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
        gap = np.where(size > 0, 1.0 - np.divide((x * y).sum(1), size, out=np.ones(len(x)), where=size > 0), 0.0)
        total = np.bincount(np.repeat(np.arange(len(n)), n), gap, len(n))
        return pa.array(np.divide(total, n, out=np.zeros(len(n)), where=n > 0), mask=n == 0)
    return run


def embed_distinct(df: DataFrame, text: str, out: str, embed=embed_text) -> DataFrame:
    """Embed in the scan: nothing is shuffled, and a text that a batch repeats is embedded once."""
    return df.withColumn(out, embed(F.coalesce(text, F.lit(""))))
