"""Ordered (per-episode) computations that stay parallel inside one episode.

One episode may hold a large share of all rows, so no operator here puts a
whole episode into one task.  Every episode is cut into segments of at most
``seg_rows`` consecutive steps and all row-level windows run on
(episode, segment):

* ``look_back``  - bounded history: the last k rows of a segment are also sent
  to the following one ("halo" rows), so one shuffle serves any lag, moving
  frame or fast-decaying recurrence;
* ``running``    - unbounded history: a window inside the segment plus a carry
  from the segment summaries (one row per segment);
* ``ewma`` / ``cusum`` - the two linear recurrences, built on those.

All of them need a dense 0-based step index; ``positions`` makes one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

SEG_ROWS = 4096
_SEG = "_seg"
_OWN = "_own"


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              bucket: Column, out: str = "t") -> DataFrame:
    """Dense 0-based position of each row inside its key.

    ``bucket`` is a coarse column that never decreases along ``order`` (a day
    of a timestamp, a line range of a file).  Only rows of one (key, bucket)
    are sorted together; the offsets come from the bucket counts.
    """
    keys = list(keys)
    b = df.withColumn("_b", bucket)
    counts = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))  # added up before their shuffle
    b = b.repartition(*keys, "_b")
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(
        W.unboundedPreceding, -1)
    offs = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_kb"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = b.withColumn(
        "_rn", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)))
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [
        F.col("_b") == F.col("_kb")]
    joined = local.join(offs, on, "inner")
    return joined.withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("int")) \
        .drop("_b", "_kb", "_rn", "_off", *[f"_k_{k}" for k in keys])


def day_bucket(ts: str | Column) -> Column:
    """Day number of a timestamp, the usual ``bucket`` for ``positions``."""
    return F.unix_date(F.to_date(ts))


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp (no time zone used)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    sec = F.hour(c) * 3600 + F.minute(c) * 60
    part = (F.date_part(F.lit("SECOND"), c) * 1000000).cast("long")
    return (day_bucket(c).cast("long") * 86400 + sec) * 1000000 + part


@dataclass(frozen=True)
class LookBack:
    """Rows with halo copies, and the window that reads them."""

    df: DataFrame
    keys: tuple[str, ...]
    t: str

    def window(self, start: int, end: int = 0):
        return W.partitionBy(*self.keys, _SEG).orderBy(self.t) \
            .rowsBetween(start, end)

    @property
    def order(self):
        return W.partitionBy(*self.keys, _SEG).orderBy(self.t)

    def with_columns(self, cols: dict[str, Column]) -> DataFrame:
        """Add windowed columns, then drop the halo copies."""
        return self.df.withColumns(cols).filter(F.col(_OWN)) \
            .drop(_SEG, _OWN)


def look_back(df: DataFrame, keys: Sequence[str], t: str, k: int,
              seg_rows: int = SEG_ROWS) -> LookBack:
    """Segment the rows so that each one sees its k predecessors.

    A row is copied only into the segments its k followers live in, so the
    growth is k / seg_rows of the input.
    """
    own = F.floor(F.col(t) / F.lit(seg_rows))
    last = F.floor((F.col(t) + F.lit(k)) / F.lit(seg_rows))
    d = df.withColumn(_SEG, F.explode(F.sequence(own, last))) \
        .withColumn(_OWN, F.col(_SEG) == own)
    return LookBack(d, tuple(keys), t)


def lag(df: DataFrame, keys: Sequence[str], t: str, cols: dict[str, str | Column],
        k: int = 1, seg_rows: int = SEG_ROWS) -> DataFrame:
    """``out -> column`` k steps earlier (null at the head)."""
    lb = look_back(df, keys, t, k, seg_rows)
    return lb.with_columns({o: F.lag(c, k).over(lb.order)
                            for o, c in cols.items()})


@dataclass(frozen=True)
class Run:
    """One running aggregate: kind is sum, min, max or last (non-null)."""

    kind: str
    col: str
    inclusive: bool = True


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "min":
        return F.least(carry, local)
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "last":
        return F.coalesce(local, carry)
    raise ValueError(f"unknown running aggregate {kind!r}")


def _agg(kind: str, col: str, t: str) -> Column:
    if kind == "last":
        return F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(t)))
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](col)


def _over(kind: str, col: str, w) -> Column:
    if kind == "last":
        return F.last(F.col(col), ignorenulls=True).over(w)
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](col).over(w)


def segmented(df: DataFrame, keys: Sequence[str], t: str,
              seg_rows: int = SEG_ROWS) -> DataFrame:
    """The one big shuffle: rows placed by (episode, segment)."""
    return df.withColumn(_SEG, F.floor(F.col(t) / F.lit(seg_rows))) \
        .repartition(*keys, _SEG)


def _join_carry(base: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = carry.select(
        *[F.col(k).alias(f"_c_{k}") for k in (*keys, _SEG)],
        *[c for c in carry.columns if c not in (*keys, _SEG)])
    on = [F.col(k) == F.col(f"_c_{k}") for k in (*keys, _SEG)]
    return base.join(renamed, on, "left").drop(
        *[f"_c_{k}" for k in (*keys, _SEG)])


def running(df: DataFrame, keys: Sequence[str], t: str, runs: dict[str, Run],
            seg_rows: int = SEG_ROWS) -> DataFrame:
    """Unbounded running aggregates along an episode."""
    keys = list(keys)
    base = segmented(df, keys, t, seg_rows)
    parts = base.groupBy(*keys, _SEG).agg(
        *[_agg(r.kind, r.col, t).alias(f"_p_{o}") for o, r in runs.items()])
    before = W.partitionBy(*keys).orderBy(_SEG).rowsBetween(
        W.unboundedPreceding, -1)
    carry = parts.select(
        *keys, _SEG,
        *[_over(r.kind, f"_p_{o}", before).alias(f"_c_{o}")
          for o, r in runs.items()]).filter(F.col(_SEG) > 0)
    order = W.partitionBy(*keys, _SEG).orderBy(t)
    local = base.select("*", *[
        _over(r.kind, r.col, order.rowsBetween(
            W.unboundedPreceding, 0 if r.inclusive else -1)).alias(f"_l_{o}")
        for o, r in runs.items()])
    out = _join_carry(local, carry, keys)
    for o, r in runs.items():
        out = out.withColumn(o, _combine(r.kind, F.col(f"_c_{o}"),
                                         F.col(f"_l_{o}")))
    return out.drop(_SEG, *[f"_c_{o}" for o in runs], *[f"_l_{o}" for o in runs])


def anchor(df: DataFrame, keys: Sequence[str], t: str,
           cols: dict[str, str]) -> DataFrame:
    """First value of each column along the episode, on every row."""
    keys = list(keys)
    first = df.groupBy(*keys).agg(
        *[F.min_by(F.col(c), F.col(t)).alias(o) for o, c in cols.items()])
    return df.join(first, keys, "inner")


def cusums(df: DataFrame, keys: Sequence[str], t: str, values: dict[str, Column],
           slack: float = 0.0, seg_rows: int = SEG_ROWS) -> DataFrame:
    """One-sided CUSUMs ``c = max(0, c + value - slack)``, all in one shuffle.

    Inside a segment c = S - min(0, min S) with S the running sum; a segment
    hands on its sum and its lowest point, which is all the next one needs.
    """
    keys = list(keys)
    base = segmented(df.withColumns({f"_cu_v_{o}": v - F.lit(float(slack)) for o, v in values.items()}),
                     keys, t, seg_rows)
    order = W.partitionBy(*keys, _SEG).orderBy(t).rowsBetween(W.unboundedPreceding, 0)
    local = base.withColumns({f"_cu_s_{o}": F.sum(f"_cu_v_{o}").over(order) for o in values})
    local = local.withColumns({f"_cu_lo_{o}": F.min(f"_cu_s_{o}").over(order) for o in values})
    parts = local.groupBy(*keys, _SEG).agg(*[x for o in values for x in (
        F.max_by(f"_cu_s_{o}", t).alias(f"_cu_sum_{o}"), F.min(f"_cu_s_{o}").alias(f"_cu_low_{o}"))])
    before = W.partitionBy(*keys).orderBy(_SEG).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumns({
        f"_cu_pre_{o}": F.coalesce(F.sum(f"_cu_sum_{o}").over(before), F.lit(0.0)) for o in values})
    carry = parts.select(*keys, _SEG, *[
        (F.col(f"_cu_pre_{o}") - F.least(F.lit(0.0), F.min(
            F.col(f"_cu_pre_{o}") + F.col(f"_cu_low_{o}")).over(before))).alias(f"_cu_in_{o}")
        for o in values]).filter(F.col(_SEG) > 0)
    joined = _join_carry(local, carry, keys)
    drop = [f"_cu_{n}_{o}" for o in values for n in ("v", "s", "lo", "in")]
    return joined.withColumns({o: F.greatest(
        F.coalesce(F.col(f"_cu_in_{o}"), F.lit(0.0)) + F.col(f"_cu_s_{o}"),
        F.col(f"_cu_s_{o}") - F.least(F.lit(0.0), F.col(f"_cu_lo_{o}"))) for o in values}).drop(_SEG, *drop)


def cusum(df: DataFrame, keys: Sequence[str], t: str, value: Column | str,
          out: str, slack: float = 0.0, seg_rows: int = SEG_ROWS) -> DataFrame:
    """One CUSUM, see ``cusums``."""
    return cusums(df, keys, t, {out: F.col(value) if isinstance(value, str) else value}, slack, seg_rows)


def ewma_history(alpha: float) -> int:
    """Steps after which a weight is below double precision."""
    return max(1, math.ceil(math.log(1e-18) / math.log(1.0 - alpha)))


def ewma(df: DataFrame, keys: Sequence[str], t: str, value: Column | str,
         out: str, alpha: float, start_at_first: bool = False,
         seg_rows: int | None = None) -> DataFrame:
    """EWMA ``y = alpha*x + (1-alpha)*y``.

    The start is 0, or the first value when ``start_at_first``.  A segment is
    summed from 0 and hands on one number; the next ones add what is left of it.
    Older segments lose all weight within ``ewma_history(alpha)`` steps.  The
    segment is short enough for the weights (1-alpha)^-i to stay far inside the
    double range.  With alpha = 1 the value itself comes out.
    """
    value = F.col(value) if isinstance(value, str) else value
    keys = list(keys)
    if alpha >= 1.0:
        return df.withColumn(out, F.coalesce(value, F.lit(0.0)))
    decay = 1.0 - alpha
    rows = seg_rows or max(16, min(SEG_ROWS, int(250 / -math.log10(decay))))
    base = segmented(df.withColumn("_ew_x", value), keys, t, rows)
    age = F.col(t) - F.col(_SEG) * F.lit(rows)
    head = F.lit(1.0) if start_at_first else F.lit(alpha)
    weight = F.when(F.col(t) == 0, head).otherwise(F.lit(alpha))
    order = W.partitionBy(*keys, _SEG).orderBy(t).rowsBetween(W.unboundedPreceding, 0)
    local = base.withColumn("_ew_s", F.coalesce(F.sum(weight * F.col("_ew_x") * F.pow(F.lit(decay), -age)).over(order), F.lit(0.0)))
    ends = local.groupBy(*keys, _SEG).agg((F.max_by("_ew_s", t) * F.lit(decay ** (rows - 1))).alias("_ew_end"))
    near = W.partitionBy(*keys).orderBy(_SEG).rangeBetween(-math.ceil(ewma_history(alpha) / rows) - 1, -1)
    carry = ends.select(*keys, _SEG, F.aggregate(
        F.collect_list(F.struct(F.col(_SEG).alias("s"), "_ew_end")).over(near), F.lit(0.0),
        lambda a, x: a + x["_ew_end"] * F.pow(F.lit(decay), F.lit(rows) * (F.col(_SEG) - 1 - x["s"]))).alias("_ew_in")).filter(F.col(_SEG) > 0)
    joined = _join_carry(local, carry, keys)
    return joined.withColumn(out, F.pow(F.lit(decay), age) * (
        F.col("_ew_s") + F.lit(decay) * F.coalesce("_ew_in", F.lit(0.0)))).drop("_ew_x", "_ew_s", "_ew_in", _SEG)
