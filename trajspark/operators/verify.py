"""Deterministic checks: recompute, required work, result shapes, provenance.

Calls are rows (keys, t, name, args_key, result, is_error, has_result).  A task
is a ``TaskSpec``; its few rules become literal expressions of the plan.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.functions import money
from trajspark.operators import joins


@dataclass(frozen=True)
class LineItem:
    tool: str
    multiplier: int = 1
    required_calls: int | None = None
    distinct: bool = True


@dataclass(frozen=True)
class TaskSpec:
    """What a complete and rightly totalled run of one task looks like (tolerances: fixed values)."""

    line_items: tuple[LineItem, ...] = ()
    required_tools: tuple[str, ...] = ()
    required_counts: tuple[tuple[str, int], ...] = ()
    combining_tools: tuple[str, ...] = ()
    result_contracts: tuple[tuple[str, str], ...] = ()
    tolerance: float = 0.01
    tolerance_floor: float = 0.5
    tolerance_pivot: float = 1.0
    currency: str = "$"


def _needs(spec: TaskSpec) -> list[tuple[str, int, bool]]:
    """(tool, required successful calls, count distinct arguments only)."""
    distinct = {li.tool: li.distinct for li in spec.line_items}
    rows = [(li.tool, li.required_calls, li.distinct) for li in spec.line_items
            if li.required_calls is not None]
    rows += [(t, 1, distinct.get(t, True)) for t in spec.required_tools]
    rows += [(t, n, distinct.get(t, True)) for t, n in spec.required_counts]
    return rows


def _in(col: Column, names: Sequence[str]) -> Column:
    return col.isin(*names) if names else F.lit(False)


def required_coverage(calls: DataFrame, keys: Sequence[str], t: str, spec: TaskSpec) -> DataFrame:
    """Findings: required calls that did not happen.

    Dated to the first combining step, else to the last step.  Two aggregates:
    per distinct call, then per episode; requirement counts ride as columns.
    """
    keys = list(keys)
    ok = ~F.col("is_error")
    comb = _in(F.col("name"), spec.combining_tools) & ok
    sig = calls.groupBy(*keys, "name", "args_key").agg(
        F.sum(ok.cast("int")).alias("_n"), F.min(F.when(comb, F.col(t))).alias("_comb"),
        F.max(t).alias("_last"))
    needs = _needs(spec)
    per = sig.groupBy(*keys).agg(
        F.coalesce(F.min("_comb"), F.max("_last")).alias("step"),
        *[F.sum(F.when((F.col("name") == tool) & (F.col("_n") > 0),
                       F.lit(1) if dist else F.col("_n")).otherwise(0)).alias(f"_r{i}")
          for i, (tool, _, dist) in enumerate(needs)])
    rows = F.array(*[F.struct(F.lit(tool).alias("tool"), F.col(f"_r{i}").cast("long").alias("got"),
                              F.lit(n).alias("need")) for i, (tool, n, _) in enumerate(needs)])
    return per.select(*keys, "step", F.inline(rows)).filter("got < need").select(
        *keys, F.lit("required_coverage").alias("check"), "step", "tool", "got", "need")


def tool_contract(calls: DataFrame, keys: Sequence[str], t: str, spec: TaskSpec) -> DataFrame:
    """Findings: results that match no declared shape of their tool (whole match)."""
    bad = F.lit(False)
    for tool, pattern in spec.result_contracts:
        bad = bad | ((F.col("name") == tool) & ~F.trim("result").rlike(rf"(?s)\A(?:{pattern})\z"))
    live = ~F.col("is_error") & F.col("has_result")
    return calls.filter(live & bad).select(
        *keys, F.lit("tool_contract").alias("check"), F.col(t).alias("step"),
        F.col("name").alias("tool"))


def tolerance_for(spec: TaskSpec, value: Column) -> Column:
    return F.greatest(F.lit(spec.tolerance) * F.greatest(F.abs(value), F.lit(spec.tolerance_pivot)),
                      F.lit(spec.tolerance_floor))


def priced_calls(calls: DataFrame, keys: Sequence[str], t: str, spec: TaskSpec) -> DataFrame:
    """One priced row per counted lookup: distinct signatures keep the earliest."""
    keys = list(keys)
    distinct = [li.tool for li in spec.line_items if li.distinct]
    every = [li.tool for li in spec.line_items if not li.distinct]
    good = calls.filter(~F.col("is_error"))
    parts = []
    if distinct:
        parts.append(good.filter(_in(F.col("name"), distinct)).groupBy(*keys, "name", "args_key").agg(
            F.min_by("result", F.struct(t, F.length("result"), "result")).alias("result")).drop("args_key"))
    if every:
        parts.append(good.filter(_in(F.col("name"), every)).select(*keys, "name", "result"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.withColumn("price", money.first_price(F.col("result"), spec.currency)) \
        .filter("price IS NOT NULL")


def _cents(v: Column) -> Column:
    return F.round(v * 100).cast("long")


class Sums:
    """Sets of reachable whole-cent amounts from ``low`` to ``high``.

    Few amounts are a Python set, many the bits of one integer; both are exact.
    """

    def __init__(self, low: int, high: int):
        self.low, self.high, self.mask = low, high, None
        self.turn = max(4096, (high - low) // 512)

    def grown(self, old, more, by: int):
        """``old`` with every amount of ``more`` raised by ``by``, as far as it stays in range."""
        if isinstance(more, set):
            lifted = {v + by for v in more if self.low <= v + by <= self.high}
            if isinstance(old, set):
                both = old | lifted
                return both if len(both) <= self.turn else self.bits(both)
            return old | self.bits(lifted)
        if self.mask is None:
            self.mask = (1 << self.high - self.low + 1) - 1
        lifted = (more << by if by >= 0 else more >> -by) & self.mask
        return lifted | (self.bits(old) if isinstance(old, set) else old)

    def bits(self, amounts: set[int]) -> int:
        raw = bytearray((self.high - self.low) // 8 + 1)
        for v in amounts:
            raw[v - self.low >> 3] |= 1 << (v - self.low & 7)
        return int.from_bytes(raw, "little")

    def between(self, sums, low: int, high: int) -> list[int]:
        """Amounts of ``sums`` from ``low`` to ``high``."""
        low, high = max(low, self.low), min(high, self.high)
        if isinstance(sums, set):
            return [v for v in sums if low <= v <= high] if len(sums) < high - low else [v for v in range(low, high + 1) if v in sums]
        part = sums >> low - self.low & (1 << max(0, high - low + 1)) - 1 if high >= low else 0
        return [low + k for k in range(part.bit_length()) if part >> k & 1]


#: selections of an episode that are all tried as they are
FEW_SELECTIONS = 128


def _selection_check(spec: TaskSpec):
    """Per episode: can the stated total be made from the observed prices?"""
    tools = {li.tool: li for li in spec.line_items}

    def tolerance(v: float) -> float:
        return max(spec.tolerance * max(abs(v), spec.tolerance_pivot), spec.tolerance_floor)

    def reachable(said: float, most: int, prices: dict[str, tuple[int, int, list]]) -> bool:
        paid = sum(tools[t].multiplier * total for t, (_, total, _) in prices.items())
        room = Sums(0, min(most, paid))
        sums = {0}
        for tool, (n, total, amounts) in prices.items():
            li = tools[tool]
            if li.required_calls is None or li.required_calls >= n:
                sums = room.grown(set(), sums, li.multiplier * total)
                continue
            chosen = [sums, *(set() for _ in range(li.required_calls))]
            for cents, times in amounts:
                for _ in range(min(times, li.required_calls)):
                    for k in range(li.required_calls, 0, -1):
                        chosen[k] = room.grown(chosen[k], chosen[k - 1], li.multiplier * cents)
            sums = chosen[-1]
        reach = 100 * max(tolerance(said), tolerance(most / 100)) + 1
        near = room.between(sums, int(100 * said - reach), int(100 * said + reach) + 1)
        return any(abs(said - v / 100) <= tolerance(v / 100) for v in near)

    def near(said: np.ndarray, cents: np.ndarray) -> np.ndarray:
        v = cents / 100
        return np.abs(said - v) <= np.maximum(spec.tolerance * np.maximum(np.abs(v), spec.tolerance_pivot), spec.tolerance_floor)

    @F.arrow_udf(T.BooleanType())
    def run(said: pa.Array, most: pa.Array, tools_: pa.Array) -> pa.Array:
        """Episodes of one tool with few selections are tried together, all selections; the others one by one."""
        stated, at, size = said.to_numpy(zero_copy_only=False), tools_.offsets.to_numpy(), np.diff(tools_.offsets.to_numpy())
        name, n, total, amounts = tools_.values.flatten()
        ends = amounts.offsets.to_numpy()
        cents, times = (x.to_numpy(zero_copy_only=False) for x in amounts.values.flatten())
        n, total = n.to_numpy(zero_copy_only=False), total.to_numpy(zero_copy_only=False)
        out, left = np.zeros(len(said), bool), np.ones(len(said), bool)
        for tool, li in tools.items():
            mine = np.flatnonzero(size == 1)
            mine = mine[pc.equal(name.take(pa.array(at[mine])), tool).to_numpy(zero_copy_only=False)]
            row = at[mine]
            whole = np.ones(len(mine), bool) if li.required_calls is None else n[row] <= li.required_calls
            out[mine[whole]] = near(stated[mine[whole]], li.multiplier * total[row[whole]])
            left[mine[whole]] = False
            mine, row = mine[~whole], row[~whole]
            taken = np.minimum(times, li.required_calls or 0)
            before = np.concatenate(([0], np.cumsum(taken)))
            single, first = np.repeat(cents, taken), before[ends[row]]
            some = before[ends[row + 1]] - first
            for m in np.unique(some):
                if li.required_calls < 1 or math.comb(int(m), li.required_calls) > FEW_SELECTIONS:
                    continue
                these = some == m
                ways = np.array(list(itertools.combinations(range(m), li.required_calls)), int).reshape(-1, li.required_calls)
                prices = single[first[these][:, None] + np.arange(m)]
                out[mine[these]] = near(stated[mine[these]][:, None], li.multiplier * prices[:, ways].sum(axis=2)).any(axis=1)
                left[mine[these]] = False
        rest = np.flatnonzero(left)
        for i, s, m, rows in zip(rest, *(x.take(pa.array(rest)).to_pylist() for x in (said, most, tools_))):
            out[i] = reachable(s, m, {r["name"]: (r["n"], r["s"], [(x["cents"], x["times"]) for x in r["amounts"]]) for r in rows})
        return pa.array(out)
    return run


def selection(priced: DataFrame, stated: DataFrame, keys: Sequence[str], spec: TaskSpec) -> DataFrame:
    """matches / mismatch per episode with a stated total, over every selection of n of m prices.

    Amounts are whole cents; reachable totals are kept up to the largest that can
    still reconcile with the stated one (prices are not negative, so nothing above
    it comes back).  Equal prices of a tool travel as one amount and a count.
    """
    if spec.tolerance >= 1:
        raise ValueError("a tolerance of 100% reconciles every total")
    keys = list(keys)
    s = F.col("stated")
    most = _cents(F.greatest(s / (1 - spec.tolerance), s + spec.tolerance_floor, s + spec.tolerance * spec.tolerance_pivot)) + 1
    st = stated.select(*keys, "stated", F.greatest(most, F.lit(0)).alias("_most"))
    amounts = priced.withColumn("cents", _cents(F.col("price"))).groupBy(*keys, "name", "cents").agg(
        F.count(F.lit(1)).alias("times"))
    usable = F.when(F.col("cents") <= F.col("_most"), F.struct("cents", "times"))
    per = amounts.join(st, keys).groupBy(*keys, "stated", "_most", "name").agg(
        F.sum("times").alias("n"), F.sum(F.col("cents") * F.col("times")).alias("s"),
        F.collect_list(usable).alias("amounts"))
    ep = per.groupBy(*keys, "stated", "_most").agg(F.collect_list(F.struct("name", "n", "s", "amounts")).alias("_tools"))
    ok = _selection_check(spec)("stated", "_most", "_tools")
    return ep.select(*keys, "stated", F.when(ok, "matches").otherwise("mismatch").alias("selection"))


def total_consistency(calls: DataFrame, stated: DataFrame, keys: Sequence[str], t: str,
                      spec: TaskSpec, select: bool = True) -> DataFrame:
    """Per episode: recomputed total, stated total, verdict.

    ``stated`` has one row per episode with a nullable ``stated`` column.
    verdict is ok, mismatch, no_total (nothing was stated) or unverifiable.
    """
    keys = list(keys)
    priced = priced_calls(calls, keys, t, spec)
    mult = F.lit(None)
    for li in spec.line_items:
        mult = F.when(F.col("name") == li.tool, li.multiplier).otherwise(mult)
    total = priced.groupBy(*keys).agg(F.sum(mult * F.col("price")).alias("recomputed"))
    j = stated.join(total, keys, "left")
    near = F.abs(F.col("stated") - F.col("recomputed")) <= tolerance_for(spec, F.col("recomputed"))
    if select and any(li.required_calls is not None for li in spec.line_items):
        sel = selection(priced, stated.filter("stated IS NOT NULL"), keys, spec).drop("stated")
        j = j.join(sel, keys, "left")
        decided = F.when(F.col("selection") == "matches", "ok").otherwise("mismatch")
    else:
        decided = F.when(near, "ok").otherwise("mismatch")
    return j.select(*keys, "recomputed", "stated", F.when(F.col("recomputed").isNull(), "unverifiable")
                    .when(F.col("stated").isNull(), "no_total").otherwise(decided).alias("verdict"))


def verify(calls: DataFrame, stated: DataFrame, keys: Sequence[str], t: str, spec: TaskSpec) -> DataFrame:
    """All checks per episode: failed, checked and the findings per check."""
    keys = list(keys)
    tot = total_consistency(calls, stated, keys, t, spec)
    found = required_coverage(calls, keys, t, spec).select(*keys, "check").unionByName(
        tool_contract(calls, keys, t, spec).select(*keys, "check")).unionByName(
        tot.filter("verdict IN ('mismatch', 'no_total')").select(*keys, F.lit("total_consistency").alias("check")))
    per = found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.array_join(F.array_sort(F.collect_set("check")), ",").alias("failed_checks"))
    return tot.join(per, keys, "left").select(
        *keys, (F.coalesce("n_findings", F.lit(0)) > 0).alias("failed"),
        (F.col("verdict") != "unverifiable").alias("checked"),
        F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
        F.coalesce("failed_checks", F.lit("")).alias("failed_checks"))


# ------------------------------------------------------- numeric provenance
TAX_RATES = (0.08, 0.085, 0.10)


def grounded_figures(results: DataFrame, keys: Sequence[str], t: str = "t", nights: int = 4,
                     taxes: Sequence[float] = TAX_RATES) -> DataFrame:
    """Values, their multiples and taxed forms, with the first step that allows them."""
    keys = list(keys)
    v = F.col("value")
    base = results.select(*keys, F.col(t).alias("since"), F.explode(F.array(
        *[F.round(v * k, 2) for k in range(1, nights + 1)])).alias("one"))
    return base.select(*keys, "since", F.explode(F.array(F.col("one"), *[
        F.round(F.col("one") * F.lit(1.0 + r), 2) for r in taxes])).alias("grounded")) \
        .groupBy(*keys, "grounded").agg(F.min("since").alias("since"))


def ungrounded(assertions: DataFrame, grounded: DataFrame, keys: Sequence[str], t: str = "t",
               tol: float = 0.5) -> DataFrame:
    """Asserted figures with nothing derivable nearby from earlier steps.

    A range join on equal unit buckets.  Figures are cents, so one bucket of
    one episode holds at most a hundred of them: a hot episode spreads over
    its buckets and no bucket pairs grow large.
    """
    keys = list(keys)
    g = grounded.select(*keys, F.floor("grounded").alias("_b"), "grounded", "since")
    a = assertions.select(*keys, F.col(t).alias("_t"), "value").distinct()
    span = F.sequence(F.floor(F.col("value") - tol), F.floor(F.col("value") + tol))
    a = a.withColumn("_b", F.explode(span))
    near = a.join(g, [*keys, "_b"]).filter(
        (F.abs(F.col("value") - F.col("grounded")) <= F.lit(tol)) & (F.col("since") < F.col("_t")))
    hit = near.select(*keys, F.col("_t").alias(t), "value").distinct()
    return assertions.join(hit, [*keys, t, "value"], "left_anti")


def ungrounded_by(assertions: DataFrame, results: DataFrame, keys: Sequence[str], t: str = "t", nights: int = 4,
                  taxes: Sequence[float] = TAX_RATES, tol: float = 0.5, together: int = joins.TOGETHER) -> DataFrame:
    """``ungrounded`` over the figures of ``results``, without writing them out.

    The results of a key are met as they are and their forms computed on the spot, so
    each side is shuffled once; only keys with more than ``together`` rows go by buckets.
    """
    keys = list(keys)
    hot = joins.crowded([assertions, results], keys, together)
    few_a, few_r, rest = assertions, results, None
    if hot is not None:
        (few_a, many_a), (few_r, many_r) = (joins.parted(df, keys, hot) for df in (assertions, results))
        rest = ungrounded(many_a, grounded_figures(many_r, keys, t, nights, taxes), keys, t, tol)
    r = few_r.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(t).alias("_since"), F.col("value").alias("_v"))
    near = F.lit(False)
    for k in range(1, nights + 1):
        one = F.round(F.col("_v") * k, 2)
        for form in (one, *[F.round(one * F.lit(1.0 + x), 2) for x in taxes]):
            near = near | (F.abs(F.col("value") - form) <= F.lit(tol))
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_since") < F.col(t), near]
    left = few_a.join(r, on, "left_anti")
    return left if rest is None else left.unionByName(rest)


def _sum_check(multiples: Sequence[int], taxes: Sequence[float], tol: float):
    """Which asserted figures are subset sums (or taxed sums) of earlier values?"""
    rates = (0.0, *taxes)

    def taxed(v: int, rate: float) -> float:
        return float(np.round(v / 100 * (1.0 + rate), 2)) if rate else v / 100

    def grounded(steps, values, at, said) -> list[bool]:
        amounts = np.round(np.asarray(values, float) * 100).astype(np.int64).tolist()
        lift = sum(multiples)
        below, above = (lift * sum(abs(v) for v in amounts if (v < 0) == neg) for neg in (True, False))
        most = max((abs(f) for f in said), default=0.0) + tol
        room = Sums(-below, min(above, int(100 * most) + 2 + below))
        out, sums, used = [False] * len(said), {0}, 0
        for k in np.argsort(at, kind="stable").tolist():
            while used < len(steps) and steps[used] < at[k]:
                for m in multiples:
                    sums = room.grown(sums, sums, m * amounts[used])
                used += 1
            for rate in rates:
                near = room.between(sums, int(100 * (said[k] - tol) / (1.0 + rate)) - 3, int(100 * (said[k] + tol) / (1.0 + rate)) + 3)
                if any(v and abs(taxed(v, rate) - said[k]) <= tol for v in near):
                    out[k] = True
                    break
        return out

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def run(steps: pd.Series, values: pd.Series, at: pd.Series, said: pd.Series) -> pd.Series:
        return pd.Series([grounded(*row) for row in zip(steps, values, at, said)])
    return run


def ungrounded_by_sums(assertions: DataFrame, results: DataFrame, keys: Sequence[str], t: str = "t",
                       multiples: Sequence[int] = (1, 2), taxes: Sequence[float] = TAX_RATES,
                       tol: float = 0.5, chunk: int = 4096) -> DataFrame:
    """Drop the figures that are subset sums of earlier results.

    Sums are whole cents and exact: amounts that no later value can bring back
    to the largest asserted figure of the chunk are left out, nothing else.  An
    episode's values meet in one task (eight bytes each); its asserted figures
    come in chunks.
    """
    keys = list(keys)
    vals = results.filter(F.col("value") != 0).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(t, "pos", "value"))).alias("_v"))
    a = assertions.select(*keys, t, "value").distinct()
    n = a.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("_n"))
    a = a.join(n, keys).withColumn("_c", F.pmod(F.xxhash64(t, "value"), F.col("_n")))
    said = a.groupBy(*keys, "_c").agg(F.collect_list(F.struct(F.col(t).alias("at"), "value")).alias("_a"))
    j = said.join(vals, keys).withColumn("_ok", _sum_check(multiples, taxes, tol)(
        F.transform("_v", lambda x: x[t]), F.transform("_v", lambda x: x["value"]),
        F.col("_a.at"), F.col("_a.value")))
    hit = j.select(*keys, F.inline(F.arrays_zip(F.col("_a.at").alias("at"), F.col("_a.value").alias("value"),
                                                F.col("_ok").alias("ok")))).filter("ok")
    return assertions.join(hit.select(*keys, F.col("at").alias(t), "value").distinct(), [*keys, t, "value"], "left_anti")


# ------------------------------------------------------------ as-of, success
def checkpoint(calls: DataFrame, limits: DataFrame, keys: Sequence[str], t: str,
               limit: str) -> DataFrame:
    """Step after the last successful call strictly before a limit.

    Null limit: not_triggered.  No such call: checkpoint_at_start (k = 0).
    """
    keys = list(keys)
    ok = calls.filter(~F.col("is_error")).select(*keys, F.col(t).alias("_t"))
    lim = limits.select(*keys, F.col(limit).alias("limit"))
    last = ok.join(lim, keys).filter(F.col("_t") < F.col("limit")).groupBy(*keys).agg(
        F.max("_t").alias("_last"))
    j = lim.join(last, keys, "left")
    k = F.when(F.col("limit").isNull(), 0).otherwise(F.coalesce(F.col("_last") + 1, F.lit(0)))
    return j.select(*keys, "limit", k.cast("int").alias("k"),
                    F.when(F.col("limit").isNull(), "not_triggered")
                    .when(k == 0, "checkpoint_at_start").otherwise("normal").alias("outcome"))


def rollback_rates(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Trigger, conditional and end-to-end recovery, each with its denominator."""
    n = lambda *o: F.sum(F.col("outcome").isin(*o).cast("int"))
    c = outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_selected"), n("not_triggered").alias("n_not_triggered"),
        n("reconstruction_failed").alias("n_reconstruction_failed"), n("recovered").alias("n_recovered"),
        n("still_wrong").alias("n_still_wrong"), n("halted").alias("n_halted"))
    trig = F.col("n_selected") - F.col("n_not_triggered")
    tried = trig - F.col("n_reconstruction_failed")
    rate = lambda a, b: F.when(b > 0, a / b)
    return c.withColumns({
        "trigger_rate": rate(trig, F.col("n_selected")),
        "conditional_recovery": rate(F.col("n_recovered"), tried),
        "end_to_end_recovery": rate(F.col("n_recovered"), F.col("n_selected"))})


def task_success(calls: DataFrame, keys: Sequence[str], tools: Sequence[str],
                 accept: DataFrame) -> DataFrame:
    """Required tools really ran and ``accept`` (nullable) says yes; null stays null."""
    keys = list(keys)
    ran = calls.groupBy(*keys).agg(*[
        F.bool_or((F.col("name") == tool) & ~F.col("is_error")).alias(f"_t{i}")
        for i, tool in enumerate(tools)])
    every = F.lit(True)
    for i in range(len(tools)):
        every = every & F.coalesce(F.col(f"_t{i}"), F.lit(False))
    return accept.join(ran, keys, "left").select(
        *keys, F.when(F.col("accepted").isNull(), None).otherwise(every & F.col("accepted")).alias("success"))


# --------------------------------------------------------- objective labels
def cents(v: Column) -> Column:
    return F.round(v * 100).cast("long")


def derivable(assertions: DataFrame, items: DataFrame, keys: Sequence[str],
              taxes: Sequence[float] = (0.0, 0.08, 0.085, 0.10)) -> DataFrame:
    """Mark asserted figures: verbatim item, or total derivable from the items.

    ``items`` holds (keys, value in cents).  Derivable are an item, a pair
    subtotal a + b and the sum of all, each with one of the taxes.
    """
    return marked(assertions, items.select(*keys, F.col("value").cast("long").alias("item"), F.lit(None).cast("long").alias("name"),
                                           F.lit(None).cast("long").alias("calc")), keys, taxes)


def _before_tax(fig: Column, taxes: Sequence[float]) -> Column:
    """The few amounts that one of the taxes turns into ``fig``."""
    def one(r: float) -> Column:
        if not r:
            return F.array(fig)
        near = F.floor(fig / F.lit(1.0 + r) + F.lit(0.5)).cast("long")
        half, x = F.lit(0.5), lambda s: s * F.lit(1.0 + r)  # what rounds to fig, halves away from zero, without a decimal for each try
        return F.filter(F.array(near - 1, near, near + 1), lambda s: F.when(
            s >= 0, (x(s) >= fig - half) & (x(s) < fig + half)).otherwise((x(s) > fig - half) & (x(s) <= fig + half)))
    return F.array_distinct(F.flatten(F.array(*[one(r) for r in taxes])))


def _taxed(amounts: str, r: float) -> Column:
    return F.transform(amounts, lambda v: F.round(v * F.lit(1.0 + r)).cast("long")) if r else F.col(amounts)


def derivable_within(fig: Column, items: str, calcs: str, taxes: Sequence[float]) -> Column:
    """Is ``fig`` an item, a calculated amount, the sum of two items or of all, with one of the taxes?  Items and amounts are arrays of the row."""
    own = F.col(items)
    grand = F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + x)

    def met(s: Column) -> Column:
        pair = F.exists(F.transform(own, lambda x, i: F.array_contains(F.slice(own, i + 2, F.size(own)), s - x)), lambda y: y)
        return F.array_contains(own, s) | F.array_contains(F.col(calcs), s) | ((grand == s) & (F.size(own) > 0)) | pair
    return F.exists(_before_tax(fig, taxes), met)


def marked(assertions: DataFrame, facts: DataFrame, keys: Sequence[str], taxes: Sequence[float],
           together: int = joins.TOGETHER) -> DataFrame:
    """``keys, fig, is_verbatim, is_derivable`` of every asserted figure (cents).

    ``facts``: keys and three nullable amounts: ``item`` counts in sums, ``name`` may
    only be named as it is, ``calc`` be named as it is or taxed.  Up to ``together``
    figures and facts of a key meet as arrays in one row, so each side is shuffled
    once.  Keys with more are joined row by row: tax is undone first, as only the
    few cent values that tax to the figure are candidates, and a pair a + b is
    searched as "is candidate - a also an item", so the work is figures x items,
    never items x items.
    """
    keys = list(keys)
    a = assertions.select(*keys, F.col("value").alias("fig"))
    hot = joins.crowded([a, facts], keys, together)
    if hot is None:
        return _marked_together(a, facts, keys, taxes)
    (few_a, many_a), (few_f, many_f) = (joins.parted(df, keys, hot) for df in (a, facts))
    return _marked_together(few_a, few_f, keys, taxes).unionByName(_marked_by_rows(many_a, many_f, keys, taxes))


def _marked_together(a: DataFrame, facts: DataFrame, keys: list[str], taxes: Sequence[float]) -> DataFrame:
    figs = a.groupBy(*keys).agg(F.collect_set(F.struct("fig")).alias("_f"))  # a struct keeps a null figure
    per = facts.groupBy(*keys).agg(F.collect_list("item").alias("_items"), F.collect_set("name").alias("_names"),
                                   F.collect_set("calc").alias("_calcs"), F.sum("item").alias("_grand"))
    pairs = F.flatten(F.transform("_items", lambda x, i: F.transform(F.slice("_items", i + 2, F.size("_items")), lambda y: x + y)))
    per = per.select(*keys, F.array_union(F.array_union("_items", "_names"), "_calcs").alias("_known"), F.array_distinct(F.concat(
        "_items", "_calcs", F.array_compact(F.array("_grand")), pairs)).alias("_totals"))
    per = per.select(*keys, "_known", F.flatten(F.array(*[_taxed("_totals", r) for r in taxes])).alias("_taxed"))
    has = lambda c, fig: F.coalesce(F.array_contains(c, fig), F.lit(False))
    return figs.join(per, keys, "left").select(*keys, F.inline(F.transform("_f", lambda f: F.struct(
        f["fig"].alias("fig"), has("_known", f["fig"]).alias("is_verbatim"), has("_taxed", f["fig"]).alias("is_derivable")))))


def _marked_by_rows(a: DataFrame, facts: DataFrame, keys: list[str], taxes: Sequence[float]) -> DataFrame:
    a, items = a.distinct(), facts.filter(F.col("item").isNotNull())
    per = items.groupBy(*keys, "item").agg(F.count(F.lit(1)).alias("cnt"))
    tot = items.groupBy(*keys).agg(F.sum("item").alias("sum"))
    cand = a.withColumn("sum", F.explode(_before_tax(F.col("fig"), taxes)))
    single = per.select(*keys, F.col("item").alias("sum")).unionByName(tot).unionByName(
        facts.filter(F.col("calc").isNotNull()).select(*keys, F.col("calc").alias("sum")))
    single = cand.join(single, [*keys, "sum"], "left_semi").select(*keys, "fig")
    halves = cand.join(per, keys).withColumn("other", F.col("sum") - F.col("item"))
    other = per.select(*keys, F.col("item").alias("other"), F.col("cnt").alias("cnt2"))
    pair = halves.join(other, [*keys, "other"]).filter(
        (F.col("item") != F.col("other")) | (F.col("cnt2") >= 2)).select(*keys, "fig")
    ok = single.unionByName(pair).distinct().withColumn("is_derivable", F.lit(True))
    known = facts.select(*keys, F.explode(F.array("item", "name", "calc")).alias("fig")).filter(F.col("fig").isNotNull()).distinct()
    verb = a.join(known, [*keys, "fig"], "left_semi").withColumn("is_verbatim", F.lit(True))
    return a.join(ok, [*keys, "fig"], "left").join(verb, [*keys, "fig"], "left").select(
        *keys, "fig", F.coalesce("is_verbatim", F.lit(False)).alias("is_verbatim"),
        F.coalesce("is_derivable", F.lit(False)).alias("is_derivable"))


def objective_label(figures: DataFrame, expected: DataFrame, marks: DataFrame,
                    keys: Sequence[str], tol: float = 50.0) -> DataFrame:
    """healthy / incomplete / arithmetic_error / hallucinated / other per episode.

    ``figures``: (keys, ord, value) of the answer, the last one is its total.
    ``expected``: (keys, expected, contradicted, work_missing).
    """
    keys = list(keys)
    prov = F.col("is_verbatim") | F.col("is_derivable")
    m = marks.select(*keys, F.col("fig").alias("value"), prov.alias("_prov"))
    fin = figures.select(*keys, "ord", "value").join(m, [*keys, "value"], "left").groupBy(*keys).agg(
        F.max_by(F.struct("value", "_prov"), "ord").alias("_fin"),
        F.coalesce(F.min(F.when(~F.col("_prov"), F.col("ord"))) < F.max("ord"), F.lit(False)).alias("_loose"))
    j = expected.join(fin, keys, "left").withColumns({"final": F.col("_fin.value"), "_prov": F.col("_fin._prov")})
    right = F.abs(F.col("final") - F.col("expected")) <= tol
    return j.select(*keys, F.when(F.coalesce("_loose", F.lit(False)) | F.col("contradicted"), "hallucinated")
                    .when(F.col("final").isNull(), "other")
                    .when(right & F.col("work_missing"), "incomplete").when(right, "healthy")
                    .when(F.coalesce("_prov", F.lit(False)), "arithmetic_error")
                    .otherwise("hallucinated").alias("label"))
