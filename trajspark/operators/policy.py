"""Escalation policies over a verdict table.

Verdicts are given per (episode, step); nothing here models a judge.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.operators import ordered


@dataclass(frozen=True)
class Judge:
    debounce: int = 2     # consecutive positives that halt a run
    cooldown: int = 3     # steps without escalation after a negative


def never(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    return steps.select(*keys).distinct().select(
        *keys, F.lit(None).cast("int").alias("halted_at"), F.lit(0).cast("long").alias("calls"))


def halt_on_alarm(steps: DataFrame, keys: Sequence[str], t: str, trigger: Column) -> DataFrame:
    return steps.groupBy(*keys).agg(F.min(F.when(trigger, F.col(t))).alias("halted_at"),
                                    F.lit(0).cast("long").alias("calls"))


def judge_every_step(steps: DataFrame, keys: Sequence[str], t: str, positive: Column,
                     judge: Judge = Judge()) -> DataFrame:
    """Halt on ``debounce`` positives in a row; every executed step is a call."""
    lb = ordered.look_back(steps.withColumn("_p", positive.cast("int")), keys, t, judge.debounce - 1)
    run = F.min("_p").over(lb.window(-(judge.debounce - 1)))
    s = lb.with_columns({"_full": (run == 1) & (F.col(t) >= judge.debounce - 1)})
    halt = F.min(F.when(F.col("_full"), F.col(t)))
    return s.groupBy(*keys).agg(halt.alias("halted_at"), F.max(t).alias("_last")).select(
        *keys, "halted_at", (F.coalesce("halted_at", "_last") + 1).cast("long").alias("calls"))


def _machine(judge: Judge) -> tuple[list[int], list[int], int]:
    """Transition and call tables of the escalation rule.

    States: 0..debounce-1 = length of the positive streak, then one state per
    remaining cooldown step, then the absorbing halt.  Symbols: 0 not
    triggered, 1 triggered and negative, 2 triggered and positive.
    """
    d, c = judge.debounce, judge.cooldown
    halt = d + c
    nxt, call = [], []
    for s in range(halt + 1):
        if s == halt:
            nxt += [halt] * 3
            call += [0] * 3
        elif s >= d:
            after = s - 1 if s > d else 0
            nxt += [after] * 3
            call += [0] * 3
        else:
            nxt += [0, d + c - 1 if c else 0, halt if s + 1 == d else s + 1]
            call += [0, 1, 1]
    return nxt, call, halt


def segment_runs(steps: DataFrame, keys: Sequence[str], t: str, trigger: Column, positive: Column,
                 judge: Judge = Judge(), seg_rows: int = ordered.SEG_ROWS) -> DataFrame:
    """``keys, _seg, _out``: per segment the end (state, calls, halt) from each state it could start in.

    Nothing is before segment 0, so that one has only its end from state 0.
    """
    keys = list(keys)
    nxt, call, halt = _machine(judge)
    sym = F.when(~trigger, 0).when(positive, 2).otherwise(1)
    nxt_c = F.array(*[F.lit(v) for v in nxt])
    call_c = F.array(*[F.lit(v) for v in call])

    def run(arr: Column, start: int) -> Column:
        init = F.struct(F.lit(start).alias("s"), F.lit(0).alias("c"), F.lit(-1).alias("h"))

        def step(acc: Column, x: Column) -> Column:
            i = acc["s"] * 3 + x["y"]
            to = F.get(nxt_c, i)
            return F.struct(to.alias("s"), (acc["c"] + F.get(call_c, i)).alias("c"),
                            F.when((to == halt) & (acc["h"] < 0), x["t"])
                            .otherwise(acc["h"]).alias("h"))
        return F.aggregate(arr, init, step)

    d = steps.select(*keys, F.col(t).cast("int").alias("_t"), sym.alias("_y")).withColumn(
        "_seg", F.floor(F.col("_t") / seg_rows))
    segs = d.groupBy(*keys, "_seg").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_t").alias("t"), F.col("_y").alias("y")))).alias("_a"))
    first = F.array(run(F.col("_a"), 0))
    return segs.select(*keys, "_seg", F.when(F.col("_seg") == 0, first).otherwise(
        F.array(*[run(F.col("_a"), s) for s in range(halt)])).alias("_out"))


def escalate_on_alarm(steps: DataFrame, keys: Sequence[str], t: str, trigger: Column,
                      positive: Column, judge: Judge = Judge(),
                      seg_rows: int = ordered.SEG_ROWS) -> DataFrame:
    """Judge triggered steps only, with debounce and cooldown.

    The rule is a small automaton.  Each bounded segment is run from every
    state it could start in; the segments of an episode are then chained.
    """
    keys = list(keys)
    halt = _machine(judge)[2]
    segs = segment_runs(steps, keys, t, trigger, positive, judge, seg_rows)
    chained = segs.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_seg", "_out"))).alias("_segs"))
    init = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("c"), F.lit(-1).alias("h"))

    def chain(acc: Column, seg: Column) -> Column:
        o = F.get(seg["_out"], acc["s"])
        done = acc["s"] == halt
        return F.struct(F.when(done, acc["s"]).otherwise(o["s"]).alias("s"),
                        F.when(done, acc["c"]).otherwise(acc["c"] + o["c"]).cast("long").alias("c"),
                        F.when(done, acc["h"]).otherwise(o["h"]).alias("h"))
    end = chained.select(*keys, F.aggregate("_segs", init, chain).alias("_end"))
    return end.select(*keys, F.when(F.col("_end.h") >= 0, F.col("_end.h")).alias("halted_at"),
                      F.col("_end.c").alias("calls"))


def outcomes(halts: DataFrame, episodes: DataFrame, keys: Sequence[str],
             cost_step: float = 1.0, cost_judge: float = 1.0) -> DataFrame:
    """Cost, detection and wrongful halts; a halt before the onset is wrongful."""
    j = halts.join(episodes, list(keys))
    h, n = F.col("halted_at"), F.col("n_steps")
    detected = ~F.col("is_healthy") & h.isNotNull() & (h >= F.col("tau"))
    detected = F.coalesce(detected, F.lit(False))
    wrong = h.isNotNull() & ~detected
    cost = F.coalesce(h + 1, n) * F.lit(cost_step) + F.col("calls") * F.lit(cost_judge) \
        + F.when(wrong, F.lit(cost_step) * (n - 1 - h)).otherwise(0.0)
    return j.withColumns({"detected": detected, "wrongful_halt": wrong, "cost": cost.cast("double"),
                          "lead_steps": F.when(detected, (n - 1 - h).cast("double"))})


def summarize(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    inj = ~F.col("is_healthy")
    d, w = F.col("detected").cast("double"), F.col("wrongful_halt").cast("double")
    return rows.groupBy(*by).agg(
        F.avg("cost").alias("mean_cost"), F.avg("calls").alias("mean_judge_calls"),
        F.avg(F.when(inj, d)).alias("detection_rate"), F.avg("lead_steps").alias("mean_lead"),
        F.avg(w).alias("wrongful_halt_rate"),
        F.avg(F.when(~inj, w)).alias("healthy_wrongful_halt_rate"),
        F.avg(F.when(inj, w)).alias("early_injected_halt_rate"))


def cost_at(mean_cost: Column, mean_calls: Column, ratio: Column, recorded: float = 1.0) -> Column:
    """A recorded mean cost at another judge / step price ratio."""
    return mean_cost - F.lit(recorded) * mean_calls + ratio * mean_calls


def break_even(s_cost: Column, s_calls: Column, e_cost: Column, e_calls: Column,
               recorded: float = 1.0) -> Column:
    """Price ratio at which the selective policy stops being cheaper."""
    r = F.lit(recorded)
    den = e_calls - s_calls
    return F.when(den != 0, ((s_cost - r * s_calls) - (e_cost - r * e_calls)) / den)


def pick_operating_point(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """Cheapest conf_threshold with at least ``share`` of the full judge's detection."""
    full = rows.filter("policy = 'judge_every_step'").select(F.col("detection_rate").alias("_full"))
    ok = rows.crossJoin(F.broadcast(full)).filter(
        (F.col("policy") == "escalate_on_alarm") & F.col("conf_threshold").isNotNull()
        & (F.col("_full") > 0) & (F.col("detection_rate") >= F.lit(share) * F.col("_full")))
    return ok.agg(F.min_by("conf_threshold", F.struct("judge_call_ratio", "conf_threshold"))
                  .alias("conf_threshold"))
