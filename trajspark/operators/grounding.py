"""Content grounding of a step: how its tool results fit query, reasoning and history.

Nine numbers per step, 0 where the step has no results; higher is more anomalous:
query (result vs its own query), reason (results vs the step's reasoning), self
(vs the mean of earlier result steps), json (broken JSON share), chars (character
statistics vs earlier results, plus junk), consec (vs the previous result step),
drift (EWMA of self), memory (reasoning vs the last three result steps), lexical
(results without a word of query or task).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark import schema
from trajspark.functions import text, vector
from trajspark.operators import features, models, ordered
from trajspark.sources import sinks

#: The order of the nine dims, and the weight of the newest value in the drift.
DIMS = ("query", "reason", "self", "json", "chars", "consec", "drift", "memory", "lexical")
DRIFT_ALPHA, MEMORY_STEPS = 0.4, 3


def _far(a: Column, b: Column) -> Column:
    """1 - cosine; null when either side is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), 1.0 - vector.cosine(a, b))


def observed(steps: DataFrame, embed: Callable[[list[str]], np.ndarray] = models.embedded) -> DataFrame:
    """Steps with what their results say by themselves, so for a log and for a stream alike.

    ``has`` (any result), ``anchor`` (task, or without one the reasoning: a run is held against that of its first
    step), ``query``, ``json``, ``alnum``, ``junk``, ``said`` and ``why`` (vectors of results and reasoning),
    ``reasoned``, and ``strange``: the content words of each document that shares none with its own query.
    Needs ``task``, ``reasoning`` and ``calls`` (see ``text.step_calls``).
    """
    vector_of, why = models.embedding(embed), F.coalesce("reasoning", F.lit(""))
    d = steps.withColumn("_c", F.filter("calls", lambda c: c["has_result"] & (c["result"] != "")))
    d = d.withColumn("_said", F.array_join(F.transform("_c", lambda c: c["result"]), " "))
    alnum, junk = text.char_stats(F.col("_said"))
    strange = F.filter("_c", lambda c: text.lexical_miss(c["result"], c["args"], F.lit(""))[0] > 0)
    return d.withColumns({
        "has": F.size("_c") > 0, "anchor": F.when(F.trim("task") != "", F.col("task")).otherwise(why),
        "query": models.mean_gap(embed)(F.transform("_c", lambda c: c["result"]),
                                        F.transform("_c", lambda c: F.concat_ws(" ", c["name"], c["args"]))),
        "json": text.json_broken_share(F.col("_c")), "alnum": alnum, "junk": junk, "said": vector_of(F.col("_said")),
        "why": vector_of(why), "reasoned": why != "",
        "strange": F.transform(strange, lambda c: text.content_words(c["result"]))}).drop("_c", "_said")


OBSERVED = ("has", "anchor", "query", "json", "alnum", "junk", "said", "why", "reasoned", "strange")


def grounding_channel(steps: DataFrame, keys: Sequence[str], t: str, out: str = "g",
                      embed: Callable[[list[str]], np.ndarray] = models.embedded) -> DataFrame:
    """Steps with array column ``out`` of the nine dims.

    Results are compared in the order of the steps that have any; sums over earlier
    steps are running aggregates over segments, so a long run is no single task.
    """
    keys = list(keys)
    anchor = steps.groupBy(*keys).agg(F.min_by(F.struct("task", "reasoning"), F.col(t)).alias("_f")).select(
        *keys, text.content_words(F.when(F.trim("_f.task") != "", F.col("_f.task")).otherwise(
            F.coalesce("_f.reasoning", F.lit("")))).alias("_task"))
    r = observed(steps, embed).filter("has").select(*keys, t, *OBSERVED[2:]).join(anchor, keys)
    miss = F.exists("strange", lambda w: ~F.arrays_overlap(w, F.col("_task"))).cast("double")

    # written once, without the texts: the nine dims read it several times
    r = sinks.materialize(r.select(*keys, t, miss.alias("lexical"), "query", "json", "alnum", "junk", "said", "why", "reasoned"), "result_steps")
    r = ordered.running(r.withColumn("_one", F.lit(1)), keys, t, {"_n": ordered.Run("sum", "_one")})
    r = r.withColumn("_r", (F.col("_n") - 1).cast("int")).drop("_n")
    width = schema.WIDTHS["e"]
    r = features.past_vector_sum(r, keys, "_r", "said", width, "_past", {"_sum": ordered.Run("sum", "alnum", False)})
    lb = ordered.look_back(r, keys, "_r", MEMORY_STEPS)
    r = lb.with_columns({f"_p{k}": F.lag("said", k).over(lb.order) for k in range(1, MEMORY_STEPS + 1)})
    none = F.array(*[F.lit(0.0)] * width)
    memory = F.col("_p1")
    for k in range(2, MEMORY_STEPS + 1):
        memory = F.zip_with(memory, F.coalesce(f"_p{k}", none), lambda a, b: a + b)
    first = F.col("_r") == 0
    r = r.withColumns({
        "self": F.when(~first, _far(F.col("said"), F.col("_past"))).otherwise(0.0),
        "reason": F.when(F.col("reasoned"), _far(F.col("said"), F.col("why"))).otherwise(0.0),
        "chars": F.when(~first, F.abs(F.col("alnum") - F.col("_sum") / F.col("_r"))).otherwise(0.0) + F.col("junk"),
        "consec": F.coalesce(_far(F.col("said"), F.col("_p1")), F.lit(0.0)),
        "memory": F.when(F.col("reasoned") & ~first, _far(F.col("why"), memory)).otherwise(0.0)})
    r = ordered.ewma(r.select(*keys, t, "_r", *(d for d in DIMS if d != "drift")), keys, "_r", "self", "drift", DRIFT_ALPHA)
    g = r.select(*keys, t, F.array(*[F.coalesce(d, F.lit(0.0)) for d in DIMS]).alias(out))
    return steps.join(g, [*keys, t], "left").withColumn(out, F.coalesce(out, F.array(*[F.lit(0.0)] * len(DIMS))))
