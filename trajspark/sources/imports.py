"""External conversation corpora as step records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.functions import text as txt
from trajspark.operators import ordered

CALLS = T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("arguments", T.StringType())]))
RESULTS = T.ArrayType(T.StructType([
    T.StructField("call_id", T.StringType()), T.StructField("result", T.StringType())]))


def _words(c: Column) -> Column:
    n = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return F.greatest(n, F.lit(1)).cast("int")


def _next(turns: DataFrame, keys: Sequence[str], turn: str, cols: dict[str, str]) -> DataFrame:
    """Columns of the following turn: a lag along the reversed index."""
    back = turns.withColumn("_turn", F.col(turn) + F.lit(1))
    follow = back.select(*keys, (F.col(turn) - 1).alias(turn), *[F.col(c).alias(o) for o, c in cols.items()])
    return turns.join(follow, [*keys, turn], "left")


def owners(turns: DataFrame, keys: Sequence[str], turn: str, agent_role: str,
           role: str = "role") -> DataFrame:
    """Step index owning each turn: agent turns seen so far, minus one."""
    t = turns.withColumn("_a", (F.col(role) == agent_role).cast("int"))
    return ordered.running(t, keys, turn, {"_c": ordered.Run("sum", "_a")}).withColumn(
        "owner", (F.col("_c") - 1).cast("int")).drop("_a", "_c")


def positional_steps(turns: DataFrame, keys: Sequence[str], turn: str, agent_role: str = "agent",
                     environment_role: str = "environment", role: str = "role",
                     text: str = "text") -> DataFrame:
    """Agent turns as steps; the next environment turn is the step's result."""
    own = owners(turns, keys, turn, agent_role, role)
    nxt = _next(own, keys, turn, {"_nr": role, "_nt": text}).filter(F.col(role) == agent_role)
    has = F.coalesce(F.col("_nr") == environment_role, F.lit(False))
    res = F.when(has, F.col("_nt")).otherwise("")
    return nxt.withColumns({
        "t": F.col("owner"), "has_result": has, "result": res, "result_chars": F.length(res),
        "is_error": has & txt.import_error(res),
        "action": F.when(has, "tool_call").otherwise("synthesis"),
        "output_tokens": _words(F.col(text))}).drop("_nr", "_nt", "owner")


def steps_with_call_ids(turns: DataFrame, keys: Sequence[str], turn: str, agent_role: str = "agent",
                        environment_role: str = "environment") -> DataFrame:
    """Agent turns (role, thought, action JSON, content) as steps, results matched by call id."""
    own = owners(turns, keys, turn, agent_role)
    nxt = _next(own, keys, turn, {"_nr": "role", "_nc": "content"}).filter(F.col("role") == agent_role)
    calls = F.coalesce(F.from_json("action", CALLS), F.array().cast(CALLS))
    got = F.when(F.col("_nr") == environment_role, F.from_json("_nc", RESULTS))
    by_id = F.map_from_entries(F.array_distinct(F.transform(
        F.coalesce(got, F.array().cast(RESULTS)), lambda r: F.struct(r["call_id"], r["result"]))))
    nxt = nxt.withColumns({"_calls": calls, "_by": by_id})
    events = F.transform("_calls", lambda c: F.struct(
        c["id"].alias("id"), c["name"].alias("name"), c["arguments"].alias("args"),
        F.coalesce(F.element_at("_by", c["id"]), F.lit("")).alias("result")))
    events = F.transform(events, lambda e: F.struct(
        e["id"].alias("id"), e["name"].alias("name"), e["args"].alias("args"), e["result"].alias("result"),
        F.length(e["result"]).alias("result_chars"), F.lit(False).alias("result_truncated"),
        txt.import_error(e["result"]).alias("is_error")))
    body = F.array_join(F.filter(F.array(F.coalesce("thought", F.lit("")), F.coalesce("content", F.lit(""))),
                                 lambda s: F.trim(s) != ""), " ")
    return nxt.select(*keys, F.col("owner").alias("t"), F.col(turn), body.alias("text"),
                      events.alias("tool_events")).withColumns({
        "action": F.when(F.size("tool_events") > 0, "tool_call").otherwise("synthesis"),
        "error": F.exists("tool_events", lambda e: e["is_error"]),
        "output_tokens": _words(F.col("text")), "logprobs_available": F.lit(False)})


def onsets(turns: DataFrame, mistakes: DataFrame, keys: Sequence[str], turn: str, mistake: str,
           agent_role: str = "agent") -> DataFrame:
    """Onset step of the turn a label points at; unplaced before any agent step."""
    own = owners(turns, keys, turn, agent_role).select(*keys, F.col(turn).alias(mistake), "owner")
    j = mistakes.join(own, [*keys, mistake], "left")
    return j.select(*keys, F.when(F.col("owner") >= 0, F.col("owner")).alias("tau"),
                    (F.coalesce("owner", F.lit(-1)) < 0).alias("unplaced"))
