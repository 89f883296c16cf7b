"""Explicit schemas, fixed vocabularies and fixed constants."""

from __future__ import annotations

from pyspark.sql import types as T

TOOL_EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("args", T.MapType(T.StringType(), T.StringType())),
    T.StructField("result", T.StringType()),
    T.StructField("result_chars", T.IntegerType()),
    T.StructField("result_truncated", T.BooleanType()),
    T.StructField("is_error", T.BooleanType()),
    T.StructField("latency_s", T.DoubleType()),
    T.StructField("source", T.StringType()),
])

STEP = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("token_logprobs", T.ArrayType(T.DoubleType())),
    T.StructField("logprobs_available", T.BooleanType()),
    T.StructField("action", T.StringType()),
    T.StructField("latency_s", T.DoubleType()),
    T.StructField("output_tokens", T.IntegerType()),
    T.StructField("error", T.BooleanType()),
    T.StructField("task", T.StringType()),
    T.StructField("schema", T.IntegerType()),
    T.StructField("tool_events", T.ArrayType(TOOL_EVENT)),
])

MANIFEST = T.StructType([
    T.StructField("episode_id", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("failure_class", T.StringType()),
    T.StructField("tau", T.IntegerType()),
    T.StructField("T", T.IntegerType()),
    T.StructField("has_logprobs", T.BooleanType()),
    T.StructField("model", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("accepted_because", T.StringType()),
    T.StructField("injection", T.StructType([
        T.StructField("applied_count", T.IntegerType()),
        T.StructField("first_applied_t", T.IntegerType()),
        T.StructField("requested_tau", T.IntegerType()),
        T.StructField("applied_tools", T.ArrayType(T.StringType())),
    ])),
    T.StructField("provenance", T.MapType(T.StringType(), T.StringType())),
    T.StructField("provenance_fingerprint", T.StringType()),
    T.StructField("trace_sha256", T.StringType()),
    T.StructField("collected_at", T.StringType()),
    T.StructField("requested_tau", T.IntegerType()),
])

REJECTED = T.StructType([
    T.StructField("episode_id", T.StringType()),
    T.StructField("requested_class", T.StringType()),
    T.StructField("reason", T.StringType()),
])

# ---- fixed values -----------------------------------------------------------
# Channel widths of a step vector: e (semantic), u (uncertainty), m (metadata),
# x (derived), g (content grounding).
WIDTHS = {"e": 32, "u": 4, "m": 7, "x": 8, "g": 9}
EPISODE_WIDTHS = (43, 51, 60)

ACTION_TYPES = ("plan", "tool_call", "tool_result", "synthesis")

ACTION_OF = {
    "plan": "plan", "think": "plan", "thought": "plan", "reasoning": "plan",
    "reflect": "plan",
    "tool_call": "tool_call", "act": "tool_call", "action": "tool_call",
    "function_call": "tool_call", "tool": "tool_call",
    "tool_result": "tool_result", "observation": "tool_result",
    "tool_response": "tool_result", "function_result": "tool_result",
    "synthesis": "synthesis", "final": "synthesis", "answer": "synthesis",
    "respond": "synthesis", "response": "synthesis",
}

FAILURE_CLASSES = (
    "goal_drift", "looping", "tool_cascade", "grounding_loss",
    "context_corruption", "wrong_document", "malformed_json", "rate_limit",
    "timeout", "sql_timeout", "mcp_unavailable", "browser_fail", "external",
)

MIN_STEPS = 4                # shortest episode a study uses
MIN_LATENCY_S = 1e-3         # latency floor
HIGH_SURPRISAL_NATS = 2.5
MISSING_SURPRISAL = -1.0
CONTEXT_BUDGET_TOKENS = 8192.0
CONTEXT_RATIO_CAP = 2.0
DEGENERATE_EPS = 1e-9
WASHOUT_STEPS = 3            # first steps of a reservoir stream score 0
