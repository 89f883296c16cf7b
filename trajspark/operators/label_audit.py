"""Do the labels of listed episodes agree with what their steps show?  And moving those that don't."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
# Texts that an injected failure of a class leaves in a tool's result.
MARKERS = {
    "rate_limit": ("429 Too Many Requests",),
    "timeout": ("timed out after 30s",),
    "sql_timeout": ("SQL statement timeout",),
    "mcp_unavailable": ("unavailable (connection refused)",),
    "browser_fail": ("net::ERR_CONNECTION_TIMED_OUT",),
    "tool_cascade": ("service unavailable (HTTP 503)",),
    "looping": ("Temporary data inconsistency detected",),
    "wrong_document": ("Sourdough bread relies on a wild-yeast s", "The 1994 World Cup final was decided by ",
                       "Basalt columns form as thick lava flows ", "Double-entry bookkeeping records every t"),
    "goal_drift": ("[SYSTEM UPDATE:",),
}
# Label of a study -> the injected classes it stands for (others stand for themselves).
STANDS_FOR = {
    "tool_cascade": ("tool_cascade", "rate_limit", "malformed_json", "sql_timeout", "mcp_unavailable", "browser_fail", "timeout"),
    "grounding_loss": ("wrong_document",),
}
CORRUPTED = r"\$\d{1,3}\s*$"   # a corrupted context ends on a dollar figure
BLOCKING = ("no_op_positive", "unverifiable_positive", "unsuccessful_healthy", "no_post_onset_steps",
            "labelled_without_tau", "missing_trace_file", "manifest_T_mismatch")
# -----------------------------------------------------------------------------


def _shows(label: Column, results: Column, markers: Mapping[str, Sequence[str]]) -> Column:
    """Is the label's mutation visible in one of the results?"""
    def has_any(texts: Sequence[str]) -> Callable[[Column], Column]:
        return lambda r: F.array_contains(F.array(*[r.contains(x) for x in texts]), True)

    tests = {cls: has_any(texts) for cls, texts in markers.items()}
    tests["malformed_json"] = lambda r: F.trim(r).rlike(r"^[{\[]") & F.try_parse_json(F.trim(r)).isNull()
    tests["context_corruption"] = lambda r: r.rlike(CORRUPTED)
    out = F.lit(False)
    for cls, test in tests.items():
        names = [k for k, v in STANDS_FOR.items() if cls in v] + ([] if cls in STANDS_FOR else [cls])
        out = out | (label.isin(*names) & F.exists(results, test))
    return F.coalesce(out, F.lit(False))


def audit_labels(entries: DataFrame, steps: DataFrame, keys: Sequence[str], *, digests: DataFrame | None = None,
                 markers: Mapping[str, Sequence[str]] = MARKERS) -> DataFrame:
    """``keys, failure_class, tau, n_steps, verdict, defects, blocking`` of every listed episode.

    ``entries`` (schema.MANIFEST and keys): failure_class, tau, T, has_logprobs,
    success, injection, trace_sha256.  ``steps`` (keys, t, and of schema.STEP
    token_logprobs, error, task, tool_events) with ``calls`` (structs with
    ``result``) as step_calls gives them.  ``digests``: (keys, digest) of the trace
    files as they are now; only with an equal digest the collector's own record
    of its injection counts.

    ``verdict`` of a labelled episode with steps after its onset: ``confirmed``
    (a mutation, an error flag or a bound record is there), ``no_op`` (results
    were recorded, none mutated), ``unverifiable`` (no results after the onset).
    ``defects`` is an array in a fixed order, ``blocking`` those of them that make
    the label unusable.  Episodes whose steps are missing have that one defect.
    """
    keys = list(keys)
    info = entries.select(*keys, "failure_class", "tau", F.col("T").alias("_T"), F.col("has_logprobs").alias("_flag"), "success",
                          F.col("injection.applied_count").alias("_applied"), F.col("trace_sha256").alias("_bound"))
    results = F.filter(F.transform("calls", lambda c: c["result"]), lambda r: r != "")
    mine = steps.join(info.select(*keys, "failure_class", "tau"), keys)
    after = F.col("failure_class").isNotNull() & (F.col("t") >= F.col("tau"))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    seen = mine.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), any_(F.size("token_logprobs") > 0).alias("_lp"), any_(F.size("tool_events") > 0).alias("_ev"),
        any_(F.length("task") > 0).alias("_task"), any_(after & F.col("error")).alias("_err"),
        F.sum(F.when(after, F.size(results)).otherwise(0)).alias("_res"),
        any_(after & _shows(F.col("failure_class"), results, markers)).alias("_shown"))
    j = info.join(seen, keys, "left")
    if digests is not None:
        j = j.join(digests.select(*keys, F.col("digest").alias("_digest")), keys, "left")
    else:
        j = j.withColumn("_digest", F.lit(None).cast("string"))
    record = (F.coalesce("_applied", F.lit(0)) > 0) & (F.col("_bound") == F.col("_digest"))
    inj = F.col("failure_class").isNotNull()
    judged = inj & F.col("tau").isNotNull() & (F.col("tau") < F.col("_n") - 1)
    verdict = F.when(judged, F.when(F.coalesce(record, F.lit(False)) | F.col("_shown") | F.col("_err"), "confirmed")
                     .when(F.col("_res") == 0, "unverifiable").otherwise("no_op"))
    gone = F.col("_n").isNull()
    j = j.withColumn("verdict", F.when(~gone, verdict))
    codes = F.array_compact(F.array(
        F.when(F.col("_T") != F.col("_n"), "manifest_T_mismatch"),
        F.when(F.col("_flag") != F.col("_lp"), "logprob_flag_mismatch"),
        F.when(inj & F.col("tau").isNull(), "labelled_without_tau"),
        F.when(inj & (F.col("tau") >= F.col("_n") - 1), "no_post_onset_steps"),
        F.when(F.col("verdict") != "confirmed", F.concat("verdict", F.lit("_positive"))),
        F.when(~inj & (~F.col("success")), "unsuccessful_healthy"),
        F.when(~F.col("_ev"), "legacy_text_only_telemetry"), F.when(~F.col("_task"), "no_task_recorded")))
    defects = F.when(gone, F.array(F.lit("missing_trace_file"))).otherwise(codes)
    return j.select(*keys, "failure_class", "tau", F.coalesce("_n", F.lit(0)).cast("int").alias("n_steps"), "verdict",
                    defects.alias("defects")).withColumn(
        "blocking", F.filter("defects", lambda x: x.isin(*BLOCKING)))


def defect_counts(audited: DataFrame, by: Sequence[str]) -> DataFrame:
    """Episodes per (by, defect), and whether the defect blocks."""
    return audited.select(*by, F.explode("defects").alias("defect")).groupBy(*by, "defect").agg(
        F.count(F.lit(1)).alias("n")).withColumn("blocks", F.col("defect").isin(*BLOCKING))


# ------------------------------------------------------------------ retirement
def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Committed (version, attempt), ascending: one small row per retirement ever made."""
    from pyspark.errors import AnalysisException
    try:
        rows = spark.read.schema("version int, attempt string").parquet(f"{path}/commits/*").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((r.version, r.attempt) for r in rows)


def _commit(spark: SparkSession, path: str, version: int, attempt: str) -> None:
    """The one step that makes an attempt visible: one row in one file, refused if the version is there."""
    spark.createDataFrame([(version, attempt)], "version int, attempt string").coalesce(1).write.mode("error") \
        .parquet(f"{path}/commits/v{version}")


def create_labels(entries: DataFrame, path: str) -> None:
    """Version 0 of a label store: every entry accepted, none rejected."""
    attempt = uuid.uuid4().hex
    entries.write.parquet(f"{path}/attempts/{attempt}/accepted")
    _commit(entries.sparkSession, path, 0, attempt)


def accepted(spark: SparkSession, path: str) -> DataFrame:
    """The entries whose labels stand, as of the last commit."""
    done = _versions(spark, path)
    if not done:
        raise ValueError(f"no label store at {path}")
    return spark.read.parquet(f"{path}/attempts/{done[-1][1]}/accepted")


def rejected(spark: SparkSession, path: str) -> DataFrame | None:
    """What all commits moved out, with reason and version; None before the first move."""
    moved = [f"{path}/attempts/{a}/rejected" for v, a in _versions(spark, path) if v > 0]
    return spark.read.parquet(*moved) if moved else None


def retire(spark: SparkSession, path: str, audited: DataFrame, keys: Sequence[str]) -> int:
    """Move entries with a blocking defect from accepted to rejected; returns the version that then holds.

    Both outputs are written into the folder of this attempt, which no reader
    looks at; then one row that names the attempt is written as the next version.
    A job that dies before that leaves everything as it was, a retry starts from
    the last version, and a retry after it finds nothing more to move.  Of two
    writers at once the second is refused by the version's name.  Duplicate audit
    rows of one episode move it once, with the reasons joined.
    """
    keys = list(keys)
    version, attempt = _versions(spark, path)[-1][0] + 1, uuid.uuid4().hex
    now = accepted(spark, path)
    bad = audited.filter(F.size("blocking") > 0).select(*keys, F.explode("blocking").alias("_code")).groupBy(*keys).agg(
        F.concat(F.lit("retroactive gate: "), F.array_join(F.array_sort(F.collect_set("_code")), ", ")).alias("reason"))
    moved = now.join(bad, keys).withColumn("retired_in", F.lit(version))
    out = f"{path}/attempts/{attempt}"
    moved.write.parquet(f"{out}/rejected")
    if spark.read.schema(moved.schema).parquet(f"{out}/rejected").isEmpty():
        return version - 1
    now.join(bad, keys, "left_anti").write.parquet(f"{out}/accepted")
    _commit(spark, path, version, attempt)
    return version
