"""Reading and writing step logs, manifests and rejects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark import schema


def read_steps(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Step JSONL files (one file per run, ``<dataset>/<episode_id>.jsonl``).

    Returns (steps, bad lines).  Files are read in blocks; a line's number is its
    place in its block plus the lines of the file's earlier blocks, so neither a
    file nor a run has to fit a task.
    """
    lines = spark.read.text(path, pathGlobFilter="*.jsonl").select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_order"),
        (F.trim("value") != "").cast("long").alias("_full"))
    own, before = W.partitionBy("file", "_block"), W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("n"), F.sum("_full").alias("f")).select(
        "file", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n"),
        F.coalesce(F.sum("f").over(before), F.lit(0)).alias("_f"))
    upto = own.orderBy("_order").rowsBetween(W.unboundedPreceding, 0)
    numbered = lines.withColumns({"_i": F.count(F.lit(1)).over(upto), "_k": F.sum("_full").over(upto)}).join(
        blocks, ["file", "_block"]).filter("_full = 1")
    parts = F.split("file", "/")
    rows = numbered.select(
        F.element_at(parts, -2).alias("dataset"),
        F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", "").alias("episode_id"), "file",
        (F.col("_f") + F.col("_k") - 1).cast("int").alias("t"),
        F.struct((F.col("_n") + F.col("_i")).cast("int").alias("line"), "text").alias("_l"))
    full = T.StructType([*schema.STEP.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = rows.withColumn("_s", F.from_json("_l.text", full, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    ok = parsed.filter("_s._corrupt_record IS NULL AND _s IS NOT NULL")
    bad = parsed.filter("_s._corrupt_record IS NOT NULL OR _s IS NULL").select(
        "dataset", "episode_id", "file", F.col("_l.line").alias("line"), F.col("_l.text").alias("content"))
    return ok.select("dataset", "episode_id", "t", *[F.col(f"_s.{f.name}") for f in schema.STEP.fields]), bad


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Episode manifests (JSON arrays), keyed by their corpus folder."""
    m = spark.read.option("multiLine", True).schema(schema.MANIFEST).json(
        path, pathGlobFilter="manifest.json", recursiveFileLookup=True)
    return m.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("dataset"), "*")


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """Reject files under either of their two names; none at all is fine."""
    r = spark.read.option("multiLine", True).schema(schema.REJECTED).json(
        path, pathGlobFilter="{rejected,rejected_expand}.json", recursiveFileLookup=True)
    return r.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("dataset"), "*")


def attach(manifests: DataFrame, steps: DataFrame) -> DataFrame:
    """Steps of the listed episodes only."""
    return steps.join(manifests.select("dataset", "episode_id"), ["dataset", "episode_id"], "left_semi")


def export_rows(steps: DataFrame, keys: Sequence[str], t: str, cols: Sequence[str]) -> DataFrame:
    """One row per run with its steps as JSON text, in step order.

    A run is the exported record itself, so its steps meet in one row.
    """
    return steps.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("n_steps"),
        F.to_json(F.array_sort(F.collect_list(F.struct(t, *cols)))).alias("steps_json"))


def write_export(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
