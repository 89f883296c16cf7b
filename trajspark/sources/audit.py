"""Append-only audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------
EVENTS = ("run_start", "step", "tool", "score", "check", "decision", "outcome", "run_end")
DECISIONS = ("checkpoint", "rollback", "repair", "escalate", "halt", "resume")
SCHEMA_VERSION = 1

RECORD = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("seq", T.LongType()),
    T.StructField("ts", T.StringType()), T.StructField("event", T.StringType()),
    T.StructField("decision", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("schema", T.IntegerType()), T.StructField("unknown_kind", T.BooleanType())])


def finite(v: Column) -> Column:
    """NaN and infinities become null: JSON has no form for them."""
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def records(df: DataFrame, run_id: Column, seq: Column, ts: Column, event: Column, decision: Column,
            value: Column) -> DataFrame:
    """Typed records; decisions outside the vocabulary are tagged.

    Events outside it are not records: ``refused`` gives those rows.
    """
    r = df.select(run_id.cast("string").alias("run_id"), seq.cast("long").alias("seq"),
                  F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), event.alias("event"),
                  decision.alias("decision"), finite(value.cast("double")).alias("value"),
                  F.lit(SCHEMA_VERSION).alias("schema"))
    return r.filter(F.col("event").isin(*EVENTS)).withColumn(
        "unknown_kind", F.coalesce(~F.col("decision").isin(*DECISIONS), F.lit(False)))


def refused(df: DataFrame, event: Column) -> DataFrame:
    """Rows whose event is missing or outside the vocabulary, with the reason."""
    return df.withColumn("reason", F.when(event.isNull(), "no event").when(~event.isin(*EVENTS), F.concat(
        F.lit("unknown event "), event))).filter("reason IS NOT NULL")


def append(recs: DataFrame, path: str) -> None:
    """Batch append, JSON lines."""
    recs.write.mode("append").json(path)


def stream(recs: DataFrame, path: str, checkpoint: str):
    """Live append: one file set per micro-batch."""
    return recs.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records back; a line cut off by a crash is skipped."""
    full = T.StructType([*RECORD.fields, T.StructField("_corrupt_record", T.StringType())])
    d = spark.read.schema(full).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)
    return d.filter("_corrupt_record IS NULL AND run_id IS NOT NULL").drop("_corrupt_record")
