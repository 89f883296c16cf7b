"""Writing results: shared intermediate tables, score streams, result tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DONE: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach (``spark.checkpoint.dir``).

    Unset, a plain ``local[...]`` session, as in tests, gets a folder of its own,
    removed when the session's process ends; a cluster is refused, as its
    executors would each write to their own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str, scope: str = "") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, keeps column pruning and pushdown for the readers, and
    survives lost executors.  The same (session, scope, name) is written once.
    """
    spark = df.sparkSession
    key = (spark.sparkContext.applicationId, scope, name)
    if scope and key in _DONE:
        return spark.read.parquet(_DONE[key])
    path = f"{shared_dir(spark).rstrip('/')}/traj-{uuid.uuid4().hex}/{name}"
    df.write.mode("error").parquet(path)
    if scope:
        _DONE[key] = path
    return spark.read.schema(df.schema).parquet(path)


def known(spark: SparkSession, name: str, scope: str) -> DataFrame | None:
    """The table ``materialize`` wrote under this name in this session."""
    path = _DONE.get((spark.sparkContext.applicationId, scope, name))
    return spark.read.parquet(path) if path else None


def write_scores(scores: DataFrame, path: str) -> None:
    """Score streams, one folder per (dataset, monitor)."""
    scores.write.mode("overwrite").partitionBy("dataset", "monitor").parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A result table as CSV (with header) or Parquet."""
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))
