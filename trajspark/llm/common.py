"""What the operators of this folder share: input tables, files, streamed batches."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from trajspark.sources.sinks import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` with, where SQL can say it, its SQL twin."""

    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one (``spark.checkpoint.dir``)."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends, lost executors do no harm."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short slices, so that few Python objects live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Rows:
    """Collects result rows and gives them out as batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 4096, size: int = 8 << 20):
        self.schema, self.rows, self.size = schema, rows, size
        self.columns, self.held = [[] for _ in schema], 0

    def add(self, *values, weight: int = 0) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)
        self.held += weight

    def ready(self) -> bool:
        return len(self.columns[0]) >= self.rows or self.held >= self.size

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(self.columns, self.schema)], schema=self.schema)
        self.columns, self.held = [[] for _ in self.schema], 0
        return out

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield self.take()


@functools.cache
def _system(scheme_host: str):
    return fs.FileSystem.from_uri(scheme_host)[0]


def storage(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given by URI or absolute path."""
    uri = folder if ":/" in folder else f"file://{folder}"
    system, path = fs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


def commit_file(system: fs.FileSystem, path: str, attempt: int, fill: Callable) -> None:
    """Write under an attempt's own name, then move: readers never see half a file,
    and a repeated task puts the same bytes in the same place."""
    own = f"{path}.attempt-{attempt}-{uuid.uuid4().hex[:8]}"
    with system.open_output_stream(own, compression=None) as out:
        fill(out)
    system.move(own, path)
