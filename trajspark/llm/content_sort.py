"""Exact deduplication by content sort (operator 9).

Sampled splitters range-partition the normalised texts, an external sort puts
equal texts side by side, and each row is compared in full with its neighbour.
The splitters read the first characters, a hash and the id, so samples stay small
however long texts are, and copies of one text spread over as many partitions as
their number asks for.  A run of equal texts that reaches the first or last text
of its partition may go on next door: those runs, two or so per partition, are
compared in full once more and their sizes added up.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from trajspark.llm.common import shuffle_partitions, slices, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a text that a splitter shows.
HEAD = 32


class _Run:
    __slots__ = ("number", "keep", "size", "digest", "text", "mark")

    def __init__(self, number, keep, digest, text, mark):
        self.number, self.keep, self.size, self.digest, self.text, self.mark = number, keep, 0, digest, text, mark


def _sorted(docs: DataFrame, id_col: str, text_col: str, keep: str, carry: bool, partitions: int | None) -> DataFrame:
    """id, text, hash and, if asked for, the whole row, range-partitioned and sorted by content."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    norm = F.translate(F.col("t"), UPPER, LOWER)
    rank = F.desc_nulls_last("i") if keep == "max" else F.asc_nulls_last("i")
    cols = [F.col(f"`{id_col}`").cast("long").alias("i"), text.alias("t")]
    if carry:
        cols.append(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    # splitters and their samples need no whole normalised text: equal texts have equal heads and equal hashes
    key = (F.translate(F.substring("t", 1, HEAD), UPPER, LOWER), F.col("h"))
    out = docs.select(*cols).withColumn("h", F.xxhash64(F.lower("t")))
    n = partitions or shuffle_partitions(docs.sparkSession)
    return out.repartitionByRange(n, *key, rank).sortWithinPartitions(*key, norm, rank)


def _compared(docs: DataFrame, id_col: str, text_col: str, keep: str, carry: bool, partitions: int | None) -> DataFrame:
    """Rows (first of each run only, if rows are carried) with run, its best id, size, digest
    and, on the first row of a run that may go on next door, its text."""
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    ordered = _sorted(docs, id_col, text_col, keep, carry, partitions)

    def run(batches):
        part = TaskContext.get().partitionId()
        runs: dict[int, _Run] = {}
        pending: list[tuple[pa.RecordBatch, list[int], list[bool], int]] = []
        current, first_mark, number = None, None, -1

        def out(batch, of, tops, edge_marks):
            r = [runs[k] for k in of]
            edge = [x.mark in edge_marks for x in r]
            cols = {
                "i": batch.column("i"), "part": pa.array([part] * len(r), pa.int64()), "run": pa.array(of, pa.int64()),
                "keep": pa.array([x.keep for x in r], pa.int64()), "size": pa.array([x.size for x in r], pa.int64()),
                "top": pa.array(tops, pa.bool_()), "digest": pa.array([x.digest for x in r], pa.binary()),
                "edge": pa.array([x.text if e and t else None for x, e, t in zip(r, edge, tops)], pa.binary())}
            if carry:
                cols["row"] = batch.column("row")
            return pa.RecordBatch.from_pydict(cols)

        for piece in slices(batches):
            texts, ids, marks = (piece.column(c).to_pylist() for c in ("t", "i", "h"))
            of, tops = [], []
            for text, own, mark in zip(texts, ids, marks):
                raw = text.encode().lower()  # bytes: A-Z only
                if current is None or raw != current.text:
                    number += 1
                    current = runs[number] = _Run(number, own, hashlib.sha256(raw).digest(), raw, mark)
                    first_mark = mark if first_mark is None else first_mark
                    tops.append(True)
                else:
                    tops.append(False)
                current.size += 1
                of.append(number)
            if carry:
                piece = piece.filter(pa.array(tops))
                of, tops = [k for k, t in zip(of, tops) if t], [True] * piece.num_rows
            if of:
                held = ("i", "row") if carry else ("i",)
                pending.append((piece.select(list(held)), of, tops, runs[of[-1]].mark))
            while pending and pending[0][3] != current.mark:
                batch, of, tops, _ = pending.pop(0)
                yield out(batch, of, tops, {first_mark})
                for k in range(min(runs), of[-1]):
                    del runs[k]
        for batch, of, tops, _ in pending:
            yield out(batch, of, tops, {first_mark, current.mark})

    schema = StructType.fromDDL(
        "i long, part long, run long, keep long, size long, top boolean, digest binary, edge binary")
    if carry:
        schema.add("row", ordered.schema["row"].dataType)
    return written(ordered.mapInArrow(run, schema), "content-sort")


def _grouped(rows: DataFrame, keep: str) -> DataFrame:
    """Runs that go on over partition borders become one group.  One row per such run: a few per partition."""
    w = W.partitionBy("edge")
    best = F.max if keep == "max" else F.min
    return (rows.where(F.col("edge").isNotNull())
            .select("part", "run", best("keep").over(w).alias("g_keep"), F.sum("size").over(w).alias("g_size"),
                    F.min(F.struct("part", "run")).over(w).alias("g_top")))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                partitions: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if identical after lower-casing A-Z; null counts as empty.  Of
    equal texts the row with the smallest id stays (``keep="max"``: the largest);
    rows without an id stay only if no copy has one; of rows that share text and
    id one stays.  An empty table gives no rows; other columns are not read.
    """
    rows = _compared(docs, id_col, text_col, keep, False, partitions)
    r = rows.join(F.broadcast(_grouped(rows, keep)), ["part", "run"], "left")
    return r.select(
        F.col("i").alias("doc_id"), F.coalesce("g_keep", "keep").alias("keep_id"),
        F.coalesce("g_size", "size").alias("group_size"),
        (F.col("top") & (F.col("g_top").isNull() | (F.col("g_top") == F.struct("part", "run")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                partitions: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (rules of ``exact_dedup``)."""
    rows = _compared(docs, id_col, text_col, keep, True, partitions)
    r = rows.join(F.broadcast(_grouped(rows.drop("row"), keep)), ["part", "run"], "left")
    r = r.where(F.col("g_top").isNull() | (F.col("g_top") == F.struct("part", "run")))
    return r.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
