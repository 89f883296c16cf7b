"""Merkle manifest of a data set with a witness for every row (operator 11).

Each row is a leaf: the SHA-256 of its columns, each written as ``-`` if null, else
as its UTF-8 length, a colon and the value.  The rows of a group ascend by id and
form a tree of runs of eight; the groups' roots form another one above them.

Rows get their position from one range sort and running counts per partition.
Aligned blocks of 4,096 positions are then appended one after the other: a task
keeps the open runs of one block, and when a sibling closes a run, the partial
witnesses of everything below it grow by the run's other members.  The roots of
blocks are appended in the same way, block by block, until a group has one node,
and so are the roots of groups; a leaf's witness is its own part followed by those
of the blocks above it.  So a task holds one block, however large a group is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StructType

from trajspark.llm.common import shuffle_partitions, slices, written

ARITY = 8


def joined_hash(digests: Sequence[bytes]) -> bytes:
    """SHA-256 of the digests' hexadecimal text, one after the other."""
    return hashlib.sha256("".join([d.hex() for d in digests]).encode()).digest()


def depth(n: int) -> int:
    """Levels between ``n`` nodes and their one root."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Appender:
    """Open runs of one block, by level; ``witness`` holds what each leaf knows so far.

    A witness is, level by level, the number of siblings before and after the node
    (a byte each) and the siblings' digests.
    """

    def __init__(self, levels: int):
        self.levels, self.root = levels, b""
        self.runs: list[list[tuple[bytes, int, int]]] = [[] for _ in range(levels)]
        self.witness: list[bytes] = []

    def append(self, digest: bytes) -> None:
        self.witness.append(b"")
        self._add(0, digest, len(self.witness) - 1, len(self.witness))

    def _add(self, level: int, digest: bytes, first: int, last: int) -> None:
        if level == self.levels:
            self.root = digest
            return
        self.runs[level].append((digest, first, last))
        if len(self.runs[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        digests = [d for d, _, _ in run]
        for k, (_, first, last) in enumerate(run):
            more = bytes((k, len(run) - 1 - k)) + b"".join(digests[:k] + digests[k + 1:])
            for leaf in range(first, last):
                self.witness[leaf] += more
        self._add(level + 1, joined_hash(digests), run[0][1], run[-1][2])

    def close(self) -> bytes:
        """Complete what is still open, from the leaves up."""
        for level in range(self.levels):
            if self.runs[level]:
                self._complete(level)
        return self.root


def folded(digest: bytes, witness: bytes) -> tuple[bytes, bytes]:
    """Root reached from ``digest`` through its witness, and the SHA-256 of all siblings."""
    at, proof = 0, hashlib.sha256()
    while at < len(witness):
        middle = at + 2 + 32 * witness[at]
        end = middle + 32 * witness[at + 1]
        before, after = witness[at + 2:middle].hex(), witness[middle:end].hex()
        proof.update((before + after).encode())
        digest = hashlib.sha256((before + digest.hex() + after).encode()).digest()
        at = end
    return digest, proof.digest()


def leaf_hash(columns: Sequence[Column]) -> Column:
    """Digest of a row: each column ``-`` if null, else length, colon, value."""
    text = [c.cast("string") for c in columns]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _numbered(rows: DataFrame, order: Sequence[str], partitions: int) -> DataFrame:
    """``rows`` with ``pos`` and ``total`` inside their group ``g``, in the order of the columns given."""
    schema = StructType(list(rows.schema.fields)).add("part", LongType()).add("local", LongType())

    def number(batches):
        part, held, before = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g")
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)
            new[0] = g[0].as_py() != held
            at = np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(new, at, -1))
            local = at - np.where(start < 0, -before, start)
            held, before = g[-1].as_py(), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(at), part, np.int64)), pa.array(local.astype(np.int64))],
                names=[*batch.schema.names, "part", "local"])

    placed = written(rows.repartitionByRange(partitions, "g", *order).sortWithinPartitions("g", *order)
                     .mapInArrow(number, schema), "merkle-order")
    counts = placed.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"))  # one row per partition a group touches
    counts = counts.select("g", "part", (F.sum("n").over(W.partitionBy("g").orderBy("part")) - F.col("n")).alias("before"),
                           F.sum("n").over(W.partitionBy("g")).alias("total"))
    return placed.join(counts, ["g", "part"]).withColumn("pos", F.col("before") + F.col("local")).drop("part", "local", "before")


def _appended(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` (``g, pos, total, node``, others) with ``block``, its ``top`` and the ``witness`` up to there."""
    size = ARITY ** levels
    nodes = nodes.withColumn("block", F.expr(f"pos DIV {size}"))
    schema = StructType(list(nodes.schema.fields)).add("witness", "binary").add("top", "binary")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def close():
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            total = batch.column("total")[0].as_py()
            tree = Appender(levels if total > size else depth(total))
            for digest in batch.column("node").to_pylist():
                tree.append(digest)
            top = tree.close()
            return pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tree.witness, pa.binary()), pa.array([top] * batch.num_rows, pa.binary())],
                names=[*batch.schema.names, "witness", "top"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g, block = batch.column("g"), batch.column("block")
            new = pc.or_(pc.not_equal(g[1:], g[:-1]), pc.not_equal(block[1:], block[:-1]))
            cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
            if held and (held[-1].column("g")[0], held[-1].column("block")[0]) != (g[0], block[0]):
                yield close()
                held.clear()
            for lo, hi in zip(cuts, cuts[1:]):
                if lo:
                    yield close()
                    held.clear()
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield close()

    placed = nodes.repartition(shuffle_partitions(nodes.sparkSession), "g", "block").sortWithinPartitions("g", "block", "pos")
    return written(placed.mapInArrow(run, schema), "merkle-blocks")


def _climbed(blocks: DataFrame, levels: int) -> DataFrame:
    """``g, pos, upper, root`` of the roots of ``blocks``: further appends until each group has one node."""
    size = ARITY ** levels
    tops = blocks.where(f"pos % {size} = 0").select(
        "g", F.col("block").alias("pos"), F.expr(f"(total + {size - 1}) DIV {size}").alias("total"), F.col("top").alias("node"))
    done = tops.where("total = 1").select("g", "pos", F.lit(b"").alias("upper"), F.col("node").alias("root"))
    more = tops.where("total > 1")
    if more.isEmpty():
        return done
    blocks = _appended(more, levels)
    above = _climbed(blocks, levels).withColumnRenamed("pos", "block")
    return done.unionByName(blocks.join(above, ["g", "block"]).select(
        "g", "pos", F.concat("witness", "upper").alias("upper"), "root"))


def manifest(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "lang",
             fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
             also: dict[str, Column] | None = None, levels: int = 4, partitions: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, leaf, subroot, root, witness`` (binary) and the columns of ``also``.

    ``leaf`` hashes ``fields``; ``subroot`` is the root of the row's group, ``root``
    that of all groups, which are ordered with null first, then bytewise.  A task
    holds one block of 8 ** ``levels`` nodes.

    A null in any field is written ``-``, so it differs from an empty value; rows
    without an id come first in their group, rows with equal ids are ordered by their
    leaf, and equal rows are leaves of their own.  An empty table gives no rows.
    Columns outside ``fields`` don't count, whatever their names.  Texts of any
    length are hashed whole, in the JVM.
    """
    also = also or {}
    columns = [F.col(f"`{c}`") for c in fields]
    rows = written(docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col(f"`{group_col}`").cast("string")), F.lit("")).alias("g"),
        F.col(f"`{id_col}`").cast("long").alias("id"), leaf_hash(columns).alias("node"),
        *(c.alias(f"also_{k}") for k, c in enumerate(also.values()))), "merkle-leaves")
    n = partitions or shuffle_partitions(docs.sparkSession)
    leaves = _appended(_numbered(rows, ("id", "node"), n), levels)
    blocks = written(_climbed(leaves, levels).withColumnRenamed("root", "subroot"), "merkle-upper")
    groups = _numbered(blocks.where("pos = 0").select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("subroot").alias("node")),
                       ("name",), n)
    tops = _appended(groups, levels)
    above = _climbed(tops, levels).select(F.col("pos").alias("block"), F.col("upper").alias("last"), "root")
    over = tops.join(above, "block").select(F.col("name").alias("g"), F.concat("witness", "last").alias("last"), "root")
    upper = written(blocks.join(over, "g").select(
        "g", F.col("pos").alias("block"), F.concat("upper", "last").alias("upper"), "subroot", "root"), "merkle-upper")
    return leaves.join(upper, ["g", "block"]).select(
        F.col("id").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", F.concat("witness", "upper").alias("witness"),
        *(F.col(f"also_{k}").alias(name) for k, name in enumerate(also)))


def verified(entries: DataFrame, leaf_col: str = "leaf") -> DataFrame:
    """``entries`` of a manifest with ``folded_root``, ``proof_sha256`` (binary) and ``verified``:
    the leaf in ``leaf_col`` (a null one: ``leaf``) folded with the original siblings."""
    schema = StructType(list(entries.schema.fields)).add("folded_root", "binary").add("proof_sha256", "binary")

    def run(batches):
        for batch in slices(batches, 2048):
            own, first, witness = (batch.column(c).to_pylist() for c in (leaf_col, "leaf", "witness"))
            out = [folded(o or f, w) for o, f, w in zip(own, first, witness)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r for r, _ in out], pa.binary()), pa.array([p for _, p in out], pa.binary())],
                names=[*batch.schema.names, "folded_root", "proof_sha256"])

    return entries.mapInArrow(run, schema).withColumn("verified", F.col("folded_root") == F.col("root"))
