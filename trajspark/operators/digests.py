"""Digests of sets of rows: mergeable without order, and as a tree over blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX = 15                     # hex digits per part: 60 bits fit a long
PARTS = 4                    # 240 of SHA-256's 256 bits


def row_text(*cols: Column) -> Column:
    """One text per row that no other values give: each as length, colon, value; null as ``-``."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(*[one(c.cast("string")) for c in cols])


def multiset_parts(*cols: Column) -> list[Column]:
    """Aggregates of the order-free digest: row count and four sums of hash parts.

    They add up over partitions, files and days, so digests of increments merge by
    adding them; repeated rows count as often as they occur.
    """
    h = F.sha2(row_text(*cols), 256)
    part = lambda i: F.conv(F.substring(h, 1 + HEX * i, HEX), 16, 10).cast("decimal(20,0)")
    return [F.count(F.lit(1)).alias("n_rows"),
            *[F.coalesce(F.sum(part(i)), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(PARTS)]]


def merged(parts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Parts of increments added up."""
    return parts.groupBy(*group).agg(F.sum("n_rows").alias("n_rows"), *[
        F.sum(f"s{i}").cast("decimal(38,0)").alias(f"s{i}") for i in range(PARTS)])


def sealed(parts: DataFrame, group: Sequence[str]) -> DataFrame:
    """``group, n_rows, digest`` of parts that are complete."""
    return parts.select(*group, "n_rows", F.sha2(F.concat_ws(",", *[
        F.col(c).cast("string") for c in ("n_rows", *[f"s{i}" for i in range(PARTS)])]), 256).alias("digest"))


def multiset_digest(df: DataFrame, group: Sequence[str], *cols: Column) -> DataFrame:
    """Digest of the rows of each group, the same in any order and partitioning.

    Sums of hashes hold against changes that happen by themselves, not against an
    author who looks for collisions; ``tree_digest`` does.
    """
    parts = df.groupBy(*group).agg(*multiset_parts(*cols))
    return sealed(parts, group)


def tree_blocks(df: DataFrame, group: Sequence[str], key: Column, value: Column, depth: int) -> DataFrame:
    """``group, block, n_rows, digest``: rows dealt to 16^depth blocks by the hash of their key, sorted inside.

    A block holds about rows / 16^depth, whatever the keys look like; only rows that
    share a key as well as all others of it stay together.
    """
    k = F.sha2(row_text(key), 256)
    rows = df.select(*group, F.substring(k, 1, depth).alias("block"), F.sha2(row_text(key, value), 256).alias("_leaf"))
    # repeated rows become one leaf with a count, so a block's list is bounded by its distinct rows
    leaves = rows.groupBy(*group, "block", "_leaf").agg(F.count(F.lit(1)).alias("_n"))
    return leaves.groupBy(*group, "block").agg(F.sum("_n").alias("n_rows"), F.sha2(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_leaf", "_n"))), lambda s: F.concat(s["_leaf"], F.lit("*"), s["_n"].cast("string"))),
        ";"), 256).alias("digest"))


def tree_root(blocks: DataFrame, group: Sequence[str], depth: int) -> DataFrame:
    """``group, n_rows, digest``: blocks joined sixteen by sixteen, by their name's last digit, up to the root."""
    level = blocks
    for _ in range(depth):
        level = level.withColumn("_d", F.substring("block", -1, 1)).withColumn("block", F.expr("left(block, length(block) - 1)")) \
            .groupBy(*group, "block").agg(F.sum("n_rows").alias("n_rows"), F.sha2(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("_d", "digest"))), lambda s: F.concat(s["_d"], F.lit("="), s["digest"])), ";"), 256)
                .alias("digest"))
    return level.select(*group, "n_rows", "digest")


def tree_digest(df: DataFrame, group: Sequence[str], key: Column, value: Column, depth: int = 2) -> DataFrame:
    """Digest of a map (key -> value) or, with a constant value, of a list of ids.

    ``depth`` is part of the digest's definition: choose it so that rows / 16^depth
    stays at some thousands.  Equal under any order and partitioning; two maps that
    differ are narrowed down by comparing ``tree_blocks``.
    """
    return tree_root(tree_blocks(df, group, key, value, depth), group, depth)


def changed_blocks(a: DataFrame, b: DataFrame, group: Sequence[str]) -> DataFrame:
    """Blocks whose digests differ, or that only one side has (null there)."""
    keys = [*group, "block"]
    j = a.select(*keys, F.col("digest").alias("digest_a")).join(b.select(*keys, F.col("digest").alias("digest_b")), keys, "full_outer")
    return j.filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
