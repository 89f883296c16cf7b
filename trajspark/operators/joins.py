"""Broadcast only what is proven small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.sources import sinks

#: largest side that may be broadcast, in rows
BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Has ``df`` at most ``rows`` rows?  Reads at most ``rows + 1`` of them."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``rows`` rows.

    Beyond that the frame is returned unmarked and the join shuffles (with
    AQE skew splitting).
    """
    return F.broadcast(df) if is_small(df, rows) else df


def one_row(df: DataFrame) -> DataFrame:
    """An ungrouped aggregate always has exactly one row: safe to broadcast."""
    return F.broadcast(df)


#: rows of one key that may travel together in one array
TOGETHER = 64


def crowded(frames: Sequence[DataFrame], keys: Sequence[str], rows: int = TOGETHER) -> DataFrame | None:
    """The keys with more than ``rows`` rows in one of ``frames``; None if there is no such key.

    Counts combine before their shuffle, so a hot key costs one row per task.
    """
    n = [f"_n{i}" for i in range(len(frames))]
    marked = None
    for i, df in enumerate(frames):
        m = df.select(*keys, *[F.lit(int(i == j)).alias(c) for j, c in enumerate(n)])
        marked = m if marked is None else marked.unionByName(m)
    most = F.greatest(*[F.sum(c) for c in n], F.lit(0))
    hot = sinks.materialize(marked.groupBy(*keys).agg(most.alias("_most")).filter(F.col("_most") > rows).select(*keys), "crowded_keys")
    return None if hot.isEmpty() else hot


def parted(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the other keys, rows of the keys in ``hot``); a null key is a key like others."""
    h = small(hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys]))
    on = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
    return df.join(h, on, "left_anti"), df.join(h, on, "left_semi")
