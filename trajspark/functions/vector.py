"""Vector helpers on ``array<double>`` columns (higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0),
                       lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, when_zero: float = 1.0) -> Column:
    """Cosine; ``when_zero`` when either side has no length."""
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)) \
        .otherwise(F.lit(when_zero))


def diff(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def dims(a: Column, n: int) -> dict[str, Column]:
    """The first n elements as columns d0..d(n-1)."""
    return {f"d{i}": a[i] for i in range(n)}


def zeroed(a: Column, which: list[int]) -> Column:
    """The vector with chosen positions set to 0."""
    return F.transform(a, lambda v, i: F.when(i.isin(which), F.lit(0.0)).otherwise(v))


def pinned(a: Column, pins: Column, which: list[int]) -> Column:
    """The vector with chosen positions replaced by those of ``pins``."""
    return F.transform(a, lambda v, i: F.when(
        i.isin(which), F.element_at(pins, i + 1)).otherwise(v))


def run_starts(ordered: str) -> Column:
    """Places (from 0) where a value of the sorted array column begins."""
    a = F.col(ordered)
    return F.filter(F.transform(a, lambda _, i: i), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))


def runs(ordered: str, starts: str) -> Column:
    """``[(value, n), ...]`` of the sorted array column, by its ``run_starts``: counts inside the row, no shuffle."""
    a, at = F.col(ordered), F.col(starts)
    return F.transform(at, lambda i, j: F.struct(F.get(a, i).alias("value"), (F.coalesce(F.get(at, j + 1), F.size(a)) - i).cast("long").alias("n")))
