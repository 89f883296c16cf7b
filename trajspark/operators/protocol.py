"""Evaluation protocol: who is fitted on what."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions import hashing

#: Fits on rows and gives the function that scores others.
Fitter = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def cross_fit(rows: DataFrame, key: str, k: int, salt: str, make: Fitter, usable: Column) -> DataFrame:
    """Out-of-fold scores: every fold is scored by a model of the ``usable`` rows of the others.

    Folds depend on the key alone.  A one-class model takes healthy rows as
    ``usable``, so no injected row is ever fitted; a supervised one takes all labelled rows.
    """
    d = rows.withColumn("fold", hashing.fold_of(F.col(key), k, salt))
    out = None
    for i in range(k):
        scored = make(d.filter((F.col("fold") != i) & usable))(d.filter(F.col("fold") == i))
        out = scored if out is None else out.unionByName(scored)
    return out
