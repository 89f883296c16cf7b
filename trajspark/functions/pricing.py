"""Token cost of a call from a user-supplied rate table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def price_calls(calls: DataFrame, rates: DataFrame, model: str = "model", tokens_in: str = "in_tok",
                tokens_out: str = "out_tok", cached: str = "cached_tok",
                long_prompt: int = 200_000) -> DataFrame:
    """Add ``usd`` and ``refused``.

    ``rates`` (USD per million): model, in_rate, cached_rate, out_rate and the
    nullable long-prompt rates in_hi, cached_hi, out_hi.  ``long_prompt``
    is the prompt size above which they apply.
    """
    j = calls.join(rates, model, "left")
    i, o, c = F.col(tokens_in), F.col(tokens_out), F.col(cached)
    bad = F.when(F.col("in_rate").isNull(), "unknown model") \
        .when((i < 0) | (o < 0) | (c < 0), "negative tokens").when(c > i, "cached exceeds input")
    long = (i > long_prompt) & F.col("in_hi").isNotNull()
    rate = lambda n: F.when(long, F.col(f"{n}_hi")).otherwise(F.col(f"{n}_rate"))
    usd = ((i - c) * rate("in") + c * rate("cached") + o * rate("out")) / 1e6
    return j.withColumn("refused", bad).withColumn("usd", F.when(bad.isNull(), usd)).drop(
        *[x for x in rates.columns if x != model])
