"""Report tables of studies: judge rates and spend, sign tests over corpora, populations, totals that must balance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions import stats


def _n(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("int"))


def rates_by(rows: DataFrame, by: Sequence[str], verdict: str) -> DataFrame:
    """``by, n, answered, hits, rate, low, high``: share of true verdicts with its Wilson interval.

    Rows without a verdict are counted in ``n`` only; no answered row gives a null rate.
    """
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(verdict).alias("answered"), _n(F.col(verdict)).alias("hits"))
    k, n = F.col("hits"), F.nullif(F.col("answered"), F.lit(0))
    low, high = stats.wilson(k, n)
    return g.withColumns({"rate": F.try_divide(k, n), "low": low, "high": high})


def spend(priced: DataFrame, by: Sequence[str], tokens_in: str = "in_tok", tokens_out: str = "out_tok") -> DataFrame:
    """Calls, tokens and cost of what ``pricing.price_calls`` returned; refused calls are counted beside, at no cost."""
    ok = F.col("refused").isNull()
    return priced.groupBy(*by).agg(
        _n(ok).alias("calls"), _n(~ok).alias("refused"), F.coalesce(F.sum(F.when(ok, F.col(tokens_in))), F.lit(0)).alias("in_tok"),
        F.coalesce(F.sum(F.when(ok, F.col(tokens_out))), F.lit(0)).alias("out_tok"), F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"))


def sign_test(rows: DataFrame, by: Sequence[str], gap: str) -> DataFrame:
    """Do the gaps of several corpora point one way?  Exact two-sided test, gaps of zero left out."""
    g = rows.groupBy(*by).agg(F.count(gap).alias("n"), _n(F.col(gap) > 0).alias("up"), _n(F.col(gap) < 0).alias("down"), F.avg(gap).alias("mean_gap"))
    return g.withColumn("p_value", stats.mcnemar_p("up", "down"))


def gains(rows: DataFrame, by: Sequence[str], content: Column, before: str, after: str, stream: str) -> DataFrame:
    """Rates before and after a second monitor on content and other failures, what its stream sees and what was left to catch."""
    c, b = F.when(content, True), F.when(~content, True)
    mean = lambda on, col: F.avg(F.when(on, F.col(col).cast("double")))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(c).alias("n_content"), F.count(b).alias("n_other"),
        (mean(c, after) - mean(c, before)).alias("content_gain"), (mean(b, after) - mean(b, before)).alias("other_gain"),
        mean(c, stream).alias("stream"), (1.0 - mean(c, before)).alias("headroom"))


def correlation(x: str, y: str) -> Column:
    """Aggregate: Pearson correlation over rows that have both; null where either is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    sd = lambda c: F.stddev_pop(F.when(both, F.col(c)))
    return F.try_divide(F.covar_pop(x, y), sd(x) * sd(y))


def populations(rows: DataFrame, shared: Column) -> DataFrame:
    """Each row once as ``own``, once as ``shared`` or ``outside`` (column ``arm``)."""
    return rows.withColumn("arm", F.explode(F.array(F.lit("own"), F.when(shared, "shared").otherwise("outside"))))


def totals(corpora: DataFrame, scopes: Mapping[str, Column], counts: Sequence[str]) -> DataFrame:
    """``scope, corpora, counts``: sums over the corpora of each (overlapping) scope; empty scopes are 0."""
    each = [F.struct(F.lit(name).alias("scope"), F.coalesce(on, F.lit(False)).alias("_on")) for name, on in scopes.items()]
    e = corpora.select(*counts, F.inline(F.array(*each)))
    return e.groupBy("scope").agg(_n(F.col("_on")).alias("corpora"), *[
        F.coalesce(F.sum(F.when(F.col("_on"), F.col(c))), F.lit(0)).alias(c) for c in counts])


def identities(sums: DataFrame, rules: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``identity, lhs, rhs, holds``; a rule gives both sides as sums of ``scope.count`` joined by ``+``.

    ``sums`` is what ``totals`` returns: one row per scope that the caller named.
    """
    counts = [c for c in sums.columns if c != "scope"]
    names = sorted({term for sides in rules.values() for side in sides for term in side.replace(" ", "").split("+")})
    pick = {n: n.split(".") for n in names}
    wide = sums.select("scope", *counts).agg(*[
        F.max(F.when(F.col("scope") == s, F.col(c))).alias(f"_{i}") for i, (s, c) in enumerate(pick.values())])
    col = {n: F.col(f"_{i}") for i, n in enumerate(pick)}

    def side(text: str) -> Column:
        out = F.lit(0)
        for term in text.replace(" ", "").split("+"):
            out = out + col[term]
        return out.cast("long")

    return wide.select(F.inline(F.array(*[F.struct(F.lit(name).alias("identity"), side(a).alias("lhs"), side(b).alias("rhs"))
                                          for name, (a, b) in rules.items()]))).withColumn("holds", F.col("lhs").eqNullSafe(F.col("rhs")))
