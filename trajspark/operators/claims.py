"""Claims of an answer against what the tools returned: attributes in their scope, prices, work done."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.operators.verify import derivable_within, marked


# ------------------------------------------------------- attributes of a scope
def _any(words: Sequence[str]) -> str:
    """A pattern for any of ``words``, the longest first: common beginnings are tried once, not once a word."""
    rest: dict[str, list[str]] = {}
    for w in words:
        if w:
            rest.setdefault(w[0], []).append(w[1:])
    body = "|".join(re.escape(c) + _any(tails) for c, tails in rest.items())
    return (f"(?:{body}){'?' if '' in words else ''}" if "" in words or len(rest) > 1 else body) if body else ""


def stated_attributes(text: Column, places: Sequence[str], values: Sequence[str]) -> Column:
    """Array of (place, value) that a text binds one to one, lower case.

    Three forms: "value in place", "place - value" or "place: value", and "place
    is / was / will be / are (expected to be) value".  Lists ("rainy in A, B and C")
    bind their first place only.  Null gives null, no claim an empty array.
    """
    at, of = (_any([w.lower() for w in words]) for words in (places, values))
    low = F.lower(text)
    forms = (  # pattern, group of the place, group of the value, what every match of it has: a text without is not searched
        (rf"\b({of})\s+in\s+({at})\b", 2, 1, low.rlike(r"\sin\s")),
        (rf"\b({at})\s*[-:]\s*({of})\b", 1, 2, low.contains(":") | low.contains("-")),
        (rf"\b({at})\s+(?:is|was|it's|its|will be|are)\s+(?:expected to be\s+|expecting\s+)?({of})\b", 1, 2,
         low.contains("is") | low.contains("was") | low.contains("it") | low.contains("will") | low.contains("are")))

    kind = "array<struct<place:string,value:string>>"

    def found(p: str, place: int, value: int, may: Column) -> Column:
        both = F.arrays_zip(*[F.regexp_extract_all(low, F.lit(p), F.lit(group)) for group in (place, value)]).cast(kind)
        return F.when(may, both).when(low.isNotNull(), F.array().cast(kind))
    return F.concat(*[found(*form) for form in forms])


def last_fact(facts: DataFrame, keys: Sequence[str], scope: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``keys, scope, fact``: the value each scope had last, in ``order`` (of equals the larger); nulls tell nothing."""
    ranked = F.struct(*order, value)
    return facts.filter(F.col(value).isNotNull()).groupBy(*keys, *scope).agg(F.max(ranked)[value].alias("fact"))


def contradictions(claims: DataFrame, facts: DataFrame, keys: Sequence[str], scope: Sequence[str]) -> DataFrame:
    """``keys, scope, said, fact``: claims that another value is known for.

    ``claims`` (keys, scope, value), ``facts`` (keys, scope, fact; one per scope).
    The scope is all that makes two statements about the same thing, as place and
    time: a fact of another day contradicts nothing.  A scope with two different
    claims is ambiguous and dropped; a scope without a fact is no contradiction.
    Null scopes equal nothing.
    """
    one = claims.filter(F.col("value").isNotNull()).groupBy(*keys, *scope).agg(
        F.min("value").alias("said"), F.max("value").alias("_other")).filter(F.col("said") == F.col("_other")).drop("_other")
    return one.join(facts, [*keys, *scope]).filter(F.col("said") != F.col("fact"))


def missing_work(required: DataFrame, done: DataFrame, keys: Sequence[str], scope: Sequence[str]) -> DataFrame:
    """Required (keys, scope) that were never looked up."""
    return required.select(*keys, *scope).distinct().join(done.select(*keys, *scope), [*keys, *scope], "left_anti")


def contradicted_within(claims: Column, facts: Column, scope: Sequence[str], order: Sequence[str]) -> Column:
    """``contradictions`` and ``last_fact`` of a key whose claims and facts are two arrays of its row: is there one?"""
    def same(a: Column, b: Column) -> Column:
        on = a[scope[0]] == b[scope[0]]
        for c in scope[1:]:
            on = on & (a[c] == b[c])
        return F.coalesce(on, F.lit(False))

    def wrong(c: Column) -> Column:
        known = F.transform(F.filter(facts, lambda f: same(f, c) & f["value"].isNotNull()), lambda f: F.struct(
            *[f[o].alias(o) for o in order], f["value"].alias("value")))
        alone = F.forall(claims, lambda d: ~same(d, c) | F.coalesce(d["value"] == c["value"], F.lit(True)))
        return F.coalesce(F.array_max(known)["value"] != c["value"], F.lit(False)) & alone
    return F.exists(claims, wrong)


# -------------------------------------------------------------------- figures
def priced_marks(figures: DataFrame, facts: DataFrame, keys: Sequence[str],
                 taxes: Sequence[float] = (0.0, 0.08, 0.085, 0.10)) -> DataFrame:
    """``keys, fig, is_verbatim, is_derivable`` of every asserted figure (cents).

    ``facts`` (keys, value in cents, times, computed): a price counts ``times`` over
    in a total (two nights of a hotel), and the answer may name it once or times
    over; ``computed`` results of a calculator may be named as they are or with
    tax, and are no part of a sum.  Derivable are a counted price, the sum of two
    of them and the sum of all, each with one of the taxes.
    """
    value = F.col("value").cast("long")
    computed = F.coalesce("computed", F.lit(False))
    amounts = facts.filter(F.col("value").isNotNull()).select(
        *keys, F.when(~computed, (F.col("value") * F.coalesce("times", F.lit(1))).cast("long")).alias("item"),
        F.when(~computed & (F.coalesce("times", F.lit(1)) != 1), value).alias("name"), F.when(computed, value).alias("calc"))
    return marked(figures, amounts, keys, taxes)


def expectations(episodes: DataFrame, contradicted: DataFrame, missing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, expected, contradicted, work_missing`` for ``verify.objective_label``, the flags from the rows found."""
    keys = list(keys)
    flag = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    j = episodes.join(flag(contradicted, "contradicted"), keys, "left").join(flag(missing, "work_missing"), keys, "left")
    return j.select(*keys, "expected", F.coalesce("contradicted", F.lit(False)).alias("contradicted"),
                    F.coalesce("work_missing", F.lit(False)).alias("work_missing"))


def labels_within(rows: DataFrame, keys: Sequence[str], scope: Sequence[str], order: Sequence[str],
                  taxes: Sequence[float] = (0.0, 0.08, 0.085, 0.10), tol: float = 50.0) -> DataFrame:
    """``verify.objective_label`` of keys that are one row each, with everything about them in its arrays.

    ``figures`` [(ord, value)], the last one the total; ``facts`` [(scope, order, value, price,
    times, computed)]; ``claims`` [(scope, value)]; ``required``, ``done`` [place]; ``expected``.
    Nothing is dealt again, so a key's rows are shuffled once, when they are put into its row.
    """
    bare = lambda c: F.coalesce(c["computed"], F.lit(False))
    priced = F.filter("facts", lambda f: f["price"].isNotNull())
    item = lambda f: (f["price"] * F.coalesce(f["times"], F.lit(1))).cast("long")
    r = rows.select(*keys, "expected", "figures", F.array_max("figures").alias("_fin"),
                    F.transform(F.filter(priced, lambda f: ~bare(f)), item).alias("_items"),
                    F.transform(F.filter(priced, bare), lambda f: f["price"].cast("long")).alias("_calcs"),
                    F.transform(priced, lambda f: f["price"].cast("long")).alias("_prices"),
                    contradicted_within(F.col("claims"), F.col("facts"), scope, order).alias("_contradicted"),
                    F.exists("required", lambda p: ~F.array_contains("done", p)).alias("_missing"))
    r = r.withColumn("_right", F.abs(F.col("_fin.value") - F.col("expected")) <= tol)
    # only figures whose mark decides something are looked for: those named before the total, and a total that is not right
    r = r.withColumn("_asked", F.filter("figures", lambda f: ~F.array_contains("_prices", f["value"]) & ~F.array_contains("_items", f["value"]) & (
        (f["ord"] < F.col("_fin.ord")) | ~F.coalesce("_right", F.lit(False)))))
    r = r.withColumn("_unknown", F.when(F.size("_asked") > 0, F.filter("_asked", lambda f: ~derivable_within(f["value"], "_items", "_calcs", taxes))).otherwise(F.col("_asked")))
    last = F.exists("_unknown", lambda f: f["ord"] == F.col("_fin.ord"))
    loose = F.exists("_unknown", lambda f: f["ord"] < F.col("_fin.ord"))
    return r.select(*keys, F.when(loose | F.col("_contradicted"), "hallucinated").when(F.col("_fin.value").isNull(), "other")
                    .when(F.col("_right") & F.coalesce("_missing", F.lit(False)), "incomplete").when(F.col("_right"), "healthy")
                    .when(last, "hallucinated").otherwise("arithmetic_error").alias("label"))
