"""Adjacent-token statistics and negative PMI of texts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from trajspark.functions import vector
from trajspark.operators import joins
from trajspark.sources import sinks

#: a ratio below this counts as this
FLOOR = 1e-10


def _words(text: str):
    return F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")


def _pairs(ws: str):
    """(w1, w2) of neighbours, built inside the row: no window, no shuffle."""
    a = F.slice(F.col(ws), 1, F.greatest(F.size(ws) - 1, F.lit(0)))
    b = F.slice(F.col(ws), 2, F.greatest(F.size(ws) - 1, F.lit(0)))
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("w1"), y.alias("w2")))


def corpus_counts(docs: DataFrame, text: str, group: str) -> DataFrame:
    d = docs.select(group, _words(text).alias("ws"))
    n = d.groupBy(group).agg(F.sum(F.size("ws")).alias("n_words"),
                             F.sum(F.greatest(F.size("ws") - 1, F.lit(0))).alias("n_pairs"))
    v = d.select(group, F.explode("ws").alias("w")).groupBy(group).agg(F.countDistinct("w").alias("vocabulary"))
    return n.join(v, group)


def fit(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(unigram counts, bigram counts, one row of totals)."""
    d = docs.select(_words(text).alias("ws"))
    uni = d.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    bi = d.select(F.explode(_pairs("ws")).alias("p")).groupBy("p.w1", "p.w2").agg(F.count(F.lit(1)).alias("cb"))
    tot = uni.agg(F.sum("c").alias("tu"), F.count(F.lit(1)).alias("v")).crossJoin(
        bi.agg(F.sum("cb").alias("tb")))
    return uni, bi, tot


def score(fit_docs: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Average negative PMI of neighbouring tokens, add-one smoothing.

    Pairs are counted inside the text's row first, without a shuffle, so a repeated
    pair is joined once; the unigram counts are joined to the distinct pairs, not to the texts.
    Texts that are their own corpus need neither join (``own_score``).
    """
    if fit_docs is docs:
        return own_score(docs, key, text)
    d = docs.select(key, _words(text).alias("ws"))
    mine = d.select(key, F.array_sort(_pairs("ws")).alias("ps")).withColumn("at", vector.run_starts("ps")).select(
        key, F.inline(vector.runs("ps", "at"))).select(key, "value.w1", "value.w2", F.col("n").alias("k"))
    uni, bi, tot = fit(fit_docs, text)
    kinds = mine.select("w1", "w2").distinct().join(bi, ["w1", "w2"], "left")
    p = kinds.join(uni.select(F.col("w").alias("w1"), F.col("c").alias("c1")), "w1", "left") \
        .join(uni.select(F.col("w").alias("w2"), F.col("c").alias("c2")), "w2", "left") \
        .crossJoin(F.broadcast(tot))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) + F.lit(1.0)
    v, tu = F.col("v").cast("double"), F.col("tu").cast("double")
    ratio = (n("cb") / (F.col("tb") + v * v)) / ((n("c1") / (tu + v)) * (n("c2") / (tu + v)))
    p = p.select("w1", "w2", (-F.log(F.greatest(ratio, F.lit(FLOOR)))).alias("npmi"))
    s = mine.join(p, ["w1", "w2"]).groupBy(key).agg(
        (F.sum(F.col("k") * F.col("npmi")) / F.sum("k")).alias("neg_pmi"), F.sum("k").alias("n_pairs"))
    return docs.select(key).join(s, key, "left").select(
        key, F.coalesce("neg_pmi", F.lit(0.0)).alias("neg_pmi"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))


def _digest(*words: Column) -> list[Column]:
    """80 bits for words: among 1e9 different ones, two are alike with a chance of 4e-7."""
    return [F.xxhash64(*words).alias("h"), F.shiftright(F.hash(*words[::-1]), 16).cast("short").alias("m")]


def _word_weights(d: DataFrame, key: str) -> DataFrame:
    """``key, w, n, weight``: a text's words, how often each stands there and in how many places of pairs."""
    size = F.size("ws")
    runs = d.select(key, F.get("ws", F.lit(0)).alias("_f"), F.get("ws", size - 1).alias("_l"), F.sort_array("ws").alias("_s")).withColumn(
        "_at", vector.run_starts("_s")).select(key, "_f", "_l", F.inline(vector.runs("_s", "_at")))
    w = F.col("value")
    return runs.select(key, w.alias("w"), "n", (F.col("n") * 2 - (w == F.col("_f")).cast("long") - (w == F.col("_l")).cast("long")).alias("weight"))


def _pair_weights(d: DataFrame, key: str, uni: DataFrame, least: float | None, most: float) -> DataFrame:
    """``key, h, m, n, weight, g``: a text's pairs; ``g`` is the product of the words' counts + 1 where it reaches ``least``."""
    a, b = F.col("p.w1"), F.col("p.w2")
    found = F.transform(_pairs("ws"), lambda p: F.struct(*_digest(p["w1"], p["w2"]), *([] if least is None else [p["w1"], p["w2"]])))
    p = d.select(key, F.sort_array(found).alias("_s")).withColumn("_at", vector.run_starts("_s")).select(
        key, F.inline(vector.runs("_s", "_at"))).withColumnRenamed("value", "p")
    g = F.lit(None).cast("double")
    if least is not None:
        often = joins.small(uni.filter(F.col("c") + 1 >= least / most).select("w", (F.col("c") + F.lit(1.0)).alias("c")))
        for name, w in (("c1", a), ("c2", b)):
            p = p.join(often.select(F.col("w").alias(f"w_{name}"), F.col("c").alias(name)), w == F.col(f"w_{name}"), "left")
        g = F.when(F.col("c1") * F.col("c2") >= least, F.col("c1") * F.col("c2"))
    return p.select(key, "p.h", "p.m", "n", (-F.col("n")).alias("weight"), g.alias("g"))


def own_score(docs: DataFrame, key: str, text: str, floor: float = FLOOR, known: int = joins.BROADCAST_ROWS) -> DataFrame:
    """``score`` of texts against all of them.

    The logarithm of a pair's ratio is a sum over the pair and its two words, so pairs never
    meet the word table.  The counts of up to ``known`` most frequent words are broadcast; pairs and
    other words go, as digests, through one shuffle that counts them, and only what occurs more than
    once sends a text more than its own row had.  A ratio can fall below ``floor`` only if the words
    are so frequent that a single pair of them is too rare; such pairs carry the product of their counts.
    """
    d = docs.select(key, _words(text).alias("ws"))
    size = F.coalesce(F.size("ws"), F.lit(0)).cast("long")
    texts = sinks.materialize(d.select(key, F.greatest(size, F.lit(0)).alias("n_words"), F.greatest(size - 1, F.lit(0)).alias("n_pairs")), "pair_counts")
    uni = sinks.materialize(d.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c")), "word_counts")
    tu, tb = texts.agg(F.sum("n_words"), F.sum("n_pairs")).first()
    if not tb:
        return texts.select(key, F.lit(0.0).alias("neg_pmi"), F.lit(0).cast("long").alias("n_pairs"))
    levels = [x for j in range(1, 62) for x in (2 ** j, 3 * 2 ** (j - 1))]
    v, most, *above = uni.agg(F.count(F.lit(1)), F.max("c") + 1, *[F.count(F.when(F.col("c") >= x, 1)) for x in levels]).first()
    top = F.broadcast(uni.filter(F.col("c") >= next(x for x, n in zip(levels, above) if n <= known)))
    v = float(v)
    even = (tu + v) ** 2 / (tb + v * v)  # times (pair's count + 1) / (product of its words' counts + 1): the ratio
    least = 2 * even / floor

    words = _word_weights(d, key)
    rare = words.join(top, "w", "left_anti").select(key, *_digest(F.col("w")), "n", "weight", F.lit(None).cast("double").alias("g"))
    items = _pair_weights(d, key, uni, least * (1 - 1e-9) if most * most >= least else None, float(most)).unionByName(rare)
    items = items.withColumn("c", F.sum("n").over(W.partitionBy("h", "m")))
    ratio = (F.col("c") + 1) * F.lit(even) / F.col("g")
    low = F.when(ratio < floor, F.col("n") * F.log(ratio / F.lit(floor)))
    back = items.filter((F.col("c") > 1) | F.col("g").isNotNull()).select(
        key, (F.col("weight") * F.log((F.col("c") + 1) / F.lit(2.0)) + F.coalesce(low, F.lit(0.0))).alias("s"), F.lit(0).cast("long").alias("weight"))
    here = words.join(top, "w", "left").select(key, (F.col("weight") * F.log(F.coalesce("c", F.lit(1)) + F.lit(1.0))).alias("s"), "weight")
    s = here.unionByName(back).groupBy(key).agg(F.sum("s").alias("s"), (F.sum("weight") / 2).alias("n"))
    mean = F.col("s") / F.col("n") - F.lit(math.log(2.0) + math.log(even))
    return texts.select(key).join(s.filter("n > 0"), key, "left").select(
        key, F.coalesce(mean, F.lit(0.0)).alias("neg_pmi"), F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n_pairs"))
