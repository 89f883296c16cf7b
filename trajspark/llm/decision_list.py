"""Quality rules as a learned decision list (operator 3), in DataFrame expressions only.

Sequential covering over labelled documents: a rule grows by the threshold with
the best information gain until it covers no good document, is pruned on rows it
was not grown on, and takes what it covers out of the table; rules are learned
until the next one is not precise enough.  All the learner sees are counts per
(statistic, bin, label), one small Spark aggregate per step.  The result is an
ordered list, written out as one ``CASE WHEN``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from trajspark.llm.common import written

#: White space between words, and the characters counted as symbols.
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Counts of a text, and the statistics that rules compare.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = ("words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share",
              "capital_share", "marks_per_word", "distinct_share")
_P = "__quality_"


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``__quality_stats`` of the counts and statistics of each whole text.

    A null text has no words and counts 0.  Work and memory per document are
    linear in its words, but for one sort of its word windows if any repeats.
    """
    c = lambda name: F.col(_P + name)
    size = lambda x: F.size(x).cast("long")
    share = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    windows = F.sequence(F.lit(0), F.size(c("words")) - 3)
    word = lambda i, k: F.get(c("words"), i + k)
    df = docs.withColumn(_P + "t", F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    df = df.withColumns({
        _P + "words": F.filter(F.split(c("t"), r"[ \x09-\x0D]+"), lambda w: w != ""),
        _P + "lines": F.filter(F.split(c("t"), "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0)})
    df = df.withColumn(_P + "marks", F.when(F.size(c("words")) >= 3, F.transform(
        windows, lambda i: F.xxhash64(word(i, 0), word(i, 1), word(i, 2)))).otherwise(F.array().cast("array<bigint>")))
    # only texts in which a window's hash repeats are looked at closely, by the words themselves
    df = df.withColumn(_P + "sorted", F.when(F.size(F.array_distinct(c("marks"))) < F.size(c("marks")), F.sort_array(
        F.transform(windows, lambda i: F.struct(
            F.concat_ws(" ", word(i, 0), word(i, 1), word(i, 2)).alias("g"), i.alias("i"))))))
    same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
    df = df.withColumn(_P + "hits", F.sort_array(F.filter(F.transform(c("sorted"), lambda x, k: F.when(
        same(x, F.get(c("sorted"), k - 1)) | same(x, F.get(c("sorted"), k + 1)), x["i"])), lambda i: i.isNotNull())))
    repeated = F.when(c("hits").isNull(), F.lit(0)).otherwise(F.aggregate(
        c("hits"), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"]))
    chars = F.length(c("t")).cast("long")
    without = lambda letters: F.length(F.translate(c("t"), letters, "")).cast("long")
    df = df.withColumn(_P + "counts", F.struct(
        size(c("words")).alias("n_words"), F.length(F.array_join(c("words"), "")).cast("long").alias("word_chars"),
        (chars - without(SYMBOLS)).alias("n_symbols"),
        (size(c("lines")) - size(F.array_distinct(c("lines")))).alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"), (chars - without(CAPITALS)).alias("capitals"),
        (chars - F.length(F.replace(c("t"), F.lit("!"), F.lit("")))).alias("marks"),
        size(c("lines")).alias("lines"), size(F.array_distinct(c("words"))).alias("distinct"), chars.alias("chars")))
    n = lambda k: c("counts")[k]
    df = df.withColumn(_P + "stats", F.struct(
        *(n(k).alias(k) for k in COUNTS), n("n_words").cast("double").alias("words"),
        share(n("word_chars"), n("n_words")).alias("chars_per_word"),
        share(n("n_symbols"), n("n_words")).alias("symbols_per_word"),
        share(n("n_dup_lines"), n("lines")).alias("dup_line_share"),
        share(n("n_repeat_words"), n("n_words")).alias("repeat_share"),
        share(n("capitals"), n("chars")).alias("capital_share"), share(n("marks"), n("n_words")).alias("marks_per_word"),
        share(n("distinct"), n("n_words")).alias("distinct_share")))
    return df.drop(*(_P + k for k in ("t", "words", "lines", "marks", "sorted", "hits", "counts")))


def base_failed(stats: Column) -> Column:
    """Too short, or more than half of the words in repeated 3-word windows."""
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


#: Places in each class beside the even quantiles: rare kinds of junk lie beyond those.
TAILS = (0.0, 0.001, 0.005, 0.01, 0.99, 0.995, 0.999, 1.0)


@dataclass(frozen=True)
class Rule:
    """All of (statistic, above?, threshold) hold: reject.  ``bad`` and ``good``: pruning rows it covered."""
    terms: tuple[tuple[str, bool, float], ...]
    bad: int
    good: int

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for name, above, cut in self.terms:
            out = out & ((stats[name] > cut) if above else (stats[name] <= cut))
        return out


def verdict(rules: list[Rule], stats: Column) -> Column:
    """Number of the first rule that rejects the document, else null."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(stats), F.lit(k)).otherwise(out)
    return out


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", fit_rows: int = 20_000, cuts: int = 16, max_rules: int = 12, max_terms: int = 4,
          min_precision: float = 0.9, min_covered: int = 5) -> list[Rule]:
    """Decision list that rejects documents labelled 0.

    Fits on at most ``fit_rows`` labelled documents, those with the smallest hash
    of their id; labels that are null or have no id or no document are left out.
    Without labelled documents of both kinds there are no rules.  Where the rule
    that gains most is not precise, the best of all rules of one term takes its place.
    """
    picked = (labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("int").alias("__y"))
              .where(F.col("__id").isNotNull() & F.col("__y").isNotNull())
              .orderBy(F.xxhash64("__id"), "__id", "__y").limit(fit_rows))
    labelled = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")).join(
        F.broadcast(picked), "__id")
    s = F.col(_P + "stats")
    rows = written(measured(labelled, "__text").select(
        (F.col("__y") == 0).alias("bad"), (F.pmod(F.xxhash64("__id", F.lit("part")), F.lit(3)) == 0).alias("held"),
        base_failed(s).alias("short"), *(s[k].alias(k) for k in STATISTICS)).repartition(4), "labelled").where(~F.col("short"))
    marks = rows.groupBy("bad").agg(*(F.percentile_approx(k, sorted({*((i + 0.5) / cuts for i in range(cuts)), *TAILS}), fit_rows).alias(k)
                                      for k in STATISTICS)).collect()
    if len(marks) < 2:
        return []
    seen = {k: sorted({x for m in marks for x in m[k]}) for k in STATISTICS}
    at = {k: [(a + b) / 2 for a, b in zip(v, v[1:])] for k, v in seen.items()}  # between neighbours: room on both sides
    room = [[b - a for a, b in zip(seen[k], seen[k][1:])] for k in STATISTICS]
    bins = F.array(*(sum((F.when(F.col(k) > x, 1).otherwise(0) for x in at[k]), F.lit(0)) for k in STATISTICS))
    rows = written(rows.select("bad", "held", bins.alias("bins")), "labelled-bins")

    def holds(terms):
        out = F.lit(True)
        for k, above, i in terms:
            b = F.get("bins", F.lit(k))
            out = out & ((b > i) if above else (b <= i))
        return out

    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        terms: list[tuple[int, bool, int]] = []
        while len(terms) < max_terms:
            best = _best_term(rows.where(~F.col("held") & left & holds(terms)), room)
            if best is None:
                break
            terms.append(best[0])
            if not best[1]:
                break
        bad = good = 0
        if terms:
            # prune: the shortest beginning that is worth most on the rows held back
            counts = rows.where(F.col("held") & left).agg(*(
                F.count(F.when(holds(terms[:k]) & (F.col("bad") == b), 1)).alias(f"{'bad' if b else 'good'}{k}")
                for k in range(1, len(terms) + 1) for b in (True, False))).first()
            worth = [((p - n) / (p + n) if p + n else -1.0, -k) for k in range(1, len(terms) + 1)
                     for p, n in [(counts[f"bad{k}"], counts[f"good{k}"])]]
            k = -max(worth)[1]
            bad, good, terms = counts[f"bad{k}"], counts[f"good{k}"], terms[:k]
        if bad < min_covered or bad < min_precision * (bad + good):
            single = _precise_term(rows.where(left), room, min_precision, min_covered)
            if single is None:
                break
            terms, bad, good = [single[0]], *single[1:]
        rules.append(Rule(tuple((STATISTICS[f], above, float(at[STATISTICS[f]][i])) for f, above, i in terms), bad, good))
        left = left & ~holds(terms)
    return rules


def _best_term(rows: DataFrame, room: list[list[float]]) -> tuple[tuple[int, bool, int], int] | None:
    """Threshold with the most information gain, and how many good rows it leaves.

    Cuts between the same two rows gain the same: the one with most room around it is taken."""
    table: dict[int, dict[int, list[int]]] = {}
    for k, b, bad, n in (rows.select("bad", F.posexplode("bins").alias("k", "b")).groupBy("k", "b", "bad")
                         .agg(F.count(F.lit(1)).alias("n")).select("k", "b", "bad", "n").collect()):
        table.setdefault(k, {}).setdefault(b, [0, 0])[bad] += n
    if not table:
        return None
    good, bad = (sum(v[j] for v in table[0].values()) for j in (0, 1))
    if not bad or not good:
        return None
    before, best = math.log2(bad / (bad + good)), (1e-9, None, 0)
    for k in sorted(table):
        upto, order = [0, 0], sorted(table[k])
        for b, after in zip(order, order[1:]):
            cut = max(range(b, after), key=room[k].__getitem__)
            upto = [upto[j] + table[k][b][j] for j in (0, 1)]
            for above, (n, p) in ((True, (good - upto[0], bad - upto[1])), (False, tuple(upto))):
                gain = p * (math.log2(p / (p + n)) - before) if p else 0.0
                if gain > best[0]:
                    best = (gain, (k, above, cut), n)
    return None if best[1] is None else best[1:]


def _precise_term(rows: DataFrame, room: list[list[float]], min_precision: float, min_covered: int) -> tuple[tuple[int, bool, int], int, int] | None:
    """Of all thresholds that are precise on the rows held back and on the others, the one that covers most
    bad rows; and the bad and good rows held back that it covers."""
    table: dict[int, dict[int, list[int]]] = {}
    for k, b, j, n in (rows.select((F.col("held").cast("int") * 2 + F.col("bad").cast("int")).alias("j"), F.posexplode("bins").alias("k", "b"))
                       .groupBy("k", "b", "j").agg(F.count(F.lit(1)).alias("n")).select("k", "b", "j", "n").collect()):
        table.setdefault(k, {}).setdefault(b, [0] * 4)[j] += n
    best = (0, 0, None)
    for k in sorted(table):
        every, upto, order = [sum(v[j] for v in table[k].values()) for j in range(4)], [0] * 4, sorted(table[k])
        for b, after in zip(order, order[1:]):
            cut = max(range(b, after), key=room[k].__getitem__)
            upto = [upto[j] + table[k][b][j] for j in range(4)]
            for above, n in ((True, [every[j] - upto[j] for j in range(4)]), (False, upto)):
                if n[3] >= min_covered and all(n[j + 1] >= min_precision * (n[j] + n[j + 1]) for j in (0, 2)):
                    best = max(best, (n[1] + n[3], -n[0] - n[2], ((k, above, cut), n[3], n[2])), key=lambda x: x[:2])
    return best[2]


def judged(docs: DataFrame, rules: list[Rule], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``rule`` (first rule that rejects) and ``kept``, one row per row
    of ``docs``.  A null text counts as none; a null id stays null; an empty table gives no rows."""
    s = F.col(_P + "stats")
    df = measured(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("__text")), "__text")
    return df.select("doc_id", *(s[k].alias(k) for k in COUNTS), base_failed(s).alias("base_failed"),
                     F.when(~base_failed(s), verdict(rules, s)).alias("rule"),
                     (~base_failed(s) & verdict(rules, s).isNull()).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule], *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that neither the base rules nor the list reject, all columns."""
    s = F.col(_P + "stats")
    # the row number keeps the filter above the measuring: pushed below, it would measure over and over
    df = measured(docs, text_col).withColumn(_P + "row", F.monotonically_increasing_id())
    return df.where(~base_failed(s) & verdict(rules, s).isNull() & (F.col(_P + "row") >= 0)).select(
        *(F.col(f"`{c}`") for c in docs.columns))
