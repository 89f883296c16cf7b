import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trajspark.functions import vector
from trajspark.operators import pmi, search


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_counts_inside_a_row(spark):
    rows = [[], None, ["a"], ["b", "a", "b"], ["", "z", "", ""], [f"{i % 7}" for i in range(3000)]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a array<string>").withColumn("a", F.array_sort("a"))
    df = df.withColumn("at", vector.run_starts("a")).select("i", F.inline(vector.runs("a", "at")))
    assert exchanges(df) == 0
    got = {}
    for r in df.collect():
        got.setdefault(r.i, {})[r.value] = r.n
    assert got == {i: dict(Counter(r)) for i, r in enumerate(rows) if r}


def test_pairs_of_a_text_are_written_without_a_shuffle(spark, monkeypatch):
    seen, plain = {}, pmi.sinks.materialize
    monkeypatch.setattr(pmi.sinks, "materialize", lambda df, name, scope="": (seen.__setitem__(name, exchanges(df)), plain(df, name, scope))[1])
    docs = spark.createDataFrame([(1, "a b a b c"), (2, ""), (3, None), (4, "a b")], "i int, text string")
    got = {r.i: r.n_pairs for r in pmi.score(docs, docs, "i", "text").collect()}
    assert got == {1: 4, 2: 0, 3: 0, 4: 1} and seen["pair_counts"] == 0


def test_pairs_are_shuffled_once_and_as_digests(spark):
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "c d a b")], "i int, text string")
    plan = pmi.score(docs, docs, "i", "text")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert [re.sub(r"#\d+L?", "", x) for x in dealt if not x.startswith("i#")] == ["h, m"]


@pytest.mark.parametrize("floor", [1e-10, 0.9, 3.0])
@pytest.mark.parametrize("known", [0, 3, 200_000])
def test_texts_against_all_of_them_by_brute_force(spark, floor, known):
    """Any number of words known in the row, ratios above and below the floor, texts without pairs."""
    texts = ["a b a b c", "a a a a", "", None, "  \t ", "z", " a\tb\n c  d é ", *(" ".join("abcxyz"[(i * j * j + i) % 6] for j in range(i)) for i in range(2, 40)), "b z q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    words = [(t or "").split() for t in texts]
    uni, bi = Counter(w for ws in words for w in ws), Counter(p for ws in words for p in zip(ws, ws[1:]))
    tu, tb, v = sum(uni.values()), sum(bi.values()), len(uni)
    npmi = {(a, b): -math.log(max((n + 1) / (tb + v * v) / ((uni[a] + 1) / (tu + v) * (uni[b] + 1) / (tu + v)), floor)) for (a, b), n in bi.items()}
    low = sum(x == -math.log(floor) for x in npmi.values())
    assert low == 0 if floor < 1e-9 else 0 < low < len(npmi)
    got = {r.i: (r.neg_pmi, r.n_pairs) for r in pmi.own_score(docs, "i", "text", floor, known).collect()}
    assert len(got) == len(texts)
    for i, ws in enumerate(words):
        mine = [npmi[p] for p in zip(ws, ws[1:])]
        assert got[i] == (pytest.approx(sum(mine) / len(mine) if mine else 0.0, abs=1e-12), len(mine))


def test_texts_without_a_pair(spark):
    docs = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "i int, text string")
    assert sorted(tuple(r) for r in pmi.score(docs, docs, "i", "text").collect()) == [(i, 0.0, 0) for i in (1, 2, 3)]


@pytest.mark.parametrize("met", [3, 2_000_000])
def test_bm25_in_as_many_tasks_as_meetings_need(spark, monkeypatch, met):
    monkeypatch.setattr(search, "MET", met)
    docs = spark.createDataFrame([(i, " ".join(["x"] * (i % 4) + ["y"] * (i % 3) + ["w"] * i)) for i in range(12)], "d int, text string")
    asked = spark.createDataFrame([(1, "x y x"), (2, "y"), (3, "nothing"), (4, None)], "q int, text string")
    out = search.bm25(docs, "d", "text", asked, "q", "text", 3)
    meetings = 2 * sum(i % 3 > 0 for i in range(12)) + sum(i % 4 > 0 for i in range(12))
    assert "RepartitionByExpression [d#" in (plan := out._jdf.queryExecution().optimizedPlan().toString())
    assert re.search(r"RepartitionByExpression \[d#\d+\w*\], (\d+)", plan)[1] == str(-(-meetings // met))
    n, avg = 12, sum(i % 4 + i % 3 + i for i in range(12)) / 12
    want = []
    for q, terms in ((1, "xy"), (2, "y")):
        scored = []
        for i in range(12):
            s = 0.0
            for t in terms:
                tf, df = (i % 4, 9) if t == "x" else (i % 3, 8)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * (i % 4 + i % 3 + i) / avg)) if tf else 0.0
            if s > 0:
                scored.append((-round(s, 9), i))
        want += [(q, i, r + 1) for r, (_, i) in enumerate(sorted(scored)[:3])]
    assert sorted((r.q, r.d, r["rank"]) for r in out.collect()) == sorted(want)
