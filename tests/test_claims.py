from itertools import combinations

from pyspark.sql import functions as F

from trajspark.operators import claims, verify

PLACES, VALUES = ["Lisbon", "Prague", "Bergen", "New York"], ["sunny", "rainy", "windy", "mild"]


def test_stated_forms(spark):
    texts = {
        "Rainy in Bergen and Lisbon, sunny in Prague.": [("bergen", "rainy"), ("prague", "sunny")],
        "Lisbon: windy; Prague - mild": [("lisbon", "windy"), ("prague", "mild")],
        "New York will be expected to be sunny, Bergen is rainy": [("new york", "sunny"), ("bergen", "rainy")],
        "Bergen's harbour is mild": [], "": [], "Lisbon was it's rainy": [], "unrainy in Lisbon": []}
    df = spark.createDataFrame([(k,) for k in texts], "text string")
    got = {r.text: sorted(tuple(x) for x in r.c) for r in df.select("text", claims.stated_attributes(F.col("text"), PLACES, VALUES).alias("c")).collect()}
    assert got == {k: sorted(v) for k, v in texts.items()}
    null = spark.createDataFrame([(None,)], "text string").select(claims.stated_attributes(F.col("text"), PLACES, VALUES).alias("c"))
    assert null.first().c is None


def test_contradictions_need_the_same_scope(spark):
    facts = spark.createDataFrame([(1, "lisbon", "mon", 0, "rainy"), (1, "lisbon", "mon", 1, "sunny"), (1, "lisbon", "tue", 0, "mild"),
                                   (1, "prague", None, 0, "mild"), (1, "bergen", "mon", 0, None), (2, "lisbon", "mon", 0, "rainy")],
                                  "o int, place string, day string, t int, value string")
    said = spark.createDataFrame([(1, "lisbon", "mon", "sunny"), (1, "lisbon", "tue", "sunny"), (1, "lisbon", "tue", "sunny"), (1, "prague", None, "rainy"),
                                  (1, "bergen", "mon", "rainy"), (2, "lisbon", "mon", "mild"), (2, "lisbon", "mon", "windy")],
                                 "o int, place string, day string, value string")
    last = claims.last_fact(facts, ["o"], ["place", "day"], ["t"], "value")
    got = claims.contradictions(said, last, ["o"], ["place", "day"]).collect()
    assert [(r.o, r.place, r.day, r.said, r.fact) for r in got] == [(1, "lisbon", "tue", "sunny", "mild")]
    need = spark.createDataFrame([(1, "lisbon"), (1, "tunis"), (1, "tunis"), (2, "prague")], "o int, place string")
    assert sorted((r.o, r.place) for r in claims.missing_work(need, last, ["o"], ["place"]).collect()) == [(1, "tunis"), (2, "prague")]


def test_priced_marks_by_brute_force(spark):
    taxes = (0.0, 0.08, 0.085, 0.10)
    facts = [(o, 1000 + 37 * i * (o + 1), 1 + (i + o) % 2, i == 4) for o in range(6) for i in range(5)] + [(6, None, 1, False), (7, 500, None, None)]
    rows, want = [], {}
    for o in range(8):
        mine = [f for f in facts if f[0] == o and f[1] is not None]
        part = [v * (k or 1) for _, v, k, c in mine if not c]
        verbatim = {v for _, v, _, _ in mine} | set(part)
        total = set(part) | {a + b for a, b in combinations(part, 2)} | ({sum(part)} if part else set()) | {v for _, v, _, c in mine if c}
        taxed = {int(v * (1 + r) + 0.5) for v in total for r in taxes}
        for fig in sorted(verbatim | taxed | {v + 1 for v in taxed} | {4321}):
            rows.append((o, fig))
            want[o, fig] = (fig in verbatim, fig in taxed)
    out = claims.priced_marks(spark.createDataFrame(rows, "o int, value long"),
                              spark.createDataFrame(facts, "o int, value long, times int, computed boolean"), ["o"], taxes)
    got = {(r.o, r.fig): (r.is_verbatim, r.is_derivable) for r in out.collect()}
    assert got == want


def test_labels_from_rows(spark):
    episodes = spark.createDataFrame([(i, 1000) for i in range(6)], "o int, expected int")
    bad = spark.createDataFrame([(1, "x"), (1, "y")], "o int, place string")
    miss = spark.createDataFrame([(2, "x"), (3, "x")], "o int, place string")
    e = claims.expectations(episodes, bad, miss, ["o"])
    assert e.count() == 6
    facts = spark.createDataFrame([(o, v, 1, False) for o in range(6) for v in (400, 600)], "o int, value long, times int, computed boolean")
    figs = spark.createDataFrame([(0, 0, 400), (0, 1, 1000), (1, 0, 1000), (2, 0, 1000), (3, 0, 600), (4, 0, 7777), (4, 1, 1000)], "o int, ord int, value long")
    out = verify.objective_label(figs, e, claims.priced_marks(figs, facts, ["o"]), ["o"])
    assert {r.o: r.label for r in out.collect()} == {0: "healthy", 1: "hallucinated", 2: "incomplete", 3: "arithmetic_error",
                                                     4: "hallucinated", 5: "other"}


def test_crowded_keys_give_the_same_marks(spark):
    """Key by key as arrays, row by row, and mixed: the same marks, also for null figures and null keys."""
    facts = spark.createDataFrame([(o, 100 + 7 * (i % 9) + (o or 0), 1 + i % 3, i % 5 == 4) for o in (0, 1, None) for i in range(4 + 8 * (o or 0))],
                                  "o int, value long, times int, computed boolean")
    figs = spark.createDataFrame([(o, v) for o in (0, 1, 2, None) for v in [*range(100, 600), None]], "o int, value long")
    amounts = facts.select("o", F.when(~F.col("computed"), F.col("value") * F.col("times")).alias("item"),
                           F.when(~F.col("computed"), F.col("value")).alias("name"), F.when(F.col("computed"), F.col("value")).alias("calc"))
    few = figs.filter("value IS NULL OR value % 40 = o")
    got = [sorted(map(str, verify.marked(few, amounts, ["o"], (0.0, 0.1), n).collect())) for n in (0, 13, 10_000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == few.distinct().count()
    plan = verify.marked(few, amounts, ["o"], (0.0, 0.1), 10_000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1  # no row of a figure meets a row of an item


def test_places_that_begin_alike(spark):
    """Every name that another one begins with is found whole, and common beginnings stand once in the pattern."""
    places = [f"nation_{i}" for i in range(25)] + ["new", "new york", "a.b"]
    texts = [f"{p.upper()}: mild. rainy in {p}, {p} is expected to be windy" for p in places] + ["nation_99: mild", "axb: mild"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [sorted(tuple(x) for x in r.c) for r in df.select(claims.stated_attributes(F.col("text"), places, VALUES).alias("c")).collect()]
    assert got == [[(p, "mild"), (p, "rainy"), (p, "windy")] for p in places] + [[], []]
    assert claims._any(places).count("_") == 1


def _orders(spark, path):
    """Orders of 1 to 9 lines and one of 90, over nine days and four nations, some prices and suppliers unknown."""
    lines = [(o, (o * 7 + i * 5) % 50, (o + i * 3) % 12, i % 7 + 1, (((o * 1000 + i * 137) * 7919) % 90000 + 100) / 100 if (o + i) % 23 else None,
              "RAN"[(o * i + i) % 3], f"1995-03-{(o + i // 2) % 9 + 1:02d}") for o in range(400) for i in range(90 if o == 77 else o % 9 + 1)]
    lines += [(None, 1, 1, 1, 5.0, "R", "1995-03-01"), (3, 1, None, 9, 5.0, "R", "1995-03-01"), (5, 1, 99, 9, 5.0, "R", None), (6, 2, 1, 9, 5.0, None, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, d string").selectExpr(
        "* EXCEPT (d)", "CAST(d AS timestamp) AS l_shipdate").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(s, s % 4) for s in range(12)], "s_suppkey long, s_nationkey long").write.parquet(f"{path}/supplier.parquet")
    spark.createDataFrame([(i, f"NATION_{i}") for i in range(4)], "n_nationkey long, n_name string").write.parquet(f"{path}/nation.parquet")
    # the second place is 11 on, so one in 4 customers needs places that exist only in part
    spark.createDataFrame([(o, (o * 4) % 100 if o % 3 else o) for o in range(400)] + [(4, 14 * 4), (None, 4)], "o_orderkey long, o_custkey long").write.parquet(f"{path}/orders.parquet")


def test_labels_equal_their_sql_with_crowded_orders(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry
    _orders(spark, tmp_path)
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.sql(entry.oracle_sql()["objective_label_claims"]).fetchall())
    got = sorted((r.o, r.label) for r in entry.queries()["objective_label_claims"](spark, str(tmp_path)).collect())
    assert got == want and len({x for _, x in want}) >= 3


def test_labels_together_equal_those_by_rows_and_lines_are_shuffled_once(spark, tmp_path):
    import re

    from trajspark.plans import claim_queries as q
    _orders(spark, tmp_path)
    lines, need = q.looked(spark, str(tmp_path)).filter("o IS NOT NULL"), q.required(spark, str(tmp_path))
    a, b = q.labels_together(lines, need), q.labels_by_rows(lines, need)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    dealt = set(re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", a._jdf.queryExecution().executedPlan().toString()))
    assert [re.sub(r"#\d+L?", "", x) for x in dealt] == ["o", "o"]  # lines, and places needed


def test_amounts_before_tax_by_rounding(spark):
    taxes = (0.0, 0.08, 0.085, 0.10)
    figs = [*range(-400, 400), *range(12_345_600, 12_345_700), 10 ** 13 + 7]
    rounded = F.array(*[F.round(F.col("s") * F.lit(1.0 + r)).cast("long") for r in taxes])
    around = F.flatten(F.array(*[F.sequence(F.round(F.col("f") / F.lit(1.0 + r)).cast("long") - 3, F.round(F.col("f") / F.lit(1.0 + r)).cast("long") + 3) for r in taxes]))
    df = spark.createDataFrame([(f,) for f in figs], "f long")
    want = df.select("f", F.explode(F.array_distinct(around)).alias("s")).filter(F.array_contains(rounded, F.col("f")))
    got = df.select("f", F.explode(verify._before_tax(F.col("f"), taxes)).alias("s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
