from pyspark.sql import functions as F

from trajspark.operators import digests

ROWS = [(i % 3, None if i % 11 == 0 else f"k{i % 40}", None if i % 7 == 0 else f"v{i % 5}") for i in range(300)]
SCHEMA = "g int, k string, v string"


def test_multiset_is_free_of_order_and_merges(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    key = lambda d: {r.g: (r.n_rows, r.digest) for r in digests.multiset_digest(d, ["g"], F.col("k"), F.col("v")).collect()}
    one = key(df)
    assert key(spark.createDataFrame(ROWS[::-1], SCHEMA).repartition(7)) == one
    parts = df.withColumn("day", F.hash("k", "v") % 4).groupBy("g", "day").agg(*digests.multiset_parts(F.col("k"), F.col("v")))
    assert {r.g: (r.n_rows, r.digest) for r in digests.sealed(digests.merged(parts, ["g"]), ["g"]).collect()} == one
    assert key(spark.createDataFrame(ROWS + [ROWS[0]], SCHEMA))[0] != one[0]       # a repeated row counts
    assert key(spark.createDataFrame(ROWS[1:], SCHEMA))[1] == one[1]
    moved = [(g, "k" if k == "k1" else k, "1v1" if v == "v1" else v) for g, k, v in ROWS]
    assert key(spark.createDataFrame(moved, SCHEMA)) != one
    empty = digests.multiset_digest(df.limit(0), [], F.col("k")).collect()
    assert len(empty) == 1 and empty[0].n_rows == 0


def test_row_text_is_unambiguous(spark):
    df = spark.createDataFrame([("a", "b"), ("a1:b", ""), (None, "a"), ("-", "a"), ("", None)], "a string, b string")
    assert df.select(digests.row_text(F.col("a"), F.col("b")).alias("t")).distinct().count() == 5


def test_tree_finds_the_changed_blocks(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for depth in (1, 2, 3):
        root = lambda d: {r.g: (r.n_rows, r.digest) for r in digests.tree_digest(d, ["g"], F.col("k"), F.col("v"), depth).collect()}
        one = root(df)
        assert {g: n for g, (n, _) in one.items()} == {0: 100, 1: 100, 2: 100}
        assert root(spark.createDataFrame(ROWS[::-1], SCHEMA).repartition(5)) == one
        edited = [(g, k, "new" if (g, k) == (1, "k7") else v) for g, k, v in ROWS]
        other = root(spark.createDataFrame(edited, SCHEMA))
        assert [g for g in one if other[g] != one[g]] == [1]
        blocks = lambda d: digests.tree_blocks(d, ["g"], F.col("k"), F.col("v"), depth)
        diff = digests.changed_blocks(blocks(df), blocks(spark.createDataFrame(edited, SCHEMA)), ["g"]).collect()
        assert len(diff) == 1 and diff[0].g == 1
