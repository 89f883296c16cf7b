import math
import random

import numpy as np
import pytest

from trajspark.llm import cover_tree
from trajspark.llm.vector_queries import op13

COLUMNS = "vec_id long, embedding array<float>, label int, q int, v string"


def brute(rows, every=100, k=5, n=10):
    fine = {}
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        fine.setdefault((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in e)), []).append(1)
    cand = [key for key, times in fine.items() for _ in times]
    out = []
    for a in fine:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], c[2])), c[0], c[1]) for c in cand if len(c[2]) == len(a[2]) and c[0] != a[0])
        for s, p, label in [x for x in scored if x[2] == a[1]][:k]:
            fit = [x for x in scored if x[2] != a[1] and -30 * s <= -100 * x[0] <= -90 * s][:n]
            out += [(a[0], p, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


def vectors(n, seed, dim=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    rows = []
    for k in range(n):
        c, spread, size = rng.choice(centres), rng.choice([0.0, 0.02, 0.5]), rng.choice([0.3, 1.0, 1.0, 2.5])
        rows.append((k, [size * (x + rng.gauss(0, spread)) for x in c], rng.randrange(4)))
    return rows


def odd_rows():
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.5, 0.25, 0.0, -1.0, 2.0]
    return [(100, one, 1), (100, one, 1), (200, one, 2), (200, one, 3), (None, one, 1), (7001, None, 1), (7002, one, None), (300, [nan] * 6, 1),
            (7003, [inf] + one[1:], 1), (7004, [None] + one[1:], 1), (7005, one[:3], 1), (7100, one[:3], 1), (7006, one[:3], 2), (7007, [], 1),
            (7200, [], 1), (7008, [], 2), (7009, [0.0] * 6, 3), (-100, one, 3)]


@pytest.mark.parametrize("cap, partitions", [(4096, 3), (16, 5)])
def test_against_brute_force(spark, cap, partitions):
    rows = vectors(900, 3) + odd_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], COLUMNS).repartition(4)
    got = sorted(tuple(r) for r in cover_tree.hard_negatives(df, cap=cap, partitions=partitions).collect())
    assert got == brute(rows) and got


def test_every_row_is_in_one_tree(spark):
    df = cover_tree.scaled(spark.createDataFrame([(*r, 1, "x") for r in vectors(700, 4)], COLUMNS))
    trees = cover_tree.index(df, cap=100, partitions=3)
    ids = [x for r in trees.collect() for x in np.frombuffer(r.ids, "<i8")]
    assert sorted(ids) == list(range(700)) and max(r.size for r in trees.collect()) <= 100


def test_empty_tables(spark):
    for rows in ([], [(100, [1.0], 1, 1, "x")], [(100, None, 1, 1, "x")]):
        assert cover_tree.hard_negatives(spark.createDataFrame(rows, COLUMNS)).count() == 0


def test_query_changes_labels(spark, tmp_path):
    rows = vectors(300, 5)
    spark.createDataFrame([(*r, 1, "x") for r in rows], COLUMNS).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute([(i, e, (label + 1) % 10 if i % 7 == 0 else label) for i, e, label in rows])
    assert sorted(tuple(r) for r in op13(spark, str(tmp_path)).collect()) == want


def test_tree_covers_and_bounds():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(c, 3, (300, 5)) for c in rng.normal(0, 300, (6, 5))]).astype(np.int64)
    tree = cover_tree.Tree.built(np.arange(len(v)), v)
    assert len(tree.nodes) > 6 and sorted(tree.ids) == list(range(len(v)))
    q = rng.integers(-300, 300, (1, 5))
    norm = float((q * q).sum())
    scores = (q @ tree.whole.T)[0]
    for (lo, _, hi, first, last), radius in zip(tree.nodes, tree.radii):
        low, high = tree.bounds(float(scores[lo]), norm, radius)
        assert (scores[lo:hi] >= low).all() and (scores[lo:hi] <= high).all()
        assert (tree.radii[first:last] <= radius / 2 + 1e-6).all()  # each level covers within half the radius


def test_descent_skips_what_no_window_can_use():
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(c, 2, (400, 4)) for c in ([900, 0, 0, 0], [0, 900, 0, 0], [0, 0, 900, 0])]).astype(np.int64)
    tree = cover_tree.Tree.built(np.arange(1200), v)
    scored = []
    plain = tree.dots
    tree.dots = lambda places, queries: scored.append(len(places)) or plain(places, queries)
    query = cover_tree.Query(-1, 10, np.array([0]), np.array([1 << 60]), np.array([0]))
    cover_tree.descend(tree, np.array([[900, 0, 0, 0]]), [query])
    want = sorted(zip(-(v @ [900, 0, 0, 0]), range(1200)))[:10]
    assert list(zip(-query.scores[0], query.ids[0])) == want
    assert sum(scored) < 700
