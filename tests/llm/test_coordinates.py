import random
import re
import string

import numpy as np
import pytest

from trajspark.llm import coordinate_join

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^ \t-\r]+")


def grams(text):
    words = WORD.findall((text or "").translate(LOWER))
    k = min(5, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if k else set()


def brute(rows):
    """Component of each id by comparing all pairs."""
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, []).append(grams(t))
    ids = sorted(sets)
    label = {d: d for d in ids}
    flat = [(d, s) for d in ids for s in sets[d] if s]
    for k, (a, x) in enumerate(flat):
        for b, y in flat[k + 1:]:
            if label[a] != label[b] and 100 * len(x & y) >= 85 * len(x | y):
                lo, hi = sorted((label[a], label[b]))
                label = {d: lo if v == hi else v for d, v in label.items()}
    return label


def changed(rng, words, share):
    out = list(words)
    for k in rng.sample(range(len(out)), max(1, int(share * len(out)))):
        out[k] = f"n{rng.randrange(10 ** 9)}"
    return out


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    texts = []
    for size, copies in ((120, 60), (40, 15), (800, 8), (300, 2)):
        base = fresh(size)
        texts += [" ".join(changed(rng, base, rng.choice([0.0, 0.005, 0.01, 0.03]))) for _ in range(copies)]
    chain = fresh(400)  # each link of the chain resembles the next one only
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = chain[9:] + fresh(9)
    passage = fresh(60)  # one passage in many documents links none of them
    texts += [" ".join(fresh(50) + passage + fresh(50)) for _ in range(60)]
    texts += [" ".join(fresh(rng.randint(1, 7))) for _ in range(20)]
    texts += [None, "", "  \n\t", "One two", "one  TWO\n", "É a b c d", "é a b c d", "x" * 30_000, "\xa0 a b c d e", "a\xa0 b c d e"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, rep int, label string").repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [(3, rows[3][1]), (None, rows[3][1]), (None, None), (-7, rows[11][1]), (20, rows[40][1]), (21, None), (22, rows[2][1])]
    want, text = brute(rows), {}
    for d, t in rows:
        text.setdefault(d, []).append(len(grams(t)))
    got = coordinate_join.near_copies(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles in text[r.doc_id]
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id == r.component_id)
    assert len({r.component_id for r in got}) < len(rows) - 40


def test_large_group_and_long_texts(spark):
    """A group larger than a block, copies of a text of 2 MB, a word longer than a piece."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(60)]
    rows = [(k, " ".join([*base[:-1], f"end{k}"])) for k in range(700)]  # all pairs at 55 / 57
    long = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(300_000))
    rows += [(1000, long), (1001, long + " more"), (1002, "y" * 2_500_000), (1003, "Y" * 2_500_000 + " z"), (1004, "y" * 2_500_000 + " z")]
    got = {r.doc_id: r.component_id for r in coordinate_join.near_copies(frame(spark, rows)).collect()}
    assert {got[k] for k in range(700)} == {0} and got[1001] == 1000
    assert got[1002] == 1002 and got[1003] == got[1004] == 1003


def test_empty_table(spark):
    assert coordinate_join.near_copies(frame(spark, [(1, "a")]).limit(0)).count() == 0
    assert [tuple(r) for r in coordinate_join.near_copies(frame(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]


def test_hashes_of_words_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice(["é", "B", "c", " ", "\n", "  ", "dd"]) for _ in range(5000))
    whole = coordinate_join.word_hashes(text)
    assert len(whole) == len(WORD.findall(text)) == len(coordinate_join.word_hashes(text.translate(LOWER)))
    assert len(set(whole)) == len(set(WORD.findall(text.translate(LOWER))))
    monkeypatch.setattr(coordinate_join, "CHUNK", 64)
    assert (coordinate_join.word_hashes(text) == whole).all()


def test_measured_chance_of_few_collisions():
    """Sets at the threshold agree on fewer than the required coordinates about as rarely as the binomial says."""
    rng = np.random.default_rng(5)
    seen, fine = [], []
    for _ in range(3000):
        common, own = rng.integers(0, 1 << 63, 170, dtype=np.uint64), rng.integers(0, 1 << 63, (2, 15), dtype=np.uint64)
        a, b = (coordinate_join.signature(np.sort(np.concatenate([common, x]))) for x in own)
        seen.append(int((a == b)[:64].sum()))
        fine.append(int((a == b).sum()))
        rough = (a & 0xFF) == (b & 0xFF)
        assert rough.sum() - (a == b).sum() <= 8  # one byte tells different minima apart
    for got, n in ((np.array(seen), 64), (np.array(fine), 256)):
        assert abs(got.mean() / n - 0.85) < 0.005 and abs(got.std() / (n * 0.85 * 0.15) ** 0.5 - 1) < 0.1
        assert got.min() >= coordinate_join.least_matches(0.85, 5e-7, n)
    assert coordinate_join.least_matches(0.85, 1e-6) == 39


def test_lists_of_one_label_are_skipped(spark):
    classes = spark.createDataFrame([(k, 10, bytearray(256)) for k in range(1300)], "rep long, n long, fine binary")
    postings = spark.createDataFrame([(7, k, 5 if k else 9) for k in range(1300)] + [(8, k, 5) for k in range(3)], "key long, rep long, hub long")
    visits = lambda d: coordinate_join._visits(postings, spark.createDataFrame(list(d.items()), "v long, label long"), classes).collect()
    assert visits({k: 0 for k in range(1300)}) == []
    got = visits({k: 0 for k in range(1298)})  # two sets are apart, and meet each of the three blocks
    assert {r.key for r in got} == {7} and sorted((r.rep, r.b) for r in got if r.probe) == [(k, b) for k in (1298, 1299) for b in range(3)]
    assert sum(not r.probe for r in got) == 1300
