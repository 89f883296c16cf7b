import collections
import hashlib
import random
import re
import string

import numpy as np
import pytest

from trajspark.llm import chosen_path, content_sort, decision_list, line_align

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^ \t-\r]+")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, row string, i long").repartition(4)


def test_exact_dedup_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["", None, "Hot Text É", "hot text É", "hot text é", "a" * 20_000, *("t%d" % k for k in range(20))]
    rows = [(k, rng.choice(texts[2:4]) if k % 3 == 0 else rng.choice(texts), "r", 1) for k in range(600)]
    rows += [(7, "twice", "r", 1), (7, "twice", "r", 1), (None, "twice", "r", 1), (None, "only null", "r", 1)]
    docs = frame(spark, rows)
    groups = collections.defaultdict(list)
    for d, t, *_ in rows:
        groups[(t or "").translate(LOWER)].append(d)
    for keep, best in (("max", max), ("min", min)):
        got = content_sort.exact_dedup(docs, keep=keep, partitions=11).collect()
        assert len(got) == len(rows)
        norm = {hashlib.sha256(k.encode()).hexdigest(): k for k in groups}
        kept = collections.Counter()
        for r in got:
            own = groups[norm[r.text_sha256]]
            ids = [x for x in own if x is not None]
            assert r.group_size == len(own) and r.keep_id == (best(ids) if ids else None)
            if r.kept:
                kept[r.text_sha256] += 1
                assert r.doc_id == r.keep_id
        assert kept == {k: 1 for k in norm}
        rest = content_sort.drop_copies(docs, keep=keep, partitions=11)
        assert rest.columns == docs.columns and rest.count() == len(groups)
    assert content_sort.exact_dedup(docs.limit(0)).count() == 0
    assert content_sort.drop_copies(docs.limit(0)).count() == 0


def counts(x):
    w = WORD.findall(x or "")
    lines = [y for y in (x or "").split("\n") if WORD.search(y)]
    c, cover = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i:i + 3])] > 1:
            cover.update((i, i + 1, i + 2))
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in x or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_counts_and_rules(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for k in range(300):
        bad = k % 4 == 0
        rows.append((k, " ".join(word() + ("##" if bad else "") for _ in range(60 + k % 7)), "r", 1))
        labels.append((k, 0 if bad else 1))
    odd = [None, "", " \n\t ", "a b c a b c", "x\ny\nx\n\nx", "a a a a a", "one", "é ü z   w", "l1\r\nl1\r\nl2 #*$%&|<>", "w " * 70_000]
    rows += [(1000 + k, t, "r", 1) for k, t in enumerate(odd)] + [(None, "null id", "r", 1), (0, rows[0][1], "r", 1)]
    labels += [(None, 1), (5000, 0), (3, None)]
    docs = frame(spark, rows)
    rules = decision_list.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert rules and all(r.good == 0 for r in rules)
    got = decision_list.judged(docs, rules).collect()
    assert len(got) == len(rows)
    text = dict((r[0], r[1]) for r in rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text[r.doc_id]), text[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        if r.doc_id is not None and r.doc_id < 300:
            assert r.kept == (r.doc_id % 4 != 0)
    kept = decision_list.keep_good(docs, rules)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert decision_list.learn(docs, none) == [] and decision_list.judged(docs.limit(0), []).count() == 0


def test_rules_find_rare_junk_beside_a_weak_signal(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for k in range(1500):
        bad, junk = k % 2 == 0, k % 72 == 0   # junk: 21 of 750 bad rows
        long = rng.random() < (0.6 if bad else 0.3)
        rows.append((k, " ".join(word() + ("##" if junk else "") for _ in range(rng.randint(60, 66) + 10 * long)), "r", 1))
        labels.append((k, int(not bad)))
    docs = frame(spark, rows)
    rules = decision_list.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert all(r.bad >= 0.9 * (r.bad + r.good) for r in rules)
    kept = {r.doc_id for r in decision_list.judged(docs, rules).where("kept").collect()}
    assert not any(k % 72 == 0 for k in kept) and sum(k % 2 for k in kept) > 700


def shingles(text, n=5):
    w = [x for x in re.split(r"[ \t-\r]+", (text or "").lower()) if x]
    k = min(n, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set()


def test_jaccard_join_against_brute_force(spark):
    rng = random.Random(11)
    words = ["w%d" % k for k in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    for k in range(60):  # shared passage, otherwise different
        texts.append(" ".join(rng.choice(words) for _ in range(80)) + " " + passage)
    base = [rng.choice(words) for _ in range(200)]
    for k in range(90):  # a large group of near copies
        w = list(base)
        for _ in range(k % 3):
            w[rng.randrange(200)] = "n%d" % k
        texts.append(" ".join(w))
    for t in list(texts[:30]):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", "  ", "one two", "One two", "one two three four five"]
    rows = [(k, t, "r", 1) for k, t in enumerate(texts)] + [(None, texts[0], "r", 1)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in chosen_path.similar(docs, small=16, block=8).collect()}
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    links = [0] * len(texts)
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    first = {}
    for k in range(len(texts)):
        first.setdefault(label[k], k)
    for k in range(len(texts)):
        assert (got[k].n_links, got[k].class_id) == (links[k], first[label[k]]), k
    assert got[None].class_id is None and got[None].n_links == 0
    left = chosen_path.one_of_each(docs, small=16, block=8)
    assert left.columns == docs.columns and left.count() == len(set(label)) + 1
    assert chosen_path.similar(docs.limit(0)).count() == 0


def test_repeats_for_recall():
    n = chosen_path.runs_for(0.8, 3, 0.9999)
    assert (1 - chosen_path.survival(0.8, 3)) ** n <= 1e-4 < (1 - chosen_path.survival(0.8, 3)) ** (n - 1)


def test_patience_blocks():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randrange(12) for _ in range(rng.randint(0, 25))]
        b = [rng.randrange(12) for _ in range(rng.randint(0, 25))]
        blocks, at = line_align.patience(a, b), (0, 0)
        for i, j, n in blocks:
            assert i >= at[0] and j >= at[1] and a[i:i + n] == b[j:j + n]
            at = (i + n, j + n)
    assert line_align.patience(list("abcdef"), list("xabcyef")) == [(0, 1, 3), (4, 5, 2)]


def test_line_dedup(spark):
    long = ["This is a long line number %d that tells documents apart." % k for k in range(8)]
    texts = {1: "\n".join(long[:4]), 2: "\n".join(["own line of the second document, quite long"] + long[1:3] + ["end"]),
             3: "\n".join(long[:4]), 4: "short\nlines\nonly", 5: "short\nother", 6: None, 7: "", 8: "\n".join([long[5], "", long[5]]),
             9: "\n".join(["  " + long[2] + " ", "new", long[5]])}
    rows = [(k, t, "r", 1) for k, t in texts.items()] + [(None, long[0], "r", 1), (4, texts[4], "r", 1)]
    got = {r.doc_id: r for r in line_align.drop_repeated_lines(frame(spark, rows)).collect()}
    assert got[1].text == texts[1] and got[1].n_deleted == 0
    assert got[2].text == "own line of the second document, quite long\nend" and got[2].n_deleted == 2
    assert got[3].text == "" and got[3].copy_of == 1 and got[3].n_deleted == got[3].n_lines == 4
    assert got[5].text == texts[5] and got[6].text is None and got[7].text == "" and got[8].text == texts[8]
    assert got[9].text == "new\n" + long[5] or got[9].text == "new"
    assert got[None].text == long[0]
    assert line_align.drop_repeated_lines(frame(spark, []).limit(0)).count() == 0


def common_blocks(a, b, least=40):
    """Positions of b in any run of lines common with a, of enough characters."""
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if sum(map(len, b[j:j + n])) >= least:
                out.update(range(j, j + n))
    return out


def all_pairs(texts):
    """Deleted lines by document, from every pair of an earlier and a later one."""
    cut = {d: [x.strip(" \t\r\x0b\x0c") for x in t.split("\n")] for d, t in texts.items()}
    return {d: sorted(set().union(*(common_blocks(cut[e], cut[d]) for e in cut if e < d))) for d in cut}


def check_against_all_pairs(spark, texts):
    rows = [(d, t, "r", 1) for d, t in texts.items()]
    got = {r.doc_id: r for r in line_align.repeated_lines(frame(spark, rows)).collect()}
    for d, lines in all_pairs(texts).items():
        if d in got and got[d].copy_of is not None:
            assert texts[got[d].copy_of] == texts[d] and got[d].copy_of < d
        else:
            assert (list(got[d].lines) if d in got else []) == lines, d
    return got


def test_line_dedup_owner_with_the_line_twice_crossing_and_split_owners(spark):
    p, q = "P is a passage of more than forty characters, say.", "Q is another passage of more than forty characters."
    twice = {1: f"head\n{p}\nmiddle\n{p}\nfoot"} | {k: f"own {k}\n{p}\nend {k}" for k in range(2, 30)}
    assert all(check_against_all_pairs(spark, twice)[k].lines == [1] for k in range(2, 30))
    check_against_all_pairs(spark, {1: f"a\n{q}\nb\n{p}\nc", 2: f"d\n{p}\ne", 3: f"f\n{p}\ng\n{q}\nh"})
    split = {1: f"x\n{p}\ny", 2: f"z\n{q}\nw", 3: f"one\nverse\n{p}\nverse\n{q}\nthree", 4: f"u\nverse\n{p}\nverse\n{q}\nv"}
    assert check_against_all_pairs(spark, split)[4].lines == [1, 2, 3, 4]


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(11)
    lines = ["", "  ", *("s%d" % k for k in range(4)), *(f"a line of twenty and {k}" for k in range(4)),
             *(f"a line that alone is long enough to be a block {k}" for k in range(4))]
    texts = {k: "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14))) for k in range(90)}
    check_against_all_pairs(spark, texts)


def test_line_dedup_of_many_sharers(spark):
    shared = "A passage line that very many documents carry in the same form, over forty characters."
    rows = [(k, f"own {k} words of this document\n{shared}\nlast {k}", "r", 1) for k in range(300)]
    got = line_align.drop_repeated_lines(frame(spark, rows)).collect()
    assert sum(shared in r.text for r in got) == 1 and all(r.n_deleted == (r.doc_id > 0) for r in got)


def test_line_dedup_of_short_lines_that_many_share(spark):
    verse = "\n".join(f"short verse {k} of ten" for k in range(10))
    for sharers in (8, 9, 40):
        rows = [(k, f"own {k}\n{verse}\nlast {k}", "r", 1) for k in range(sharers)]
        got = line_align.drop_repeated_lines(frame(spark, rows)).collect()
        assert all(r.n_deleted == (10 if r.doc_id else 0) for r in got)


def test_hash_of_windows_is_stable():
    a, b = chosen_path.shingle_sets(["A b c d e f", "x\n" * 3 + "a B  c d\te f"], 5)
    assert len(np.intersect1d(a, b)) == 2 and len(a) == 2
    assert [len(s) for s in chosen_path.shingle_sets([None, "", " ", "a", "a b c"], 5)] == [0, 0, 0, 1, 1]


def test_settings_are_checked(spark):
    with pytest.raises(ValueError):
        content_sort.exact_dedup(frame(spark, [(1, "a", "r", 1)]), keep="first")


def _plain_common(a, b, sizes, least):
    """All lines of ``b`` in any run of equal lines long enough, by trying every pair of places."""
    gone = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if sum(sizes[j:j + n]) >= least:
                gone.update(range(j, j + n))
    return gone


def test_alignment_finds_every_common_block(monkeypatch):
    rng = random.Random(5)
    cases = []
    for _ in range(1500):
        kinds = rng.choice([2, 4, 12, 60])
        a = [rng.randrange(kinds) for _ in range(rng.randrange(30))]
        b = [rng.randrange(kinds) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(4)):                      # passages moved, repeated and crossing
            at, n = rng.randrange(len(a) + 1), rng.randrange(1, 9)
            to = rng.randrange(len(b) + 1)
            b[to:to] = a[at:at + n]
        mark = [rng.randrange(1, 1 << 62) for _ in range(kinds)]   # as hashes of lines are
        cases.append(([mark[x] for x in a], [mark[x] for x in b], [0 if x == 0 else 3 + x % 20 for x in b], rng.choice([1, 12, 40])))
    cases.append(([x for p in range(60) for x in (p, p + 100)], [x for p in reversed(range(60)) for x in (p, p + 100)], [25] * 120, 40))
    found = 0
    for case in cases:
        want = _plain_common(*case)
        assert line_align.common_lines(*case) == want, case
        found += len(want)
    assert found > 10000
    monkeypatch.setattr(line_align, "patience", lambda a, b: [])
    assert not any(line_align.common_lines(*case) for case in cases)
