import hashlib
import random
import string
import zlib

import pytest

from pyspark.sql import functions as F

from trajspark.llm import merkle_manifest
from trajspark.llm.manifest_queries import op11

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    """All levels of the tree over ``nodes``, by its definition."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, pos):
    out = []
    for level in tree[:-1]:
        first = pos // 8 * 8
        out.append((level[first:pos], level[pos + 1:first + 8]))
        pos //= 8
    return out


def brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        own = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        langs[lang], trees[lang] = own, levels([leaf(*r) for r in own])
    top = levels([trees[lang][-1][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for pos, r in enumerate(langs[lang]):
            path = siblings(trees[lang], pos) + siblings(top, k)
            h = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                h = leaf(r[0], r[1] and r[1].translate(LOWER), *r[2:])
            for before, after in path:
                h = sha(*before, h, *after)
            proof = sha(*(x for before, after in path for x in before + after))
            out.append((r[0], leaf(*r), trees[lang][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return sorted(out, key=str)


def some_rows(n, seed):
    rng = random.Random(seed)
    words = ["Aa", "é", "B", "c\n", "", "zz"]
    rows = [(k, rng.choice([None, "", " ".join(rng.choices(words, k=5))]), rng.choice(["en", "en", "en", "de", "", None]),
             rng.choice([None, "s"]), rng.choice([None, 3])) for k in range(n)]
    return rows + [(5, "twice", "en", "s", 1), (5, "twice", "en", "s", 1), (None, "no id", "en", "s", 1), (None, None, None, None, None),
                   (-3, "A" * 200_000, "alone", "s", 1)]


@pytest.fixture(scope="module")
def put(spark, tmp_path_factory):
    def put(rows):
        d = str(tmp_path_factory.mktemp("manifest"))
        (spark.createDataFrame(rows, COLUMNS).withColumn("root", F.lit(1)).withColumn("pos", F.lit("x")).repartition(3)
         .write.parquet(f"{d}/documents.parquet"))
        return d

    return put


@pytest.mark.parametrize("n", [0, 700])
def test_query_against_brute_force(spark, put, n):
    rows = some_rows(n, 1)
    got = sorted((tuple(r) for r in op11(spark, put(rows)).collect()), key=str)
    assert got == brute(rows)
    if n:
        assert {r[-1] for r in got} == {True, False}


def test_empty_table(spark, put):
    assert op11(spark, put([])).count() == 0


def test_small_blocks_give_the_same_tree(spark, put):
    """Blocks of eight: four rounds of further appends, groups' roots in more than one block."""
    rows = some_rows(600, 2) + [(10_000 + k, "t", f"l{k:02d}", "s", 1) for k in range(20)]
    docs = spark.createDataFrame(rows, COLUMNS)
    entries = merkle_manifest.manifest(docs, levels=1, partitions=5)
    got = merkle_manifest.verified(entries).collect()
    assert all(r.verified and r.folded_root == r.root for r in got)
    mine = sorted(((r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof_sha256.hex()) for r in got), key=str)
    assert mine == sorted((r[:5] for r in brute(rows)), key=str)


def test_witness_grows_with_each_completed_run():
    tree = merkle_manifest.Appender(2)
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(11)]
    for k, d in enumerate(digests):
        tree.append(d)
        if k < 7:
            assert tree.witness == [b""] * (k + 1)
    assert {len(w) for w in tree.witness[:8]} == {2 + 7 * 32} and tree.witness[8:] == [b""] * 3
    root = tree.close()
    assert root.hex() == levels([d.hex() for d in digests])[-1][0]
    assert [merkle_manifest.folded(d, w)[0] for d, w in zip(digests, tree.witness)] == [root] * 11
