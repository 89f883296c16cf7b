import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trajspark.llm import id_store, length_table, packing
from trajspark.llm.bpe_tokens import encoder, vocabulary
from trajspark.llm.common import new_folder

PATH = vocabulary("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)  # as it is in the file: nothing set
TEXTS = ["the cat sat on the mat", "a  b", " x", "x ", "a\tb c", "a\n\nb c", "\n", "x\n", "日本語 テスト", "don't I'll 12abc 3.14",
         "<|endoftext|> hi", "a <|endoftext|> b", "a<|endoftext|>", "<|endoftext", "a 　b", "𝒳 ok ​ z", "a\r\nb c", "a\x1c b", "soft­hyphen", "Ñandú ölçü ½ x²", "", None,
         "word " * 3000, "x" * 5000]


def want(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again"), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_words_are_encoded_as_by_the_library():
    got = encoder(PATH).encode_many(TEXTS + TEXTS[::-1])
    for text, raw in zip(TEXTS + TEXTS[::-1], got):
        assert raw == want(text)[:-1].tobytes(), text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab Z9.,'é\n\t ñ\U0001F600\0 ", max_size=30), max_size=4))
def test_any_text(texts):
    assert encoder(PATH).encode_many(texts) == [want(t)[:-1].tobytes() for t in texts]


def test_packing_covers_every_id_once(docs):
    rows = packing.pack(docs, PATH, capacity=64, open_limit=5).collect()
    texts = [want(t) for t in TEXTS] + [want(TEXTS[3]), want("no id")]
    assert sum(r.length for r in rows) == sum(map(len, texts))
    for r in rows:
        if r.doc_id is not None:
            own = want(TEXTS[r.doc_id])
            assert r.doc_tokens == len(own) and r.ids == own[r.start:r.start + r.length].tobytes()
    spans = {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append((r.start, r.length))
    for doc, got in spans.items():
        own = len(want("no id" if doc is None else TEXTS[doc]))
        covered = np.zeros(own, int)
        for start, length in got:
            covered[start:start + length] += 1
        assert (covered == (2 if doc == 3 else 1)).all()
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_length))
    for own in windows.values():
        at = 0
        for offset, length, total in sorted(own):
            assert offset == at and total == sum(x[1] for x in own)
            at += length
        assert at == 64 or at & (at - 1) == 0


def test_level_choice_is_the_least_sum_of_squares():
    rng = np.random.default_rng(1)
    w = packing.Windows(32, 1000)
    for _ in range(400):
        size = int(rng.integers(1, 32))
        costs = {}
        for level in [0, *[h for h in range(1, 33 - size) if w.counts[h]]]:
            c = w.counts.copy()
            if level:
                c[level] -= 1
            if level + size < 32:
                c[level + size] += 1
            costs[level] = int((c[1:32] ** 2).sum())
        got = w.level_for(size)
        assert costs[got] == min(costs.values())
        list(w.place((0, 0, b"\0" * 4 * size, size)))


def test_packing_of_nothing(spark, docs):
    assert packing.pack(docs.limit(0), PATH).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-2**40, 2**40), max_size=700))
def test_elias_fano(values):
    values = sorted(values)
    e, end = id_store.EliasFano.load(id_store.EliasFano.of(np.array(values, np.int64)).dump())
    assert e.values(0, len(values)).tolist() == values
    for first, last in ((0, 1), (3, 300), (255, 257), (256, 512), (500, 700), (40, 40)):
        last = min(last, len(values))
        assert e.values(first, last).tolist() == values[first:last]
    for v in (-2**41, 0, *values[::50]):
        assert e.rank(v) == sum(x < v for x in values)
    for i in range(0, len(values), 37):
        assert e.select(i) == values[i]


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(0).integers(1, 2000, 20_000))
    assert len(id_store.EliasFano.of(v).dump()) * 8 / len(v) < 2 + np.log2(v[-1] / len(v)) + 1.5


def test_store_round_trip(spark, docs):
    store = id_store.write_store(docs, PATH, new_folder(spark, "t"), partitions=3)
    rows = id_store.read_store(spark, store, ids_at_once=100).collect()
    assert sorted((r.doc_id is not None, r.doc_id) for r in rows if r.doc_id is not None) == sorted(
        (True, i) for i in [*range(len(TEXTS)), 3])
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        own = want("no id" if r.doc_id is None else TEXTS[r.doc_id])
        assert (r.start, r.n_tokens, r.ids) == (at, len(own), own.tobytes())
        at += len(own)
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [None, *sorted([*range(len(TEXTS)), 3])]
    asked = spark.createDataFrame([(i, "x") for i in [*range(-2, len(TEXTS) + 3), None, 3, 3]], "doc_id long, shard string")
    found = id_store.look_up(store, asked).collect()
    every = sorted(((r.doc_id, r.start, r.n_tokens, r.ids) for r in rows if r.doc_id is not None))
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids) for r in found) == every
    assert id_store.look_up(store, asked.limit(0)).count() == 0
    empty = id_store.write_store(docs.limit(0), PATH, new_folder(spark, "t"))
    assert id_store.read_store(spark, empty).count() == 0 and id_store.look_up(empty, asked).count() == 0


def test_large_shard_by_select(spark):
    """Boundaries over more than one select sample, wide ids."""
    rows = [(3 * i, "word " * (i % 5)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    store = id_store.write_store(docs, PATH, new_folder(spark, "t"), partitions=2, width=4)
    got = {r.doc_id: r for r in id_store.read_store(spark, store).collect()}
    at = 0
    for i, t in rows:
        assert (got[i].start, got[i].ids) == (at, want(t).tobytes())
        at += len(want(t))
    some = id_store.look_up(store, docs.where("doc_id % 7 = 0")).collect()
    assert {r.doc_id: r for r in some} == {i: r for i, r in got.items() if i % 7 == 0}


def test_one_id_in_many_shards(spark):
    """Half the rows without an id, a third with one id: they fill several shards, still in order."""
    rows = [(None, f"blank {k}") for k in range(300)] + [(5, f"five {k}") for k in range(200)] + [(k, f"own {k}") for k in range(100)]
    store = id_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH, new_folder(spark, "t"), partitions=8)
    assert len(store.shards) >= 6 and max(s[2] for s in store.shards) < 200
    got = sorted(id_store.read_store(spark, store).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == [None] * 300 + sorted([5] * 200 + list(range(100)))
    assert sorted(r.ids for r in got) == sorted(want(t).tobytes() for _, t in rows)
    found = id_store.look_up(store, spark.createDataFrame([(5,), (6,)], "doc_id long")).collect()
    assert len(found) == 202 and {r.start for r in found} == {r.start for r in got if r.doc_id in (5, 6)}


def test_long_texts_in_pieces(monkeypatch):
    from trajspark.llm import bpe_tokens
    monkeypatch.setattr(bpe_tokens, "AT_ONCE", 40)
    rng = np.random.default_rng(4)
    bits = ["a", "word", "é", "12", "x,", "\n", " ", "  ", "\xa0", "long" * 20]
    enc = bpe_tokens.WordEncoder(PATH)
    for odd in (False, True):
        texts = [" ".join(rng.choice(bits if odd else bits[:5] + bits[9:], int(rng.integers(0, 80)))) for _ in range(150)]
        assert enc.encode_many(texts) == [want(t)[:-1].tobytes() for t in texts]


def test_full_tables_start_anew(monkeypatch):
    from trajspark.llm import bpe_tokens
    monkeypatch.setattr(bpe_tokens, "KEPT_WORDS", 50)
    monkeypatch.setattr(bpe_tokens, "KEPT_PARTS", 20)
    enc = bpe_tokens.WordEncoder(PATH)
    for at in range(0, 2000, 100):
        texts = [f"v{k} x{k % 70}, {k}\ny{k * k}" for k in range(at, at + 100)]
        assert enc.encode_many(texts) == [want(t)[:-1].tobytes() for t in texts]
    assert enc.words.n <= 450
    plain = bpe_tokens.WordEncoder(PATH, special_as_text=True)
    assert plain.encode("a <|endoftext|> b") != enc.encode("a <|endoftext|> b") == want("a <|endoftext|> b")[:-1].tobytes()


def test_length_histogram(docs):
    lens = np.array([len(want(t)) for t in [*TEXTS, TEXTS[3], "no id"]])
    rows = length_table.length_histogram(length_table.lengths(docs, PATH)).collect()
    assert {r.n_tokens for r in rows} == set(lens.tolist())
    for r in rows:
        n = r.n_tokens
        assert (r.n_docs, r.docs_upto, r.docs_over) == ((lens == n).sum(), (lens <= n).sum(), (lens > n).sum())
        assert r.tokens_upto == lens[lens <= n].sum() and r.tokens_over == lens[lens > n].sum()
        assert r.tokens_kept == np.minimum(lens, n).sum() and r.tokens_cut == lens.sum() - r.tokens_kept
        assert r.quantile == pytest.approx((lens <= n).mean())
    assert length_table.length_histogram(length_table.lengths(docs.limit(0), PATH)).count() == 0


def test_crc_of_ids(docs):
    rows = packing.pack(docs, PATH).select("ids", F.crc32("ids").alias("c")).collect()
    assert all(r.c == zlib.crc32(r.ids) for r in rows)
