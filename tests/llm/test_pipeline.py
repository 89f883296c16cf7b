"""The pipeline against a brute-force version on a small corpus."""

import random
import string

import numpy as np
import pytest

import corpus_pipeline
from test_documents import LOWER, counts, shingles
from trajspark.llm.bpe_tokens import encoder, vocabulary


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    texts = [text(rng.randint(60, 140)) for _ in range(60)]
    bad = [" ".join(w + "###" for w in text(70).split()) for _ in range(30)]
    copies = [texts[0].upper(), texts[0], texts[1].title(), texts[2]]
    near = []
    for t in texts[5:15]:
        for k in range(2):
            w = t.split()
            w[len(w) // 2] = "swapped%d" % k
            near.append(" ".join(w))
    short = ["too short", "", None, "spam " * 80]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts + bad + copies + near + short)]
    labels = [(k, int(k < 60), 0) for k in range(90)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_stages_and_result(spark, corpus):
    d, rows = corpus
    text = {r[0]: r[1] for r in rows}
    kept = []
    for k, t in text.items():
        n, _, symbols, _, repeated = counts(t)
        if n >= 50 and 100 * repeated <= 50 * n and not 60 <= k < 90:
            kept.append(k)
    best = {}
    for k in kept:
        best[text[k].translate(LOWER)] = k  # the largest id stays
    distinct = sorted(best.values())
    label = {k: k for k in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            x, y = shingles(text[a]), shingles(text[b])
            if len(x & y) >= 0.8 * len(x | y) - 1e-9:
                lo, hi = sorted((label[a], label[b]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    want = [kept, distinct, sorted(set(label.values()))]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], want):
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(ids), name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    enc = encoder(vocabulary(corpus_pipeline.VOCABULARY))
    pieces = corpus_pipeline.run(spark, d).collect()
    total = {}
    for p in pieces:
        assert p.doc_tokens == len(np.frombuffer(enc.encode(text[p.doc_id]), "<u4")) + 1
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert set(total) == set(want[-1])
    assert all(n == next(p.doc_tokens for p in pieces if p.doc_id == k) for k, n in total.items())


def test_empty_corpus(spark, corpus, tmp_path):
    d, _ = corpus
    for name in ("documents", "labels"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
