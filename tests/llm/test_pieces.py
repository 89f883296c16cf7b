import numpy as np
import pytest
import sentencepiece

from trajspark.llm import piece_viterbi
from trajspark.llm.bpe_tokens import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
TEXTS = ["the cat sat on the mat", "a  b", " x", "x ", "a\tb", "\n\n", "日本語 テスト", "aaaaaaaaaaaa", "   ", "don't 12abc 3.14",
         "𝒳 ok ​ z", "hello <s> </s>", "é́ ñandú", "a" * 300, "----====", "1111111", "", "electroencephalography antidisestablishment",
         "mississippi bananas Mississippi", "The quick brown fox jumps over the lazy dog. " * 5]


def as_unigram(path, out):
    """The same pieces and scores as a unigram model: the kind is one number of the model file."""
    raw = open(path, "rb").read()

    def varint(n):
        b = b""
        while True:
            b += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return b

    def walk(raw, change):
        at, new = 0, b""
        while at < len(raw):
            start, n = at, 0
            tag = raw[at]; at += 1
            while raw[at - 1] & 128:
                tag = tag & 127 | raw[at] << 7; at += 1
            if tag & 7 == 0:
                while raw[at] & 128:
                    at += 1
                at += 1
                new += change(tag >> 3, raw[start:at], None)
            else:
                if tag & 7 == 2:
                    n = shift = 0
                    while True:
                        n |= (raw[at] & 127) << shift
                        shift += 7; at += 1
                        if raw[at - 1] < 128:
                            break
                else:
                    n = {5: 4, 1: 8}[tag & 7]
                body, at = raw[at:at + n], at + n
                new += change(tag >> 3, raw[start:at], body)
        return new

    trainer = lambda f, whole, body: b"\x18\x01" if f == 3 and body is None else whole
    new = walk(raw, lambda f, whole, body: varint(f << 3 | 2) + varint(len(x := walk(body, trainer))) + x if f == 2 else whole)
    out.write_bytes(new)
    return str(out)


def same(path):
    m, sp = piece_viterbi.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text, raw in zip(TEXTS, m.encode_many(TEXTS)):
        ids = np.frombuffer(raw, "<u4")
        assert ids.tolist() == sp.encode(text, num_threads=1), text
        assert m.decode(ids) == sp.decode(ids.tolist())
    return m


def test_bpe_ids_equal_the_library():
    assert same(PATH).kind == piece_viterbi.BPE


def test_unigram_ids_are_the_best_path(tmp_path):
    """The first of the library's n best paths, which its lattice finds exactly."""
    path = as_unigram(PATH, tmp_path / "unigram.model")
    m, sp = piece_viterbi.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert m.kind == piece_viterbi.UNIGRAM
    for text in [t for t in TEXTS if 0 < len(t) < 60]:
        ids = np.frombuffer(m.encode_many([text])[0], "<u4").tolist()
        best = sp.nbest_encode_as_ids(text, 2)[0]
        worth = lambda x: sum(sp.get_score(i) for i in x if not sp.is_byte(i))
        assert worth(ids) == worth(best) and sp.decode(ids) == sp.decode(best), text


def test_query_forms(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (99, None, "x"), (0, TEXTS[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = piece_viterbi.encode(docs, PATH)
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    back = piece_viterbi.decode(coded.selectExpr("*", "doc_id AS text_id"), PATH, carry=("text_id",)).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id is not None) == sorted(
        (i, sp.decode(sp.encode(t or "", num_threads=1))) for i, t, _ in rows if i is not None)
    assert piece_viterbi.encode(docs.limit(0), PATH).count() == 0


def test_other_kinds_are_refused():
    with pytest.raises(Exception):
        piece_viterbi.PieceModel(vocabulary("byte_bpe_50k.json"))
