"""SentencePiece encoding and decoding by batched Viterbi (operator 8).

The distinct words of a batch are grouped by length, and all words of one length
advance together, character by character: hashes of the substrings that end there
are looked up among the sorted hashes of all pieces, a vectorised maximum picks
the best last piece, and back pointers give the pieces in the end.

For a unigram model a path is worth the sum of its pieces' scores.  For a BPE
model a path may only join pieces that the merge order leaves apart: a left and a
right piece stay apart if, at no moment at which an end of the one and a
beginning of the other stand side by side, a merge of these two comes before the
merges that use them up.  Exactly one path has only such joints: the merges' own.
Ids equal the library's for BPE models and its best path for unigram models
(tests compare them).
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trajspark.llm.common import Rows, slices

#: Words whose ids a worker keeps.
KEPT_WORDS = 400_000
#: Slots for answers on pairs of pieces: 2 to this power.
SLOT_BITS = 20
#: Field numbers of the model file, kinds of model, the space sign, the score of an unknown character.
TRAINER, NORMALIZER, MODEL_TYPE, DUMMY_PREFIX, UNIGRAM, BPE = 2, 3, 3, 3, 1, 2
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_NEVER = 1 << 30


def _fields(raw: bytes) -> dict[int, list]:
    """Fields of a protocol buffer message: integers and byte strings by number."""
    out, at = {}, 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            value = number()
        else:
            size = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            value, at = raw[at:at + size], at + size
        out.setdefault(tag >> 3, []).append(value)
    return out


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = _fields(sp.serialized_model_proto())
        self.kind = _fields(spec[TRAINER][-1]).get(MODEL_TYPE, [UNIGRAM])[-1] if TRAINER in spec else UNIGRAM
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("unigram and BPE models only")
        norm = _fields(spec[NORMALIZER][-1]) if NORMALIZER in spec else {}
        self.dummy_prefix = bool(norm.get(DUMMY_PREFIX, [1])[-1])
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.unk = sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.plain = plain
        self.score = np.full(n + 1, 0, np.float32)
        self.score[plain] = [sp.get_score(i) for i in plain]
        self.unknown = np.float32(self.score[plain].min() - UNKNOWN_PENALTY)
        self.longest = max(len(self.text[i]) for i in plain)
        # where words can be cut: at a space sign after another character, and around line ends, if no piece holds these
        inside = any(SPACE in self.text[i].lstrip(SPACE) for i in plain)
        ends = any("\n" in self.text[i] for i in plain)
        self.cut = re.compile(r"[\s\S]+" if inside else rf"{SPACE}*[^{SPACE}]+|{SPACE}+" if ends else
                              rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall
        self.kept: dict[str, bytes] = {}

    @functools.cached_property
    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the pieces and their ids; made when something is encoded, decoding needs none."""
        if self.kind == BPE:
            self._merge_order()
        keys = np.concatenate([self._hashes(np.array([[ord(c) for c in self.text[i]]], np.uint64), 0, len(self.text[i]))
                               for i in self.plain])
        order = np.argsort(keys)
        return keys[order], np.array(self.plain)[order]

    # --- BPE: which neighbours stay apart

    def _merge_order(self) -> None:
        by_text = {self.text[i]: i for i in self.plain}
        order = sorted(self.plain, key=lambda i: -float(self.score[i]))
        rank = {i: r for r, i in enumerate(order)}
        n = len(self.text)
        made, parts = np.full(n + 1, -1), np.full((n + 1, 2), -1)
        usable, pairs = [], {}
        for i in self.plain:
            t = self.text[i]
            for k in range(1, len(t)):
                a, b = by_text.get(t[:k]), by_text.get(t[k:])
                if a is not None and b is not None:
                    pairs[a, b] = rank[i]
            symbols = [by_text.get(c, self.unk) for c in t]
            last = None
            while len(symbols) > 1:
                best = min(((rank[p], k) for k in range(len(symbols) - 1)
                            if (p := by_text.get(self.text[symbols[k]] + self.text[symbols[k + 1]])) is not None), default=None)
                if best is None:
                    break
                last = symbols[best[1]:best[1] + 2]
                symbols[best[1]:best[1] + 2] = [order[best[0]]]
            if symbols == [i]:  # else the merges never make this piece
                usable.append(i)
                made[i] = rank[i] if last else -1
                if last:
                    parts[i] = last
        self.plain, self.made, self.parts = usable, made, parts
        known = sorted((a * (n + 1) + b, r) for (a, b), r in pairs.items())
        self.pair_keys = np.array([k for k, _ in known])
        self.pair_ranks = np.array([r for _, r in known])
        self.slot_keys, self.slot_values = np.full(1 << SLOT_BITS, -1), np.zeros(1 << SLOT_BITS, bool)

    def _stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Walk both pieces' histories backwards: undo whichever merge came later."""
        a, b = left.copy(), right.copy()
        used_a = np.full(len(a), _NEVER)   # rank of the merge that used the end up
        used_b = np.full(len(a), _NEVER)
        apart = np.ones(len(a), bool)
        live = np.arange(len(a))
        width = len(self.text) + 1
        while len(live):
            x, y = a[live], b[live]
            key = x * width + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)
            bad = (rank < used_a[live]) & (rank <= used_b[live]) & (rank < _NEVER)
            apart[live[bad]] = False
            made_x, made_y = self.made[x], self.made[y]
            done = bad | ((made_x < 0) & (made_y < 0))
            # of two merges of one rank the left one came first, so the right one is undone first
            back_x = ~done & (made_x > made_y)
            back_y = ~done & ~back_x
            i, j = live[back_x], live[back_y]
            used_a[i], a[i] = made_x[back_x], self.parts[x[back_x], 1]
            used_b[j], b[j] = made_y[back_y], self.parts[y[back_y], 0]
            live = live[~done]
        return apart

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_stay_apart``, with answers kept in a table of fixed size, one pair per slot."""
        key = left * (len(self.text) + 1) + right
        slot = ((key.astype(np.uint64) * _BASE) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = self.slot_values[slot]
        new = np.flatnonzero(self.slot_keys[slot] != key)
        if len(new):
            out[new] = self._stay_apart(left[new], right[new])
            self.slot_keys[slot[new]], self.slot_values[slot[new]] = key[new], out[new]
        return out

    # --- words of one length

    @staticmethod
    def _hashes(codes: np.ndarray, i: int, j: int) -> np.ndarray:
        """64-bit hash of characters i..j of each row."""
        h = np.zeros(len(codes), np.uint64)
        for k in range(i, j):
            h = (h ^ codes[:, k]) * _BASE
            h ^= h >> np.uint64(29)
        return h ^ np.uint64(j - i)

    def _advance(self, words: list[str], length: int) -> list[bytes]:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, length).astype(np.uint64)
        n = len(words)
        none = len(self.text)
        keys, ids_of = self.lookup
        found = np.full((length, min(length, self.longest), n), -1, np.int32)  # by start and length
        for i in range(length):
            h = np.zeros(n, np.uint64)
            for size in range(1, min(length - i, self.longest) + 1):
                h = (h ^ codes[:, i + size - 1]) * _BASE
                h ^= h >> np.uint64(29)
                key = h ^ np.uint64(size)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                found[i, size - 1] = np.where(keys[at] == key, ids_of[at], -1)
        best = np.full((length + 1, n), -np.inf, np.float32)
        best[0] = 0
        start = np.zeros((length + 1, n), np.int32)
        last = np.full((length + 1, n), none, np.int64)
        for j in range(1, length + 1):
            for i in range(max(0, j - self.longest), j):
                piece = found[i, j - i - 1].astype(np.int64)
                if j - i == 1:
                    piece = np.where(piece < 0, self.unk, piece)
                on = np.flatnonzero((piece >= 0) & (best[i] > -np.inf))
                if not len(on):
                    continue
                p = piece[on]
                if self.kind == UNIGRAM:
                    worth = best[i, on] + np.where(p == self.unk, self.unknown, self.score[p])
                else:
                    worth = np.zeros(len(on), np.float32)
                    if i:
                        worth[~self._apart(last[i, on], p)] = -np.inf
                up = worth > best[j, on]
                on, p = on[up], p[up]
                best[j, on], start[j, on], last[j, on] = worth[up], i, p
        out = []
        for k, word in enumerate(words):
            ids, j = [], length
            while j:
                i, piece = int(start[j, k]), int(last[j, k])
                if piece == self.unk and self.bytes:
                    ids.extend(self.bytes[b] for b in reversed(word[i:j].encode()))
                elif piece != self.unk or not ids or ids[-1] != self.unk or not self._merges_unknown:
                    ids.append(piece)
                j = i
            out.append(np.array(ids[::-1], "<u4").tobytes())
        return out

    #: The library writes neighbouring unknown characters of a word as one unknown piece.
    _merges_unknown = True

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, grouped by length, in portions of bounded size."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        out = {}
        for length, own in by_length.items():
            step = max(1, 400_000 // (length * min(length, self.longest)))
            for at in range(0, len(own), step):
                some = own[at:at + step]
                out.update(zip(some, self._advance(some, length)))
        return out

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers."""
        split = [self.cut(self.library.normalize(t)) if t else [] for t in texts]
        new = set().union(*split).difference(self.kept)
        self.kept.update(self._words(list(new)))
        out = [b"".join(map(self.kept.__getitem__, s)) for s in split]
        if len(self.kept) > KEPT_WORDS:
            for w in new:
                del self.kept[w]
        return out

    @functools.cached_property
    def _decode_table(self) -> list[bytes]:
        sp = self.library
        table = [t.replace(SPACE, " ").encode() for t in self.text]
        for i in range(len(table)):
            if sp.is_control(i):
                table[i] = b""
            elif sp.is_byte(i):
                table[i] = bytes([int(self.text[i][3:5], 16)])
            elif sp.is_unknown(i):
                table[i] = " ⁇ ".encode()
        return table

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: bytes pieces joined as UTF-8 (what is not valid becomes U+FFFD), the first space left out."""
        table = self._decode_table
        raw = b"".join([table[i] for i in ids.tolist()])
        if self.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@functools.cache
def model(path: str) -> PieceModel:
    """One model per worker process and file."""
    return PieceModel(path)


_CODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit integers), one row per row of ``docs``.

    Null and empty texts have no ids; null ids stay null; repeated rows are encoded
    each; an empty table gives no rows; other columns are not read.
    """

    def run(batches):
        rows, m = Rows(_CODED), model(path)
        for part in slices(batches, 512):
            for doc, ids in zip(part.column(0).to_pylist(), m.encode_many(part.column(1).to_pylist())):
                rows.add(doc, ids, weight=len(ids))
            if rows.ready():
                yield rows.take()
        yield from rows.rest()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, ids binary")


def decode(coded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text`` of ids as ``encode`` writes them, and the columns named in ``carry``; null ids give an empty text."""
    picked = coded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"),
                          *(F.col(f"`{c}`") for c in carry))
    schema = StructType([StructField("text", StringType()), *(f for f in picked.schema if f.name != "ids")])

    def run(batches):
        m = model(path)
        for part in slices(batches):
            texts = [m.decode(np.frombuffer(ids or b"", "<u4")) for ids in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()), *(part.column(f.name) for f in schema if f.name != "text")], names=schema.names)

    return picked.mapInArrow(run, schema)
