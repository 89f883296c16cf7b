"""Token ids of whole texts, word by word, with the tokenizers library.

A byte-level BPE never joins letters over the start of a run of white space, so
the ids of a text are the ids of its words one after the other, each with the space
or line feed before it.  A batch of texts becomes one array of bytes: words are
found, hashed and looked up as arrays, and the ids of the batch are one gather
from the table of words met so far.  Only words that the table lacks become Python
strings; the library's BPE model encodes them.  Texts with unusual white space or
with an added token of the vocabulary inside go to the library whole.  Ids equal
``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids`` (tests
compare them).
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np

#: Words, and parts of words, whose ids a worker keeps; a full table starts anew.
KEPT_WORDS, KEPT_PARTS = 1_000_000, 200_000
#: Bytes that become arrays in one go.
AT_ONCE = 1 << 18
#: The pre-tokenisation pattern of the byte-level vocabulary, for
#: printable characters up to U+024F (letters, numbers, others) without white space.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_LATIN_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+").findall
#: Words that go to the library on their own, and white space inside a word.
_ODD = re.compile(r"[^!-~¡-ɏ]")
_BLANK = re.compile(r"[\s﻿᠎​]")
#: What stands before a word: a space, a line feed, or the start of its text.
_SPACE, _LINE, _START = 32, 10, 0


@functools.cache
def _letters() -> dict[int, str]:
    """Byte -> printable letter of byte-level BPE: printable Latin-1 stays, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _pieces(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(byte before it, piece) of a text in pieces of about AT_ONCE bytes; all but the first follow a space."""
    at, lead = 0, b"\0"
    while len(raw) - at > AT_ONCE:
        end = raw.find(b" ", at + AT_ONCE)
        if end < 0:
            break
        yield lead, raw[at:end]
        at, lead = end + 1, b" "
    yield lead, raw[at:]


class _Hash:
    """Polynomial hash, modulo 2 ** 64, of stretches of a byte array; mixed at the end."""

    def __init__(self, seed: int):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.byte = draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(draw.integers(0, 1 << 62)) * 4 + 1
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        size = max(n, 2 * len(self.up), 1 << 16)
        self.up, self.down = (np.multiply.accumulate(np.concatenate(
            [np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (self.base, pow(self.base, -1, 1 << 64)))

    def of(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.up) < len(raw):
            self._grow(len(raw))
        total = np.empty(len(raw) + 1, np.uint64)
        total[0] = 0
        np.cumsum(self.byte[raw] * self.up[:len(raw)], out=total[1:])
        x = (total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


class _Words:
    """Words by two 64-bit hashes (open addressing) with the place and number of their ids."""

    def __init__(self, room: int):
        self.bits = max(10, (2 * room - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.n, self.used = 0, 0
        self.keys = np.empty((1 << 12, 2), np.uint64)
        self.place = np.empty((1 << 12, 2), np.int64)   # first id, and how many (-1: needs its whole text)
        self.ids = np.empty(1 << 13, "<u4")

    def _steps(self, h: np.ndarray):
        """Rounds of probing: (who still looks, its slot); send back who goes on."""
        at, who = (h & np.uint64((1 << self.bits) - 1)).astype(np.int64), np.arange(len(h))
        while len(who):
            more = yield who, at
            who, at = who[more], (at[more] + 1) & ((1 << self.bits) - 1)

    def find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Number of each word, -1 if it isn't known."""
        out = np.full(len(h), -1, np.int64)
        steps = self._steps(h)
        who, at = next(steps, (None, None))
        while who is not None:
            held = self.slot[at]
            same = (held >= 0) & (self.keys[held, 0] == h[who]) & (self.keys[held, 1] == g[who])
            out[who[same]] = held[same]
            try:
                who, at = steps.send((held >= 0) & ~same)
            except StopIteration:
                break
        return out

    def add(self, h: np.ndarray, g: np.ndarray, ids: list[bytes | None]) -> None:
        """New words (each once, none known)."""
        first = self.n
        self.n += len(h)
        while len(self.keys) < self.n:
            self.keys, self.place = np.concatenate([self.keys] * 2), np.concatenate([self.place] * 2)
        sizes = np.array([-4 if x is None else len(x) for x in ids], np.int64) // 4
        flat = np.frombuffer(b"".join(filter(None, ids)), "<u4")
        total, known = len(flat), np.maximum(sizes, 0)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), total), "<u4")])
        self.ids[self.used:self.used + total] = flat
        self.keys[first:self.n] = np.column_stack([h, g])
        self.place[first:self.n, 0] = self.used + np.cumsum(known) - known
        self.place[first:self.n, 1] = sizes
        self.used += total
        steps = self._steps(h)
        who, at = next(steps, (None, None))
        while who is not None:
            free = np.flatnonzero(self.slot[at] < 0)
            taken, one = np.unique(at[free], return_index=True)
            self.slot[taken] = first + who[free[one]]
            more = np.ones(len(who), bool)
            more[free[one]] = False
            try:
                who, at = steps.send(more)
            except StopIteration:
                break


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers in bytes.

    ``special_as_text``: an added token's string inside a text is ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = special_as_text
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.model = self.whole.model
        self.letters = dict(_letters())
        # a letter that no merge knows keeps parts apart when many go to the model in one call
        merged = "".join(set("".join(t) for t in self.whole.get_vocab() if len(t) > 1))
        self.apart = next(c for c in self.letters.values() if c not in merged)
        self.letters[10] = self.apart
        self.apart_id = self.whole.token_to_id(self.apart)
        self.words, self.hashes = _Words(KEPT_WORDS), (_Hash(1), _Hash(2))
        self.parts: dict[str, bytes] = {}
        self.line_end = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _merge(self, parts: list[str]) -> None:
        """Ids of parts, by the library's model, many parts in a call."""
        for at in range(0, len(parts), 500):
            some = parts[at:at + 500]
            letters = "\n".join(some).encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.model.tokenize(letters)], "<u4")
            ends = (4 * np.flatnonzero(ids == self.apart_id)).tolist()
            raw, starts = ids.tobytes(), [0, *(e + 4 for e in ends)]
            self.parts.update(zip(some, [raw[i:j] for i, j in zip(starts, [*ends, len(raw)], strict=True)], strict=True))

    def _learned(self, words: list[str]) -> list[bytes | None]:
        """Ids of words with what stands before them as first character; None: only the whole text can tell."""
        bare = [w if w[0] == " " else w[1:] for w in words]
        clean = [not _ODD.search(w, 1) for w in words]
        split = [_LATIN_PARTS(b) if fine else () for b, fine in zip(bare, clean)]
        self._merge(list(set().union(*split).difference(self.parts)))
        known = self.parts
        ids = [known[own[0]] if len(own) == 1 else b"".join([known[p] for p in own]) for own in split]
        for k, w in enumerate(words):
            if not clean[k]:
                ids[k] = None if _BLANK.search(w, 1) else self._whole(bare[k])
            if w[0] == "\n" and ids[k] is not None:
                ids[k] = self.line_end + ids[k]
        if len(known) > KEPT_PARTS:
            self.parts = {}
        return ids

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text; null and empty texts have none."""
        out: list[list[bytes] | bytes] = [b""] * len(texts)
        group, size = [], 0
        for k, t in enumerate(texts):
            if t and any(a in t for a in self.added):
                out[k] = self._whole(t)
                continue
            for lead, piece in _pieces(t.encode()) if t else ():
                if group and size + len(piece) > AT_ONCE:
                    self._encode(group, texts, out)
                    group, size = [], 0
                group.append((k, lead, piece))
                size += len(piece)
        if group:
            self._encode(group, texts, out)
        if self.words.n > KEPT_WORDS:
            self.words.clear()
        return [x if isinstance(x, bytes) else b"".join(x) for x in out]

    def _encode(self, group: list[tuple[int, bytes, bytes]], texts: list[str | None], out: list) -> None:
        """Ids of pieces (number of their text, byte before them, bytes), added to ``out`` by text."""
        raw = np.frombuffer(b"".join(x for _, lead, piece in group for x in (lead, piece)) + b"\0", np.uint8)
        edge = np.cumsum([0, *(len(piece) + 1 for *_, piece in group)])   # where a piece starts, with the byte before it
        cut = (raw == _SPACE) | (raw == _LINE)
        cut[edge] = True
        start = np.flatnonzero(cut)
        start, end = start[:-1], start[1:]
        h, g = (x.of(raw, start, end) for x in self.hashes)
        number = self.words.find(h, g)
        new = np.flatnonzero((number < 0) & (end > start + 1))
        if len(new):
            _, one = np.unique(h[new], return_index=True)
            some, whole = new[one], raw.tobytes()
            self.words.add(h[some], g[some], self._learned([whole[a:b].decode() for a, b in zip(start[some].tolist(), end[some].tolist())]))
            number[new] = self.words.find(h[new], g[new])
        place, size = self.words.place[number].T
        # double, leading or trailing white space leaves an empty word; its text is unusual
        unusual = (end == start + 1) | (number < 0) | (size < 0)
        piece_of = np.searchsorted(edge, start, "right") - 1
        odd = np.zeros(len(group), bool)
        odd[piece_of[unusual]] = True
        size = np.where(odd[piece_of], 0, size)
        last = np.cumsum(size)
        ids = self.words.ids[np.repeat(place - (last - size), size) + np.arange(int(last[-1]))]
        stop = 4 * np.concatenate([[0], last])[np.searchsorted(start, edge[1:])]
        flat, at = ids.tobytes(), 0
        for (k, lead, _), to, strange in zip(group, stop.tolist(), odd.tolist()):
            if strange and not (lead == b" " and isinstance(out[k], bytes)):
                out[k] = self._whole(texts[k])  # once: a text that went whole takes no further piece
            elif not strange and (lead == b"\0" or isinstance(out[k], list)):
                out[k] = [flat[at:to]] if lead == b"\0" else [*out[k], flat[at:to]]
            at = to

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    return WordEncoder(path)


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
