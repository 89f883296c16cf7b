"""Near copies by an inverted join of signature coordinates (operator 12).

Texts become sets of hashed word windows, and each distinct set a signature of
minimum hashes.  A set is posted under every (coordinate, value) pair of the first
64.  Two sets at the threshold agree on at least ``T`` of them but for a stated chance, so:

* a set of which fewer than T pairs occur anywhere else has no partner;
* of the others only the rarest pairs are kept, the prefix: two signatures that
  agree T times share a pair within their 64 - T + 1 rarest ones.  Pairs that come
  from passages which many documents carry are frequent, hence rarely in a prefix.

Collisions are counted over 256 coordinates of one byte, in two stages; the second
skips what hangs together after the first.  First each set against the hubs of its
posting lists (the sets whose values occur most: originals rather than copies); the
greatest one that collides often enough is confirmed on whole sets.  Then, in the
lists whose sets still carry different labels, the sets outside the hub's label
against all others, block by block; two sets of one label need no comparison, as a
further link between them changes no component.  So a list of N copies of one
original costs N comparisons.  N sets that resemble each other but are linked with
nothing are compared pair by pair, as each pair has to be ruled out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from trajspark.llm.chosen_path import components
from trajspark.llm.common import Rows, shuffle_partitions, slices, written
from trajspark.operators.joins import is_small

#: Minimum hashes that are posted, and those of one byte each on which collisions are counted.
COORDINATES, FINE = 64, 256
#: Bytes hashed in one go; partners checked by one task at a time; sets of a posting list compared in one go.
CHUNK, PARTNERS, BLOCK = 1 << 20, 256, 512
_RANDOM = np.random.Generator(np.random.PCG64(85))
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RANDOM.integers(0, 1 << 32, FINE, dtype=np.uint32)
_MUL = _RANDOM.integers(0, 1 << 31, FINE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_SMALL = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.multiply.accumulate(np.concatenate(
                [np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _pieces(raw: bytes) -> Iterator[bytes]:
    """``raw`` in pieces of about CHUNK bytes that end at white space."""
    at = 0
    while len(raw) - at > CHUNK:
        blank = np.flatnonzero(_BLANK[np.frombuffer(raw, np.uint8, CHUNK, at)])
        end = at + CHUNK
        if len(blank):
            end = at + int(blank[-1]) + 1
        else:  # a word longer than a piece stays whole
            while end < len(raw) and not _BLANK[raw[end]]:
                end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word (no space, tab to carriage return inside), A-Z lower-cased."""
    out = []
    for piece in _pieces(text.encode().translate(_SMALL)):
        b = np.frombuffer(b" " + piece + b" ", np.uint8)
        blank = _BLANK[b]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        up, down = _POWERS.first(len(b))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up)])
        out.append(_mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
    return np.concatenate(out)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's ``n``-word windows; of all its words, if fewer; none without words."""
    words = word_hashes(text or "")
    k = min(n, len(words))
    if not k:
        return words
    m = len(words) - k + 1
    h = np.full(m, k, np.uint64)
    for j in range(k):
        h += _mixed(words[j:j + m] * _PLACE[j % 16] + np.uint64(j))
    return np.unique(_mixed(h))


def signature(s: np.ndarray) -> np.ndarray:
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    out = np.full(FINE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(out, ((x[at:at + 512, None] ^ _XOR) * _MUL).min(0), out=out)
    return out


def least_matches(threshold: float, miss: float, coordinates: int = COORDINATES) -> int:
    """Largest T such that a pair at the threshold agrees on fewer than T coordinates with chance ``miss`` at most."""
    below = 0.0
    for t in range(coordinates + 1):
        below += math.comb(coordinates, t) * threshold ** t * (1 - threshold) ** (coordinates - t)
        if below > miss:
            return t
    return coordinates


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sets(docs: DataFrame, n: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("sig", pa.list_(pa.int32())),
                        ("fine", pa.binary())])

    def run(batches):
        rows = Rows(schema)
        for part in slices(batches):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                s = shingles(text, n)
                if len(s):
                    sig = signature(s)
                    rows.add(doc, _digest(s), len(s), sig[:COORDINATES].view(np.int32), (sig & np.uint32(0xFF)).astype(np.uint8).tobytes())
                else:
                    rows.add(doc, None, 0, None, None)
            if rows.ready():
                yield rows.take()
        yield from rows.rest()

    return docs.mapInArrow(run, "doc_id long, digest binary, n long, sig array<int>, fine binary")


def _postings(classes: DataFrame, least: int) -> DataFrame:
    """``key, rep, hub`` (``rep``: number of a distinct set; ``hub``: how often its values occur in all): the prefix of each set that can have a partner, rarest coordinate values first."""
    pairs = classes.select("rep", F.posexplode("sig").alias("c", "value")).select(
        "rep", F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(0xFFFFFFFF)).alias("key"))
    often = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    own = W.partitionBy("rep")
    met = pairs.join(often, "key").select(
        "key", "rep", F.row_number().over(own.orderBy("often", "key")).alias("at"), F.count(F.lit(1)).over(own).alias("met"),
        F.sum("often").over(own).alias("hub"))
    return met.where(f"met >= {least} AND at <= met - {least} + 1").select("key", "rep", "hub")


def _fine(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), FINE)


def _stars(postings: DataFrame, classes: DataFrame, least: int, low: float) -> DataFrame:
    """``a, b``: each set ``b`` with the greatest hub of its lists that it collides with ``least`` times.

    The original of a group of copies shares more values than any copy, so it is their hub.
    """
    top = postings.groupBy("key").agg(F.max(F.struct("hub", F.negative("rep").alias("m"))).alias("top"))
    pairs = postings.join(top, "key").where("rep <> -top.m").select("top", F.col("rep").alias("b")).distinct()

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                same = (_fine(batch.column("fine_a")) == _fine(batch.column("fine_b"))).sum(1)
                yield batch.select(["hub", "a", "b"]).filter(pa.array(same >= least))

    sides = [classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("fine").alias(f"fine_{x}")) for x in "ab"]
    both = pairs.select("top.hub", F.negative("top.m").alias("a"), "b").join(sides[0], "a").join(sides[1], "b")
    both = both.where(f"least(n_a, n_b) >= {low} * greatest(n_a, n_b) - 1e-9").select("hub", "a", "b", "fine_a", "fine_b")
    near = both.mapInArrow(run, "hub long, a long, b long")
    return near.groupBy("b").agg(F.max(F.struct("hub", F.negative("a").alias("m"))).alias("top")).select(F.negative("top.m").alias("a"), "b")


def _with_text(rows: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` (with ``rep``) with ``digest`` and ``text``; every row of a document that has the id of the set."""
    asked = written(rows.join(classes.select("rep", "doc", "digest"), "rep"), "asked")
    texts, wanted = docs.withColumnRenamed("doc_id", "doc"), asked.select("doc").distinct()
    if is_small(wanted):  # then texts that nobody asks for stay out of the shuffle
        texts = texts.join(F.broadcast(wanted), "doc", "left_semi")
    return asked.join(texts, "doc").drop("doc")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Of ``pairs`` (``a, b``) those whose whole sets reach the threshold.

    Everything for one ``a`` would be a hot group: its pairs are dealt out in chunks of PARTNERS, and each chunk
    gets one copy of the text of ``a``, which comes first in the sort.
    """
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("chunks"))
    first = size.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("b"),
                        F.col("a").alias("rep"))
    others = pairs.join(size, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "b", F.col("b").alias("rep"))
    rows = _with_text(first.unionByName(others), classes, docs)

    def run(batches):
        at, own = None, None
        for part in slices(batches):
            columns = (part.column(c).to_pylist() for c in ("a", "chunk", "b", "digest", "text"))
            out_a, out_b = [], []
            for a, chunk, b, digest, text in zip(*columns):
                if (a, chunk) != at:
                    at, own = (a, chunk), None
                if b is None and own is not None:
                    continue
                s = shingles(text, n)
                if _digest(s) != digest:
                    continue  # another row with the same id
                if b is None:
                    own = s
                    continue
                both = len(np.intersect1d(own, s, assume_unique=True))
                if den * both >= num * (len(own) + len(s) - both):
                    out_a.append(a)
                    out_b.append(b)
            if out_a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    placed = rows.select("a", "chunk", "b", "digest", "text").repartition(shuffle_partitions(docs.sparkSession), "a", "chunk")
    return written(placed.sortWithinPartitions("a", "chunk", F.asc_nulls_first("b")).mapInArrow(run, "a long, b long"), "links")


def _labelled(rows: DataFrame, labels: DataFrame, of: str, name: str) -> DataFrame:
    """``rows`` with the label of column ``of`` (itself, if it has no links yet)."""
    own = labels.select(F.col("v").alias(of), F.col("label").alias(name))
    return rows.join(own, of, "left").withColumn(name, F.coalesce(name, of))


_GROUP = ("key", "r", "b")


def _visits(postings: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Sets of the lists with several labels, once for each pair of blocks (``r`` of the rest, ``b`` of all) that they are in.

    Lists of one label are skipped.  In the others the sets outside the label of the list's hub are the rest; a block
    of the rest meets a block of all, so a group holds two blocks at most.
    """
    lists = _labelled(postings, labels, "rep", "label")
    per = lists.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("hub", F.negative("rep").alias("m"))).alias("hub"))
    kept = per.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("labels"), F.max(F.struct("hub", "label", "size")).alias("top"))
    kept = kept.where("labels > 1").select("key", F.col("top.label").alias("main"), F.ceil(F.col("size") / BLOCK).cast("int").alias("bs"),
                                           F.ceil((F.col("size") - F.col("top.size")) / BLOCK).cast("int").alias("rs"))
    rows = lists.join(kept, "key").withColumn("rest", F.col("label") != F.col("main"))
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = ["key", "rep", "label", "rest"]
    probes = rows.where("rest").select(*base, F.lit(True).alias("probe"), place("rs").alias("r"), every("bs").alias("b"))
    targets = rows.select(*base, F.lit(False).alias("probe"), every("rs").alias("r"), place("bs").alias("b"))
    own = postings.groupBy("rep").agg(F.collect_list("key").alias("keys"))  # a prefix
    return probes.unionByName(targets).join(classes.select("rep", "n", "fine").join(own, "rep"), "rep")


def _likely(t: pa.RecordBatch, least: int, low: float) -> list[tuple[int, int, int]]:
    """(collisions, row, row) of the pairs of probe and target in a group that may be linked and meet in no smaller list."""
    rep, label, size = (t.column(c).to_numpy() for c in ("rep", "label", "n"))
    rest, probe = (t.column(c).to_numpy(zero_copy_only=False) for c in ("rest", "probe"))
    key, keys, fine, out = t.column("key")[0].as_py(), t.column("keys").to_pylist(), _fine(t.column("fine")), []
    target = np.flatnonzero(~probe)
    for i in np.flatnonzero(probe):
        # two of the rest meet twice: the smaller one counts as the probe
        j = target[(label[target] != label[i]) & (~rest[target] | (rep[target] > rep[i]))
                   & (np.minimum(size[target], size[i]) >= low * np.maximum(size[target], size[i]) - 1e-9)]
        same = (fine[j] == fine[i]).sum(1)
        mine = set(keys[i])
        out += [(int(c), int(i), int(k)) for c, k in zip(same[same >= least], j[same >= least]) if min(mine.intersection(keys[k])) == key]
    return out


def _groups(batches) -> Iterator[pa.RecordBatch]:
    """Rows of one group each, from rows sorted by it."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        at = np.stack([t.column(c).to_numpy() for c in _GROUP])
        cut = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist()]
        for lo, hi in zip(cut, cut[1:]):
            yield t.slice(lo, hi - lo).combine_chunks().to_batches()[0]
        held = t.slice(cut[-1])
    if held is not None:
        yield held.combine_chunks().to_batches()[0]


def _apart(postings: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, least: int, n: int, num: int, den: int) -> DataFrame:
    """Links (``a, b``) between sets of one posting list that carry different labels.

    A first pass keeps the rows of each group that have a likely partner there; only they get their texts.  Pairs
    never become rows: a task gives out the links that join what it hadn't joined before, the likeliest pairs first.
    """
    low = num / den

    def keep(batches):
        for group in _groups(batches):
            rows = sorted({x for _, i, k in _likely(group, least, low) for x in (i, k)})
            if rows:
                yield group.take(pa.array(rows))

    def confirm(batches):
        for group in _groups(batches):
            sets = [shingles(x, n) for x in group.column("text").to_pylist()]
            fine = [_digest(s) == d for s, d in zip(sets, group.column("digest").to_pylist())]
            reps, root, out = group.column("rep").to_pylist(), {}, []

            def top(x):
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for _, i, k in sorted(_likely(group, least, low), reverse=True):
                a, b = top(reps[i]), top(reps[k])
                if a != b and fine[i] and fine[k]:
                    both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                    if den * both >= num * (len(sets[i]) + len(sets[k]) - both):
                        root[max(a, b)] = min(a, b)
                        out.append((reps[i], reps[k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    parts = shuffle_partitions(postings.sparkSession)
    placed = lambda df: df.repartition(parts, *_GROUP).sortWithinPartitions(*_GROUP, "rep")
    visits = _visits(postings, labels, classes)
    near = written(placed(visits).mapInArrow(keep, visits.schema), "near")
    return written(placed(_with_text(near, classes, docs)).mapInArrow(confirm, "a long, b long"), "links")


def _same_id(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (``a, b``) between the classes of ids that stand for several texts."""
    own = sets.where("n > 0 AND doc_id IS NOT NULL")
    several = own.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    reps = own.join(several, "doc_id").join(classes.select("digest", "rep"), "digest").select("doc_id", "rep").distinct()
    return reps.join(reps.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 85, den: int = 100,
                miss: float = 1e-6) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if ``den`` * intersection >= ``num`` * union of their sets of distinct ``n``-word windows
    (words: no space, tab to carriage return; A-Z lower-cased; a shorter text is one window).  ``component_id`` is
    the smallest id reachable over links, ``kept`` whether that is the row's own.  Links are exact; a link at the
    threshold goes unseen with chance ``miss`` at most, if minimum hashes agree independently, and the more alike two
    sets are, the less.

    Null, empty and blank texts have no windows and no links.  A row without an id takes no part (``component_id``
    null, ``kept`` true).  Rows that share an id are one document with the links of all its texts.  An empty table gives no
    rows; other columns are not read.  Texts of any length are compared whole.
    """
    low, least = num / den, least_matches(num / den, miss / 2, FINE)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sets = written(_sets(docs, n), "coordinate-sets")
    classes = written(sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("doc"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"), F.any_value("fine").alias("fine")).withColumn(
        "rep", F.monotonically_increasing_id()), "coordinate-classes")
    postings = written(_postings(classes, least_matches(num / den, miss / 2)), "postings")
    links = _confirmed(_stars(postings, classes, least, low), classes, docs, n, num, den)
    up = links.select(F.col("b").alias("v"), F.col("a").alias("label"))  # one link each, to a greater hub: a forest
    for _ in range(2):
        up = up.join(up.select(F.col("v").alias("label"), F.col("label").alias("higher")), "label", "left").select(
            "v", F.coalesce("higher", "label").alias("label"))
    apart = _apart(postings, written(up, "labels"), classes, docs, least, n, num, den)
    links = _same_id(sets, classes).unionByName(links).unionByName(apart)
    labels = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = _labelled(classes.select("digest", "doc", "rep"), labels, "rep", "label")
    smallest = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    found = named.join(smallest, "label").select(F.col("digest").alias("of"), "component_id")
    known = sets.where("doc_id IS NOT NULL").join(found, F.col("digest") == F.col("of"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.min(F.coalesce("component_id", "doc_id")).over(W.partitionBy("doc_id")).alias("component_id"))
    unnamed = sets.where("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return known.unionByName(unnamed).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
