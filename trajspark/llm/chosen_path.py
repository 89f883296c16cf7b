"""N-gram Jaccard join by chosen paths (operator 5).

Texts become sets of hashed word n-grams, and every set a row of 128 minimum
hashes ("tokens"; two sets share a token as often as their Jaccard similarity
says).  A run starts at a root and splits the sets on sampled tokens: sets that
agree on a sampled token go to one child.  Children that are small enough are
compared by brute force; the others are split again on tokens sampled by their
own path.  Runs repeat until a pair at the threshold is met with the target
recall.  What still is large at the last level, such as thousands of near copies,
is compared in blocks, so no task holds it whole.

A pair that meets more than once is compared in the smallest node that both sets
share, and there by its exact similarity over the whole sets.  Equal sets are one
class from the start.  Tasks give out, per document, its number of links and one
edge to the smallest document it hangs together with there; pairs never become rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trajspark.llm.common import Rows, shuffle_partitions, slices, written

TOKENS = 128
#: Bytes of text that are hashed in one go.
CHUNK = 1 << 20
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = _RANDOM.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_XOR = _RANDOM.integers(0, 1 << 32, TOKENS, dtype=np.uint32)
_MUL = _RANDOM.integers(0, 1 << 32, TOKENS, dtype=np.uint32) | np.uint32(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``n``-word windows (of all its words, if fewer).

    Words are runs without white space (space, tab to carriage return), lower-cased.
    """
    at = 0
    while at < len(texts):
        raws, size = [], 0
        while at < len(texts) and (not raws or size < CHUNK):
            raws.append((texts[at] or "").lower().encode())
            size += len(raws[-1])
            at += 1
        b = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)
        space = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        power = np.full(len(b), _BASE)
        power[0] = 1
        power = np.multiply.accumulate(power)
        total = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power)])
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        inverse = np.full(len(b), back)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        words = _mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
        ends = np.cumsum([len(r) + 1 for r in raws]) + 1
        last = np.searchsorted(start, ends)
        first = 0
        for stop in last:
            w = words[first:stop]
            k = min(n, len(w))
            first = stop
            if not k:
                yield w
                continue
            h = np.zeros(len(w) - k + 1, np.uint64)
            for j in range(k):
                h += _mixed(w[j:len(w) - k + 1 + j] * _MIX[j % 16] + np.uint64(j))
            yield np.unique(_mixed(h + np.uint64(k)))


def signature(s: np.ndarray) -> np.ndarray:
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, ((x[at:at + 2048, None] ^ _XOR) * _MUL).min(0), out=out)
    return out


def survival(similarity: float, levels: int) -> float:
    """Chance that a pair of this similarity still shares a node after so many levels of one run:
    a node samples one token, and every fourth node two."""
    s = 1.0
    for _ in range(levels):
        q = similarity * s
        s = 0.75 * q + 0.25 * (1 - (1 - q) ** 2)
    return s


def runs_for(similarity: float, levels: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, levels)))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _roots(runs: int) -> list[tuple[int, int]]:
    """(run, token) of every root: two tokens in each fourth run, none twice while they last."""
    order = np.random.Generator(np.random.PCG64(7)).permutation(TOKENS)
    out = [(r, k) for r in range(runs) for k in range(2 if r % 4 == 3 else 1)]
    return [(r, int(order[i % TOKENS])) for i, (r, _) in enumerate(out)]


def _sketches(docs: DataFrame, id_col: str, text_col: str, n: int, runs: int) -> DataFrame:
    roots = _roots(runs)
    positions = np.array([p for _, p in roots])
    salts = np.array([r * 1009 + p for r, p in roots], np.uint64) << np.uint64(32)
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()),
                        ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches):
        rows = Rows(schema)
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            for doc, s in zip(part.column(0).to_pylist(), shingle_sets(texts, n)):
                if not len(s):
                    rows.add(doc, None, 0, [], None)
                    continue
                sig = signature(s)
                keys = _signed(_mixed(sig[positions].astype(np.uint64) | salts))
                rows.add(doc, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), keys.tolist(),
                         (sig & np.uint32(0xFF)).astype(np.uint8).tobytes())
            if rows.ready():
                yield rows.take()
        yield from rows.rest()

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, digest binary, n long, keys array<long>, sketch binary")


def _leaves(classes: DataFrame, levels: int, small: int) -> DataFrame:
    """``rep, key, members`` of the nodes that are compared: small ones, and all of the last level."""
    nodes = written(classes.select("rep", F.explode("keys").alias("key")), "path-nodes")
    leaves = None
    for level in range(1, levels + 1):
        counts = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
        met = written(nodes.join(counts, "key"), "path-level")
        done = met if level == levels else met.where(F.col("members") <= small)
        leaves = done if leaves is None else leaves.unionByName(done)
        large = met.where(F.col("members") > small)
        if level == levels or large.isEmpty():
            break
        mark = lambda salt: F.xxhash64("key", F.lit(salt))
        tokens = F.when(F.pmod(mark("two"), F.lit(4)) == 0, F.array(
            F.pmod(mark("first"), F.lit(TOKENS)), F.pmod(mark("second"), F.lit(TOKENS)))).otherwise(
            F.array(F.pmod(mark("first"), F.lit(TOKENS))))
        nodes = written(large.join(classes.select("rep", "sketch"), "rep").select(
            "rep", "key", "sketch", F.explode(F.array_distinct(tokens)).alias("p")).select(
            "rep", F.xxhash64("key", "p", F.expr("substring(sketch, CAST(p + 1 AS INT), 1)")).alias("key")), "path-nodes")
    return leaves


_GROUP = ("key", "b1", "b2")


def _compared(rows: DataFrame, threshold: float, n: int, exact: bool) -> DataFrame:
    """Rows of one node (or pair of blocks) stand side by side; compare them.

    Without texts: the rows that have a likely partner here.  With texts: links and edges.
    """
    least = int(TOKENS * threshold - 5 * math.sqrt(TOKENS * threshold * (1 - threshold)))

    def likely(key, b1, b2, block, size, sketch, keys):
        """Pairs (i, j) that sizes and tokens allow and that no smaller common node has."""
        if b1 == b2:
            left = right = np.arange(len(size))
        else:
            left, right = np.flatnonzero(block == b1), np.flatnonzero(block == b2)
        if not len(left) or not len(right):
            return left[:0], right[:0]
        a, b = size[left][:, None], size[right][None, :]
        ok = np.minimum(a, b) >= threshold * np.maximum(a, b)
        if b1 == b2:
            ok &= left[:, None] < right[None, :]
        i, j = np.nonzero(ok)
        hit = np.empty(len(i), bool)
        for at in range(0, len(i), 8192):
            x, y = left[i[at:at + 8192]], right[j[at:at + 8192]]
            hit[at:at + 8192] = (sketch[x] == sketch[y]).sum(1) >= least
        i, j = left[i[hit]], right[j[hit]]
        if not len(i):
            return i, j
        used = np.unique(np.concatenate([i, j]))
        smaller = [k[k < key] for k in (keys[u] for u in used)]
        names, place = np.unique(np.concatenate(smaller), return_inverse=True)
        has = np.zeros((len(used), len(names)), np.float32)
        has[np.repeat(np.arange(len(used)), [len(k) for k in smaller]), place] = 1
        shared = has @ has.T
        new = shared[np.searchsorted(used, i), np.searchsorted(used, j)] == 0
        return i[new], j[new]

    def groups(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            k = [t.column(c).to_numpy() for c in _GROUP]
            cut = np.flatnonzero((k[0][1:] != k[0][:-1]) | (k[1][1:] != k[1][:-1]) | (k[2][1:] != k[2][:-1])) + 1
            last = int(cut[-1]) if len(cut) else 0
            held = t.slice(last)
            if last:
                yield t.slice(0, last), [0, *cut.tolist()]
        if held is not None and held.num_rows:
            yield held, [0, held.num_rows]

    def run(batches):
        schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        for t, cut in groups(batches):
            t = t.combine_chunks()
            key, b1, b2, block, rep, size, weight = (t.column(c).to_numpy() for c in
                                                     ("key", "b1", "b2", "block", "rep", "n", "weight"))
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, TOKENS)
            lists = t.column("keys").combine_chunks()
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            keep: list[int] = []
            out = ([], [], [])
            for lo, hi in zip(cut, cut[1:]):
                if hi - lo < 2:
                    continue
                keys = [flat[offsets[x]:offsets[x + 1]] for x in range(lo, hi)]
                i, j = likely(key[lo], b1[lo], b2[lo], block[lo:hi], size[lo:hi], sketch[lo:hi], keys)
                other = rep[lo:hi][i] != rep[lo:hi][j]
                i, j = i[other], j[other]
                if not len(i):
                    continue
                if not exact:
                    keep.extend((np.unique(np.concatenate([i, j])) + lo).tolist())
                    continue
                i, j = _exact_pairs(t.column("text").slice(lo, hi - lo), i, j, threshold, n)
                if len(i):
                    links = np.bincount(i, weight[lo:hi][j], hi - lo) + np.bincount(j, weight[lo:hi][i], hi - lo)
                    root = _local_roots(hi - lo, i, j, rep[lo:hi])
                    on = np.flatnonzero(links)
                    for column, x in zip(out, (rep[lo:hi][on], links[on].astype(np.int64), root[on])):
                        column.append(x)
            if exact:
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], schema=schema)
            elif keep:
                yield from t.take(pa.array(keep)).to_batches()

    placed = rows.repartition(shuffle_partitions(rows.sparkSession), *_GROUP).sortWithinPartitions(*_GROUP, "rep")
    return placed.mapInArrow(run, "rep long, links long, root long" if exact else rows.schema)


def _exact_pairs(texts, i, j, threshold, n):
    """The pairs whose whole sets reach the threshold."""
    used = np.unique(np.concatenate([i, j]))
    sets = dict(zip(used.tolist(), shingle_sets(texts.take(pa.array(used)).to_pylist(), n)))
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    good = np.zeros(len(i), bool)
    at = 0
    while at < len(i):
        stop = int(np.searchsorted(i, i[at], "right"))
        own = sets[int(i[at])]
        while at < stop:  # partners of one set in portions of bounded size
            some, size = [], 0
            while at + len(some) < stop and (not some or size < 1 << 20):
                some.append(sets[int(j[at + len(some)])])
                size += len(some[-1])
            flat = np.concatenate(some)
            place = np.searchsorted(own, flat)
            same = own[np.minimum(place, len(own) - 1)] == flat
            lens = np.array([len(s) for s in some])
            both = np.add.reduceat(same.astype(np.int64), np.concatenate([[0], np.cumsum(lens)[:-1]]))
            good[at:at + len(some)] = both >= threshold * (len(own) + lens - both) - 1e-9
            at += len(some)
    return i[good], j[good]


def _local_roots(n, i, j, rep):
    """Smallest document that each one hangs together with, by these pairs."""
    root = rep.copy()
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``v, label``: the smallest vertex each vertex of ``edges (u, v)`` is connected to.

    Every round takes the smallest label around a vertex and then that label's own
    label; rounds are written to the shared folder.
    """
    both = written(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("v"), F.least("u", "m").alias("label")), "labels")
    for _ in range(max_rounds):
        around = both.join(labels, "v").groupBy("u").agg(F.min("label").alias("m")).withColumnRenamed("u", "v")
        low = written(labels.join(around, "v").select("v", F.least("label", "m").alias("low"), "label"), "labels")
        up = low.select(F.col("v").alias("low"), F.col("low").alias("up"))
        new = written(low.join(up, "low", "left").select(
            "v", F.least("low", F.coalesce("up", "low")).alias("label"), F.col("label").alias("old")), "labels")
        labels = new.select("v", "label")
        if new.where("label <> old").isEmpty():
            return labels
    raise RuntimeError("labels did not settle")


def similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8,
            recall: float = 0.9999, levels: int = 3, small: int = 256, block: int = 128) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, n_links, rep_id``.

    ``n_links``: other documents whose n-gram sets have a Jaccard similarity of at
    least ``threshold``; ``class_id``: the smallest id it is linked to, over any number
    of links (its own, if none); ``rep_id``: the smallest id with an equal set.  Links
    are exact.  ``recall`` sets the runs as if each had minimum hashes of its own; as all
    share one row of 128, a pair at 0.8 that passes all three levels is missed with
    probability 2.4e-4, not 1e-4 (2.6e-5 at 0.85), averaged over that row.

    Null, empty and blank texts have no n-grams and no links.  A row without an id
    takes no part (``class_id`` null, no links); rows that share an id are one document
    with the links of all its texts.  An empty table gives no rows; other columns
    are not read.  Texts of any length are compared whole.
    """
    runs = runs_for(threshold, levels, recall)
    sets = written(_sketches(docs, id_col, text_col, n, runs), "sketches")
    classes = written(sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.any_value("n").alias("n"),
        F.any_value("keys").alias("keys"), F.any_value("sketch").alias("sketch")), "classes")
    leaves = _leaves(classes, levels, small)
    own = leaves.groupBy("rep").agg(F.collect_list(F.struct("key", "members")).alias("nodes"))
    placed = own.join(classes.select("rep", "weight", "n", "sketch"), "rep").select(
        "rep", "weight", "n", "sketch", F.col("nodes.key").alias("keys"), F.explode("nodes").alias("node"))
    blocks = F.when(F.col("node.members") > small, F.ceil(F.col("node.members") / block)).otherwise(1).cast("int")
    placed = placed.select("*", F.col("node.key").alias("key"), blocks.alias("m")).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("m")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    placed = placed.select("key", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"),
                           "block", "rep", "weight", "n", "sketch", "keys")
    near = written(_compared(placed, threshold, n, False), "near")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("rep"), F.col(f"`{text_col}`").cast("string").alias("text"))
    linked = written(_compared(near.join(texts, "rep"), threshold, n, True), "linked")
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(linked.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    found = classes.select("digest", "rep", "weight").join(links, "rep", "left").join(
        labels.withColumnRenamed("v", "rep"), "rep", "left").withColumnRenamed("digest", "of")
    out = sets.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(
        found, F.col("digest") == F.col("of"), "left")
    return out.select("doc_id", F.coalesce("label", "rep", "doc_id").alias("class_id"),
                      (F.coalesce("weight", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                      F.coalesce("rep", "doc_id").alias("rep_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", **kwargs) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their class, with all columns; rows without an id stay."""
    gone = written(similar(docs, id_col=id_col, **kwargs).where("doc_id <> class_id").select("doc_id").distinct(), "near-copies")
    return docs.join(gone.withColumnRenamed("doc_id", "__gone"), F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
