"""Token-id shards with Elias-Fano document boundaries (operator 6).

A shard is two files.  ``shard-NNNNN.ids`` is the concatenation of all ids, 16 or
32 bits each.  ``shard-NNNNN.ef`` holds two Elias-Fano coded non-decreasing
lists: the document boundaries and the document ids.  A list of n values up to u
takes about 2 + log2(u / n) bits a value: the low bits packed, the high bits as a
unary bit vector, and the place of every 256th one as a 32-bit select sample, so
one offset is found without a table of 64-bit offsets.  Shards are in ascending
id order; the ids before each shard are a running sum of the shards' totals.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from trajspark.llm.bpe_tokens import encoder
from trajspark.llm.common import Rows, commit_file, shuffle_partitions, slices, storage

SAMPLE = 256
_HEAD = struct.Struct("<4sQqB")  # magic, values, smallest value, low bits
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


class EliasFano:
    """A non-decreasing list of integers; ``select`` finds one, ``values`` decodes a stretch."""

    def __init__(self, n: int, least: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.least, self.low_bits = n, least, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        if not len(v):
            return cls(0, 0, 0, np.empty(0, np.uint8), np.empty(0, np.uint8), np.empty(0, "<u4"))
        least = int(v[0])
        v = (v.astype(np.uint64) - np.uint64(least & (1 << 64) - 1))
        bits = max(0, int(v[-1]) // len(v)).bit_length() - 1
        bits = max(0, bits)
        step = 1 << 16  # values at a time; a multiple of eight, so packed stretches join
        low = [np.packbits((v[at:at + step, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(),
                           bitorder="little") for at in range(0, len(v), step)]
        places = (v >> np.uint64(bits)).astype(np.int64) + np.arange(len(v))
        high = np.zeros(int(places[-1]) + 1, np.uint8)
        high[places] = 1
        return cls(len(v), least, bits, np.concatenate(low),
                   np.packbits(high, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def dump(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()]
        return (_HEAD.pack(b"EFB1", self.n, self.least, self.low_bits)
                + struct.pack("<3Q", *map(len, parts)) + b"".join(parts))

    @classmethod
    def load(cls, raw: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The list coded at byte ``at``, and where the next one begins."""
        magic, n, least, bits = _HEAD.unpack_from(raw, at)
        if magic != b"EFB1":
            raise ValueError("not an Elias-Fano list")
        at += _HEAD.size
        sizes = struct.unpack_from("<3Q", raw, at)
        at += 24
        parts = []
        for size in sizes:
            if at + size > len(raw):
                raise ValueError("the list is cut short")
            parts.append(raw[at:at + size])
            at += size
        return cls(n, least, bits, np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], np.uint8),
                   np.frombuffer(parts[2], "<u4")), at

    def select(self, i: int) -> int:
        """Value i: from the nearest sample on, count ones in the high bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        while left:
            byte = self.high[(at + 1) // 8:(at + 1) // 8 + 64 + SAMPLE // 2]
            ones = np.flatnonzero(np.unpackbits(byte, bitorder="little")) + (at + 1) // 8 * 8
            ones = ones[ones > at][:left]
            if len(ones):
                at, left = int(ones[-1]), left - len(ones)
            else:
                at = ((at + 1) // 8 + len(byte)) * 8 - 1
        first = i * self.low_bits
        raw = int.from_bytes(self.low[first // 8:(first + self.low_bits + 7) // 8].tobytes(), "little")
        low = raw >> first % 8 & (1 << self.low_bits) - 1
        return (at - i << self.low_bits) + low + self.least

    def values(self, first: int, last: int) -> np.ndarray:
        """Values ``first`` to ``last`` (exclusive), decoded from the select samples around them only."""
        if first >= last:
            return np.empty(0, np.int64)
        k, stop = first // SAMPLE, -(-last // SAMPLE)
        lo, hi = k * SAMPLE, min(self.n, stop * SAMPLE)
        at, end = int(self.samples[k]), int(self.samples[stop]) if stop < len(self.samples) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at // 8:-(-end // 8)], bitorder="little")) + at // 8 * 8
        ones = ones[np.searchsorted(ones, at):][:hi - lo]
        v = (ones - np.arange(lo, hi)) << self.low_bits
        if self.low_bits:
            bit = lo * self.low_bits  # a sample starts a byte, as SAMPLE is a multiple of eight
            bits = np.unpackbits(self.low[bit // 8:-(-hi * self.low_bits // 8)], bitorder="little", count=(hi - lo) * self.low_bits)
            v = v + bits.reshape(hi - lo, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return v[first - lo:last - lo] + self.least

    def rank(self, value: int) -> int:
        """How many values are smaller, by binary search through ``select``."""
        lo, hi = 0, self.n
        while lo < hi:
            middle = (lo + hi) // 2
            lo, hi = (middle + 1, hi) if self.select(middle) < value else (lo, middle)
        return lo


@dataclass(frozen=True)
class Store:
    """Where the shards are; per shard: name, documents without id, documents, ids, and both before it;
    and the smallest and largest id of each (both null if no document there has one)."""
    folder: str
    width: int
    shards: tuple[tuple[str, int, int, int, int, int], ...]
    spans: tuple[tuple[int | None, int | None], ...]


def write_store(docs: DataFrame, tokenizer: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text",
                end_id: int = 0, width: int = 2, partitions: int | None = None) -> Store:
    """Encode every whole text and write the shards in ascending id order.

    A null text is empty (its only id is ``end_id``).  Documents without an id come
    first; rows with one id stay side by side, in the order of a hash of their ids.  An empty table
    writes no shard.  ``width``: bytes per id, 2 for vocabularies up to 65,536 ids.
    Only one row per shard reaches the driver.
    """
    if width not in (2, 4):
        raise ValueError("width is 2 or 4 bytes")
    system, root = storage(folder)
    system.create_dir(root, recursive=True)
    end = int(end_id).to_bytes(4, "little")

    n = partitions or shuffle_partitions(docs.sparkSession)
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # shards are ranges of ids: quantiles from the ids alone, so no text is read or coded twice
    seen = picked.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"),
                      F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10 * n).alias("at")).first()
    blank = -(-n * (seen["n"] - seen["known"]) // max(1, seen["n"]))  # shards for documents without an id
    at = np.array((seen["at"] or []) if n > 1 else [], np.int64)

    def shard_of(ids: pa.Array, marks: np.ndarray) -> np.ndarray:
        """Shard of each document; one id that fills several shards is spread over them by the hash of the text."""
        known, values = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        lo = np.where(known, blank + np.searchsorted(at, values, "left"), 0)
        hi = np.where(known, blank + np.searchsorted(at, values, "right"), max(blank - 1, 0))
        return lo + (marks / 2.0 ** 32 * np.where(hi > lo + known, hi - lo + 1, 1)).astype(np.int64)

    def code(batches):
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            raws = [raw + end for raw in encoder(tokenizer).encode_many(texts)]
            if width == 2:
                ids = np.frombuffer(b"".join(raws), "<u4")
                if len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("an id needs more than 16 bits: use width=4")
                ends, flat = np.cumsum([0, *(len(r) // 2 for r in raws)]).tolist(), ids.astype("<u2").tobytes()
                raws = [flat[i:j] for i, j in zip(ends, ends[1:])]
            marks = np.array([zlib.crc32(r) for r in raws], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(part.column(0), marks)), part.column(0), pa.array(marks), pa.array(raws, pa.binary())],
                                             names=["shard", "doc_id", "mark", "ids"])

    def run(batches):
        attempt = TaskContext.get().taskAttemptId()
        rows = (row for part in slices(batches) for row in zip(*(part.column(c).to_pylist() for c in ("shard", "doc_id", "ids"))))
        files, path = storage(folder)
        for number, own in itertools.groupby(rows, key=lambda row: row[0]):
            ends, names = [0], []

            def fill(out):
                for _, doc, raw in own:
                    ends.append(ends[-1] + len(raw) // width)
                    if doc is not None:
                        names.append(doc)
                    out.write(raw)

            name = f"{path}/shard-{number:05d}"
            commit_file(files, f"{name}.ids", attempt, fill)
            lists = EliasFano.of(np.array(ends)).dump() + EliasFano.of(np.array(names, np.int64)).dump()
            commit_file(files, f"{name}.ef", attempt, lambda out: out.write(lists))
            yield pa.RecordBatch.from_pydict({
                "shard": [number], "nulls": [len(ends) - 1 - len(names)], "docs": [len(ends) - 1], "ids": [ends[-1]],
                "least": pa.array(names[:1] or [None], pa.int64()), "most": pa.array(names[-1:] or [None], pa.int64())})

    coded = picked.mapInArrow(code, "shard long, doc_id long, mark long, ids binary")
    ordered = coded.repartition(n, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "mark")
    made = sorted(ordered.mapInArrow(run, "shard long, nulls long, docs long, ids long, least long, most long").collect(), key=lambda r: r.shard)
    shards, spans, before = [], [], [0, 0]
    for number, nulls, n_docs, n_ids, least, most in made:
        if n_docs:
            shards.append((f"shard-{number:05d}", nulls, n_docs, n_ids, *before))
            spans.append((least, most))
        before = [before[0] + n_docs, before[1] + n_ids]
    return Store(folder, width, tuple(shards), tuple(spans))


def _lists(files, path: str, shard: tuple, width: int) -> tuple[EliasFano, EliasFano]:
    """Boundaries and document ids of a shard, checked against the store."""
    name, nulls, n_docs, n_ids, *_ = shard
    with files.open_input_file(f"{path}/{name}.ef") as f:
        raw = f.read()
    bounds, at = EliasFano.load(raw)
    names, _ = EliasFano.load(raw, at)
    if bounds.n != n_docs + 1 or names.n + nulls != n_docs or bounds.select(n_docs) != n_ids:
        raise ValueError(f"{name}: the boundaries don't fit the shard")
    return bounds, names


def read_store(spark: SparkSession, store: Store, *, ids_at_once: int = 1 << 20) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, from the files alone (``start``: the
    ids of all documents before it; ``ids``: little-endian unsigned 32-bit integers)."""

    def run(batches):
        files, path = storage(store.folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name, nulls, n_docs, n_ids, _, base = store.shards[k]
                bounds, names = _lists(files, path, store.shards[k], store.width)
                rows = Rows(_DOCS)
                with files.open_input_file(f"{path}/{name}.ids") as f:
                    if f.size() != store.width * n_ids:
                        raise ValueError(f"{name}: {f.size()} bytes for {n_ids} ids")
                    for block in range(0, n_docs, SAMPLE):
                        stop = min(n_docs, block + SAMPLE)
                        ends = bounds.values(block, stop + 1)
                        own_names = [None] * max(0, min(nulls, stop) - block) + names.values(
                            max(0, block - nulls), max(0, stop - nulls)).tolist()
                        first = 0
                        while first < stop - block:
                            last = max(first + 1, int(np.searchsorted(ends, ends[first] + ids_at_once, "right")) - 1)
                            got = f.read_at(store.width * int(ends[last] - ends[first]), store.width * int(ends[first]))
                            ids = np.frombuffer(got, f"<u{store.width}").astype("<u4", copy=False)
                            for i in range(first, last):
                                own = ids[ends[i] - ends[first]:ends[i + 1] - ends[first]].tobytes()
                                rows.add(own_names[i], base + int(ends[i]), len(own) // 4, own, weight=len(own))
                                if rows.ready():
                                    yield rows.take()
                            first = last
                yield from rows.rest()

    n = len(store.shards)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def look_up(store: Store, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of the documents whose id stands in ``wanted`` (once each, however often it does).

    A shard's ids are searched by rank, its boundaries by select; only the documents found are read.  Ids that no shard
    has give no row, a null id matches none.
    """
    spark = wanted.sparkSession
    some = [k for k, (least, _) in enumerate(store.spans) if least is not None]
    least, most = (np.array([store.spans[k][x] for k in some], np.int64) for x in (0, 1))

    def place(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lo, hi = np.searchsorted(most, ids, "left"), np.searchsorted(least, ids, "right")
            times = np.maximum(hi - lo, 0)
            which = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(some, np.int64)[which]), pa.array(np.repeat(ids, times))], names=["shard", "doc_id"])

    def run(batches):
        files, path = storage(store.folder)
        held, rows = None, Rows(_DOCS)
        for batch in batches:
            for k, doc in zip(*(c.to_pylist() for c in batch.columns)):
                if k != held:
                    held, (bounds, names) = k, _lists(files, path, store.shards[k], store.width)
                    name, nulls, _, _, _, base = store.shards[k]
                at = names.rank(doc)
                while at < names.n and names.select(at) == doc:
                    start, end = bounds.select(nulls + at), bounds.select(nulls + at + 1)
                    with files.open_input_file(f"{path}/{name}.ids") as f:
                        own = np.frombuffer(f.read_at(store.width * (end - start), store.width * start), f"<u{store.width}").astype("<u4").tobytes()
                    rows.add(doc, base + start, end - start, own, weight=len(own))
                    at += 1
                if rows.ready():
                    yield rows.take()
        yield from rows.rest()

    ids = wanted.select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    placed = ids.mapInArrow(place, "shard long, doc_id long").repartition(shuffle_partitions(spark), "shard", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    return placed.sortWithinPartitions("shard", "doc_id").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
