"""WARC archives, one gzip member per record (operator 1).

Writing: each task writes one archive; records with equal payloads of some size
become one response and revisits that point to it.  Reading: a sequential
reader per archive inflates member after member from small chunks, cuts records
by their content length and checks block and payload digests.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from trajspark.llm.common import Rows, commit_file, slices, storage, written

#: Names and addresses of the WARC 1.1 format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fields of our own: WARC has no place for a table's key.
PAGE, REFERS_TO_PAGE = "X-Page-ID", "X-Refers-To-Page-ID"
DATE = "2000-01-01T00:00:00Z"
CHUNK = 1 << 16


class CorruptRecord(ValueError):
    """A member, header, length or digest that does not fit."""


@dataclass
class Record:
    """One record: header fields (names in lower case) and block."""
    fields: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    @property
    def kind(self) -> str:
        return self.fields.get("warc-type", "")

    def http(self) -> tuple[dict[str, str], bytes]:
        """Header fields and body of an HTTP block."""
        head, gap, body = self.block.partition(b"\r\n\r\n")
        if not gap:
            raise CorruptRecord("HTTP block without an end of its header")
        return _fields(head), body


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise CorruptRecord(f"header line without a colon: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def _line(value: str) -> str:
    """A header value on one line: line ends and percent signs before them are percent-encoded."""
    return value.replace("\r", "%0D").replace("\n", "%0A").strip()


def record_bytes(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member.  A revisit's block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}:{url}:{digest}")
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{own}>", f"WARC-Date: {DATE}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    if url is not None:
        head.insert(4, f"WARC-Target-URI: {_line(url)}")
    if page is not None:
        head.append(f"{PAGE}: {page}")
    if kind == "revisit":
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"{REFERS_TO_PAGE}: {refers_to}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def members(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """Inflated gzip members of a stream that ``read(n)`` gives out in chunks."""
    rest = read(CHUNK)
    while rest:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest:
                raise CorruptRecord("the archive ends inside a member")
            try:
                parts.append(inflate.decompress(rest))
            except zlib.error as e:
                raise CorruptRecord(f"not a gzip member: {e}") from e
            rest = inflate.unused_data if inflate.eof else read(CHUNK)
        yield b"".join(parts)
        rest = rest or read(CHUNK)


def parse(member: bytes) -> Record:
    """The record of a member; its content length must frame the block exactly."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        raise CorruptRecord("no WARC header")
    fields = _fields(head)
    try:
        size = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise CorruptRecord("no content length") from e
    if size < 0 or rest[size:] != b"\r\n\r\n" or len(rest) != size + 4:
        raise CorruptRecord(f"content length {size} does not frame the block")
    record = Record(fields, rest[:size])
    _check(fields.get("warc-block-digest"), record.block)
    if record.kind == "response":
        _check(fields.get("warc-payload-digest"), record.http()[1])
    return record


def _check(stated: str | None, data: bytes) -> None:
    if stated is not None:
        name, _, value = stated.partition(":")
        if hashlib.new(name, data).hexdigest() != value.lower():
            raise CorruptRecord(f"{name} digest differs")


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least: int = 100) -> list[str]:
    """Write every page to archives in ``folder``; gives their names.

    Payload: the html in UTF-8, empty if null.  Of equal payloads of at least
    ``least`` bytes the page with the smallest id is the response, the others are
    revisits; rows that share that id are all responses, and so are pages without
    an id if no copy has one.  A null id or url is left out of the record.  An
    empty table writes nothing.  Only file names reach the driver.
    """
    system, root = storage(folder)
    system.create_dir(root, recursive=True)
    raw = F.encode(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        raw.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    copied = written(rows.where(F.octet_length("payload") >= least).groupBy("digest")
                     .agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
                     .where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"), "warc-copies")
    rows = rows.join(copied, "digest", "left").select(
        "page", "url", "payload", "digest",
        F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page")), F.col("first")).alias("first"))

    def run(batches):
        context = TaskContext.get()
        name, n = f"part-{context.partitionId():05d}.warc.gz", 0

        def fill(out):
            nonlocal n
            for part in slices(batches):
                for page, url, payload, digest, first in zip(*(c.to_pylist() for c in part.columns)):
                    out.write(record_bytes("response" if first is None else "revisit", page, url, payload, digest, first))
                    n += 1

        files, path = storage(folder)
        commit_file(files, f"{path}/{name}", context.taskAttemptId(), fill)
        yield pa.RecordBatch.from_pydict({"name": [name], "n": [n]})

    return sorted(r["name"] for r in rows.mapInArrow(run, "name string, n long").collect() if r["n"])


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                   ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                   ("payload", pa.binary())])


def read_archives(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """One row per response or revisit: ``page_id, url, record_type, refers_to,
    payload_digest, payload_bytes, payload`` (null for revisits, whose bytes their
    response holds).  Damage raises ``CorruptRecord``; other record types are passed over."""

    def run(batches):
        files, path = storage(folder)
        rows = Rows(_READ)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with files.open_input_stream(f"{path}/{names[k]}", compression=None) as f:
                    for member in members(f.read):
                        record = parse(member)
                        if record.kind not in ("response", "revisit"):
                            continue
                        own, (http, body) = record.fields, record.http()
                        whole = record.kind == "response"
                        page, refers = own.get(PAGE.lower()), own.get(REFERS_TO_PAGE.lower())
                        size = len(body) if whole else int(http["content-length"])
                        rows.add(None if page is None else int(page), own.get("warc-target-uri"), record.kind,
                                 None if refers is None else int(refers),
                                 own["warc-payload-digest"].removeprefix("sha256:"), size, body if whole else None,
                                 weight=len(body))
                        if rows.ready():
                            yield rows.take()
        yield from rows.rest()

    n = len(names)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(
        run, "page_id long, url string, record_type string, refers_to long, payload_digest string, "
             "payload_bytes long, payload binary")
