"""WARC records in ZIP packages: written by tasks, read back by byte ranges without extraction.

A package stores archive/data.warc.gz (a gzip member for each record) and indexes/index.jsonl (a line for each
record: id, offset, length), both uncompressed by ZIP, so a record is a range of the package's bytes.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.shared import map_arrow, new_path, stored, type_of

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Payloads of fewer bytes are always stored in full.
REVISIT_FROM = 100
#: A task begins another package once one has so many bytes.
PACKAGE_BYTES = 1 << 30
#: Neighbouring records are read together up to so many bytes.
READ_BYTES = 4 << 20
#: Bytes of packages that a task reads, and of payloads that it hands on at a time.
TASK_BYTES, BATCH_BYTES = 32 << 20, 32 << 20
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


# ---- ZIP


@dataclass(frozen=True)
class Member:
    """A member of a package: its name, compression method, size, and where its local header stands."""

    name: str
    method: int
    size: int
    stored_size: int
    header: int


class ZipWriter:
    """Stored members in a stream that is never sought: sizes follow the data in descriptors, and are 64 bits."""

    def __init__(self, sink):
        self.sink, self.at, self.members = sink, 0, []

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.name, self.header, self.crc, self.size = raw, self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4s5H3I2H", b"PK\3\4", 45, 8, 0, 0, 0x21, 0, _MAX32, _MAX32, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> None:
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        self._put(data)

    def end(self) -> None:
        self._put(struct.pack("<4sIQQ", b"PK\7\x08", self.crc, self.size, self.size))
        self.members.append((self.name, self.crc, self.size, self.header))

    def close(self) -> None:
        """Write the central directory, with its ZIP64 form."""
        begin = self.at
        for name, crc, size, header in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, header)
            self._put(struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 8, 0, 0, 0x21, crc, _MAX32, _MAX32, len(name), len(extra), 0, 0, 0, 0, _MAX32) + name + extra)
        n, size, end = len(self.members), self.at - begin, self.at
        self._put(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, begin))
        self._put(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self._put(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, min(n, _MAX16), min(n, _MAX16), min(size, _MAX32), min(begin, _MAX32), 0))


def directory(source) -> list[Member]:
    """The members by the central directory of a file with size() and read_at(n, offset)."""
    size = source.size()
    low = max(0, size - (_MAX16 + 22 + 20))
    tail = source.read_at(size - low, low)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP package")
    n, length, begin = struct.unpack("<10xH2I2x", tail[at : at + 22])
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7":
        end64 = struct.unpack("<8xQ4x", tail[at - 20 : at])[0]
        head = source.read_at(56, end64)
        if head[:4] != b"PK\6\6":
            raise ValueError("the ZIP64 locator points to no ZIP64 directory")
        n, length, begin = struct.unpack("<32x3Q", head)
    data, at, out = source.read_at(length, begin), 0, []
    for _ in range(n):
        if data[at : at + 4] != b"PK\1\2":
            raise ValueError("the central directory is damaged")
        method, stored_size, full, n_name, n_extra, n_note, header = struct.unpack("<10xH8x2I3H8xI", data[at : at + 46])
        name = data[at + 46 : at + 46 + n_name].decode()
        extra, wide = data[at + 46 + n_name : at + 46 + n_name + n_extra], b""
        while len(extra) >= 4:
            kind, n_field = struct.unpack("<2H", extra[:4])
            if kind == 1:
                wide = extra[4 : 4 + n_field]
            extra = extra[4 + n_field :]
        if full == _MAX32:
            full, wide = struct.unpack("<Q", wide[:8])[0], wide[8:]
        if stored_size == _MAX32:
            stored_size, wide = struct.unpack("<Q", wide[:8])[0], wide[8:]
        if header == _MAX32:
            header = struct.unpack("<Q", wide[:8])[0]
        out.append(Member(name, method, full, stored_size, header))
        at += 46 + n_name + n_extra + n_note
    return out


def data_offset(source, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed, not stored: its records cannot be read by range")
    head = source.read_at(30, member.header)
    if head[:4] != b"PK\3\4":
        raise ValueError(f"{member.name} has no local header where the directory says")
    return member.header + 30 + sum(struct.unpack("<2H", head[26:30]))


# ---- WARC


def urn(page) -> str:
    """The record id of a page; a null id has one that no other value gives."""
    return "<urn:no-page>" if page is None else f"<urn:page:{quote(str(page), safe='')}>"


def page_of(value: str | None) -> str | None:
    """The page of a record id, as a string."""
    return unquote(value[len("<urn:page:") : -1]) if value and value.startswith("<urn:page:") else None


def record(kind: str, page, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A WARC record; a revisit has the HTTP headers without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers (lower-case names) and the payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


# ---- Spark


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page, url, payload, digest, refers_to (null: a response). Of equal payloads of at least REVISIT_FROM
    bytes, the rows with the smallest id are responses. Payloads are shuffled by page and digest, so pages that share
    one are written by many tasks."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = stored(rows.where(F.octet_length("payload") >= REVISIT_FROM).select("page", "digest"), "digests")
    first = stored(long.groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "firsts")
    # a digest that many pages share meets them here, without payloads, in a join that adaptive execution can split
    revisits = stored(long.join(first, "digest").where("page > first").select("page", "digest", F.col("first").alias("refers_to")).distinct(), "revisits")
    return rows.join(revisits, ["page", "digest"], "left").select("page", "url", "payload", "digest", "refers_to")


def write_packages(rows: DataFrame, folder: str) -> DataFrame:
    """Write the rows of with_revisits() as packages into `folder`; one row per package: path, records, bytes.
    A task that runs again writes files of its own; only those of the run that counts are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, part, lines, done = TaskContext.get(), 0, [], []
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        zipped = None

        def finish() -> None:
            zipped.end()
            zipped.begin(INDEX)
            for x in lines:
                zipped.write(x)
            zipped.end()
            zipped.close()
            zipped.sink.close()
            done.append((path, len(lines), zipped.at))
            lines.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page", "url", "payload", "digest", "refers_to")]
            for page, url, payload, digest, refers in zip(*columns, strict=True):
                if zipped is None:
                    name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{part:03d}.zip"
                    path, part = f"{folder}/{name}", part + 1
                    zipped = ZipWriter(files.open_output_stream(f"{base}/{name}"))
                    zipped.begin(DATA)
                raw = record("response" if refers is None else "revisit", page, url, payload, digest, refers)
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = squeeze.compress(raw) + squeeze.flush()
                lines.append(json.dumps({"id": None if page is None else str(page), "offset": zipped.size, "length": len(member)}).encode() + b"\n")
                zipped.write(member)
                if zipped.size >= PACKAGE_BYTES:
                    finish()
                    zipped = None
        if zipped is not None:
            finish()
        yield pa.RecordBatch.from_pydict({k: [d[i] for d in done] for i, k in enumerate(("path", "records", "bytes"))}, schema=_LISTED)

    return rows.mapInArrow(run, "path string, records long, bytes long")


_LISTED = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def index_entries(packages: DataFrame) -> DataFrame:
    """A row per record of the packages (path): path, id, offset (in the package), length."""

    def entries(batch: pa.RecordBatch) -> dict:
        rows = []
        for path in batch.column("path").to_pylist():
            files, name = _open(path)
            with files.open_input_file(name) as source:
                by = {m.name: m for m in directory(source)}
                base = data_offset(source, by[DATA])
                raw = source.read_at(by[INDEX].size, data_offset(source, by[INDEX]))
                for x in map(json.loads, raw.splitlines()):
                    rows.append((path, x["id"], base + x["offset"], x["length"]))
        return {k: [r[i] for r in rows] for i, k in enumerate(("path", "id", "offset", "length"))}

    return map_arrow(packages.select("path"), entries, "path string, id string, offset long, length long")


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(id, kind, url, refers_to, digest, payload) of a batch of index entries. Neighbours are read at once, one read at a time."""
    rows, at = sorted(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True)), 0
    while at < len(rows):
        path, low, length = rows[at]
        upto, end = at + 1, low + length
        while upto < len(rows) and rows[upto][0] == path and rows[upto][1] == end and end - low < READ_BYTES:
            end += rows[upto][2]
            upto += 1
        files, name = _open(path)
        with files.open_input_file(name) as source:
            data = source.read_at(end - low, low)
        for _, o, n in rows[at:upto]:
            headers, payload = parsed(zlib.decompress(data[o - low : o - low + n], 31))
            kind, digest = headers["warc-type"], headers["warc-payload-digest"].partition(":")[2]
            yield page_of(headers["warc-record-id"]), kind, headers.get("warc-target-uri"), page_of(headers.get("warc-refers-to")), digest, payload
        at = upto


def _read(entries: DataFrame, last: str, of_payload) -> DataFrame:
    """The records of index entries, with of_payload(payload) as the last columns. What a task holds is bounded by bytes."""
    names = ["id", "kind", "url", "refers_to", "digest", *(x.split(" ")[0] for x in last.split(", "))]
    ddl = f"id string, kind string, url string, refers_to string, digest string, {last}"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        make = lambda: pa.RecordBatch.from_pydict({c: [r[i] for r in out] for i, c in enumerate(names)}, schema=schema)
        for batch in batches:
            for *head, payload in _ranges(batch):
                out.append((*head, *(found := of_payload(payload))))
                held += 200 + sum(len(x) for x in found if isinstance(x, bytes))
                if held >= BATCH_BYTES:
                    yield make()
                    out, held = [], 0
        if out:
            yield make()

    return entries.mapInArrow(run, ddl)


def read_records(entries: DataFrame) -> DataFrame:
    """The records of index entries, each read by its range: id, kind, url, refers_to, digest, payload. The id of a page without one is null."""
    return _read(entries, "payload binary", lambda payload: (payload,))


def digest_records(entries: DataFrame) -> DataFrame:
    """As read_records(), with the payload's bytes (n) and SHA-256 (read), computed where it is read, in its place."""
    return _read(entries, "n long, read string", lambda payload: (len(payload), hashlib.sha256(payload).hexdigest()))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page as a WARC record, read all packages back, and describe each record: id_col,
    payload_bytes and payload_digest (of the full payload as read, for a revisit that of its response),
    record_type, refers_to.

    Defined cases: a null html is an empty payload; a null URL gives no target header; of rows with equal
    ids and payloads all with the smallest id are responses; a null id comes back null and is never
    referred to unless no other has that payload; an empty table writes nothing; other columns are ignored.
    """
    spark = pages.sparkSession
    packages = stored(write_packages(with_revisits(pages, id_col, url_col, html_col), new_path(spark, "warc")), "packages")
    # index rows are tiny, so tasks are counted by the bytes that they lead to
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil((packages.agg(F.sum("bytes")).first()[0] or 0) / TASK_BYTES))
    records = digest_records(index_entries(packages).repartition(tasks, "path", F.floor(F.col("offset") / READ_BYTES)))
    read = stored(records.select("id", "kind", "refers_to", "digest", "n", "read"), "records")
    full = read.where("kind = 'response'").groupBy(F.col("id").alias("refers_to"), "digest").agg(F.first("n").alias("full_n"), F.first("read").alias("full_read"))
    both = read.join(stored(full, "responses"), ["refers_to", "digest"], "left")
    kind = type_of(pages, id_col)
    revisit = F.col("kind") == "revisit"
    return both.select(
        F.col("id").cast(kind).alias(id_col),
        F.when(revisit, F.col("full_n")).otherwise(F.col("n")).alias("payload_bytes"),
        F.when(revisit, F.col("full_read")).otherwise(F.col("read")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
