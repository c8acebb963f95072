"""WARC archives: a Python data source that writes them, and reads them with pushed-down header predicates."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from attesta.llm.common import cut, skew_lookup

VERSION, BREAK, END = "WARC/1.1", b"\r\n\r\n", b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header fields that are columns of the source.
FIELDS = {"record_type": "warc-type", "record_id": "x-record-key", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "x-refers-to-key", "payload_bytes": "x-payload-length", "content_length": "content-length"}
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Header fields and the values that pass; and what leaves out the records that describe files.
Tests = list[tuple[str, frozenset[str]]]
NO_INFO = ("warc-type", frozenset())
#: How a gzip member begins, and how one whose extra field tells its length does: flags, time, system, and the field's size.
GZIP, GZIP_EXTRA = b"\x1f\x8b\x08", b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x0c\x00sl\x08\x00"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of the text's bytes, from built-in functions: 5 hexadecimal digits are 4 of base32."""
    digest = F.sha1(text.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def deduplicated(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """records (record_key, payload, ...) with payload_bytes, payload_digest, record_type and refers_to.

    Of records with equal payloads of at least least_bytes, that with the least record_key is the
    response and others revisit it; smaller ones are all responses. Payloads are equal if their
    SHA-256 are, for equal SHA-1 digests can be made. Null payloads count as empty. Rows that repeat
    the response's key are responses too; a null key is a response only where no other is. Columns
    of these names are replaced, others pass through; an empty table gives an empty result. The least
    key of a payload is found by partial aggregation; one that many records share is looked up by
    broadcast (see skew_lookup), so no task gathers its records. A payload is held whole in one task.
    """
    payload = F.coalesce(F.col("payload"), F.lit("")).cast("binary")
    made = ("_first", "_same", "_rows", "payload_bytes", "payload_digest", "record_type", "refers_to")
    full = records.drop(*made).withColumns({"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": base32_sha1(payload), "_same": F.unhex(F.sha2(payload, 256))})
    first = cut(full.where(F.col("payload_bytes") >= least_bytes).groupBy("_same").agg(F.min("record_key").alias("_first"), F.count("*").alias("_rows")))
    again = F.coalesce((F.col("payload_bytes") >= least_bytes) & ~F.col("record_key").eqNullSafe(F.col("_first")), F.lit(False))
    marked = skew_lookup(full, first, "_same", "_rows").withColumn("_again", again)
    return marked.withColumn("record_type", F.when(F.col("_again"), "revisit").otherwise("response")).withColumn("refers_to", F.when(F.col("_again"), F.col("_first"))).drop("_first", "_same", "_again")


#: Blanks and control characters, which a header line cannot hold.
UNSAFE = r"[\x00-\x20\x7f]"


def write(records: DataFrame, path: str, uri: str = "url", date: str = "2000-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Writes a WARC record for each row of records (record_key, payload and the columns of `deduplicated`) below path.

    Each task writes a file that begins with a warcinfo record (an empty task none), in a temporary
    folder below path; once all are done, they are moved there. With gzip each record is a member of
    its own that tells its length, so readers can split files and step over records unread.
    Responses hold an HTTP message; revisits its header only, with the payload's digest, its length
    and the record they refer to. Record ids are made from record_key and repeat with it, which is
    also told as X-Record-Key. Blanks and control characters in the URI are percent-encoded; a null
    URI, digest or key is left out. An empty table writes nothing.
    """
    records.sparkSession.dataSource.register(WarcSource)
    escape = lambda c: F.when(c.rlike(UNSAFE), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    clean = F.when(F.col(uri).rlike(UNSAFE), F.array_join(F.transform(F.split(F.col(uri), ""), escape), "")).otherwise(F.col(uri))
    body = F.when(F.col("record_type") == "response", F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary"))).otherwise(F.lit("").cast("binary"))
    key, refers = (F.regexp_replace(F.col(c).cast("string"), r"[\r\n]", " ") for c in ("record_key", "refers_to"))
    rows = records.select("record_type", key.alias("record_id"), clean.alias("target_uri"), "payload_digest", refers.alias("refers_to"), "payload_bytes", body.alias("payload"))
    rows.write.format("warc").mode("append").option("date", date).option("compression", compression).save(path)


def file_system(path: str) -> tuple[Any, str]:
    """pyarrow's file system for the path: local, HDFS, S3 (s3a too), Google or Azure."""
    from pyarrow import fs

    for spark, arrow in (("s3a:", "s3:"), ("s3n:", "s3:")):
        path = arrow + path.removeprefix(spark) if path.startswith(spark) else path
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def record_bytes(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = [VERSION, *[f"{n}: {v}" for n, v in fields if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + BREAK + block + END


def urn(key: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'record:' + key) if key is not None else uuid.uuid4()}>"


def member(record: bytes) -> bytes:
    """A gzip member; its extra field sl holds its own length and the record's, unless these are too large for it."""
    zipped = zlib.compress(record, 6, -15)
    length = len(GZIP_EXTRA) + 8 + len(zipped) + 8
    if max(length, len(record)) >= 1 << 32:
        return zlib.compress(record, 6, 31)
    return GZIP_EXTRA + struct.pack("<II", length, len(record)) + zipped + struct.pack("<II", zlib.crc32(record), len(record))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.date, self.zipped = options["path"].rstrip("/"), options.get("date", "2000-01-01T00:00:00Z"), options.get("compression", "gzip") == "gzip"
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def record(self, row: dict[str, Any]) -> bytes:
        http, payload = row["payload"] or b"", row["payload_bytes"]
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload or 0}".encode() + BREAK
        again = row["record_type"] == "revisit"
        fields = [
            ("WARC-Type", row["record_type"]), ("WARC-Record-ID", urn(row["record_id"])), ("X-Record-Key", row["record_id"]), ("WARC-Date", self.date), ("WARC-Target-URI", row["target_uri"]),
            ("WARC-Payload-Digest", row["payload_digest"] and "sha1:" + row["payload_digest"]), ("X-Payload-Length", payload if payload is None else str(payload)),
            ("WARC-Profile", REVISIT if again else None), ("WARC-Refers-To", urn(row["refers_to"]) if again else None), ("X-Refers-To-Key", row["refers_to"] if again else None),
            ("Content-Type", "application/http; msgtype=response"),
        ]
        return record_bytes(fields, head + http)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        name, out = f"part-{uuid.uuid4().hex}.warc{'.gz' if self.zipped else ''}", None
        pack = member if self.zipped else bytes
        try:
            for b in iterator:
                if b.num_rows and out is None:
                    system.create_dir(f"{root}/{self.job}", recursive=True)
                    out = system.open_output_stream(f"{root}/{self.job}/{name}", compression=None)
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", urn(None)), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                    out.write(pack(record_bytes(info, b"format: WARC File Format 1.1\r\n")))
                for i in range(b.num_rows):
                    out.write(pack(self.record({n: c[i].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)})))
        finally:
            if out is not None:
                out.close()
        return Written([name] if out is not None else [])

    def commit(self, messages: list[Written | None]) -> None:
        """Only the files of attempts that count are moved."""
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{root}/{self.job}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = file_system(self.path)
        if system.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.job}")


class Parts(InputPartition):
    """Byte ranges (file, from, to) of one partition; a record belongs to the range in which it begins."""

    def __init__(self, ranges: list[tuple[str, int, int]]) -> None:
        self.ranges = ranges


class WarcReader(DataSourceReader):
    """Partitions are byte ranges of about `partitionBytes` together; equality and membership tests on header fields come first.

    A record's header is parsed before anything else of it. If the pushed-down tests fail, or no
    payload is asked for, its payload is not decoded: a plain file is read on behind it, and in a
    compressed one the next member is gone to if the member tells its length; only foreign archives
    that do not are inflated. Compressed files are split anywhere, for a range begins at the first
    member in it that holds a record; plain files are not split.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.target = int(options.get("partitionbytes", str(32 << 20)))
        self.tests: Tests = [] if options.get("info", "false").lower() == "true" else [NO_INFO]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in FIELDS and column not in ("payload_bytes", "content_length"):
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.tests.append((FIELDS[column], frozenset(str(v) for v in values if v is not None)))
            else:
                yield f

    def partitions(self) -> list[Parts]:
        from pyarrow import fs

        system, root = file_system(self.path)
        infos = [i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.size and not any(p.startswith(("_", ".")) for p in i.path.removeprefix(root).split("/"))]
        out: list[list[tuple[str, int, int]]] = []
        room = 0
        for i in sorted(infos, key=lambda i: i.path):
            step = self.target if i.path.endswith(".gz") else i.size
            for lo in range(0, i.size, step):
                size = min(step, i.size - lo)
                if not out or size > room:
                    out.append([])
                    room = self.target
                out[-1].append((i.path, lo, lo + size))
                room -= size
        return [Parts(ranges) for ranges in out] or [Parts([])]

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        rows: list[tuple] = []
        held = 0
        for name, lo, hi in partition.ranges:
            with system.open_input_file(name) as f:
                found = member_records(f, lo, hi, self.tests, self.payload) if name.endswith(".gz") else records(io.BufferedReader(f, 1 << 20), self.tests, self.payload)
                for header, block in found:
                    payload = None if block is None else body_of(header, block)
                    rows.append((*[bare(header.get(FIELDS[c])) for c in list(FIELDS)[:5]], number(header.get("x-payload-length")), number(header.get("content-length")), payload, digest(payload) if payload is not None else None))
                    held += len(payload or b"") + 500
                    if held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)


SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_bytes bigint, content_length bigint, payload binary, computed_digest string"


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def bare(value: str | None) -> str | None:
    """A header value without the name of its hash."""
    return None if value is None else value.removeprefix("sha1:")


def number(value: str | None) -> int | None:
    return int(value) if value and value.isdigit() else None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def body_of(header: dict[str, str], block: bytes) -> bytes:
    """The payload of a block: what follows the HTTP header, if it holds a message, else all of it."""
    if header.get("content-type", "").startswith("application/http"):
        head, found, body = block.partition(BREAK)
        return body if found else b""
    return block


def header_of(f: Any) -> dict[str, str] | None:
    """The header of the record that begins here; None at the end."""
    while line := f.readline():
        if line.strip():
            break
    else:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:80]!r}")
    header: dict[str, str] = {}
    while (line := f.readline()).strip():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        header[name.strip().lower()] = value.strip()
    return header


def wanted(header: dict[str, str], tests: Tests) -> bool:
    return all(header.get("warc-type") != "warcinfo" if (field, values) == NO_INFO else bare(header.get(field)) in values for field, values in tests)


def records(f: Any, tests: Tests, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Header and block of each record that passes the tests; blocks of others are skipped."""
    while (header := header_of(f)) is not None:
        size, ok = int(header.get("content-length", "0")), wanted(header, tests)
        if ok and with_payload:
            yield header, f.read(size)
            continue
        if f.seekable():
            f.seek(size, io.SEEK_CUR)
        else:
            while size > 0 and (block := f.read(min(size, 1 << 20))):
                size -= len(block)
        if ok:
            yield header, None


class Inflated(io.RawIOBase):
    """The bytes of the gzip member at a place of a file; end is the place behind it once all are read."""

    def __init__(self, f: BinaryIO, at: int) -> None:
        self.f, self.end, self.zip, self.next = f, at, zlib.decompressobj(31), b""
        f.seek(at)

    def readable(self) -> bool:
        return True

    def readinto(self, into: Any) -> int:
        while not self.zip.eof:
            if not self.next:
                self.next = self.f.read(1 << 14)
                if not self.next:
                    raise EOFError("a gzip member ends too early")
                self.end += len(self.next)
            out = self.zip.decompress(self.next, len(into))
            self.next = self.zip.unconsumed_tail
            if self.zip.eof:
                self.end -= len(self.zip.unused_data)
            if out:
                into[: len(out)] = out
                return len(out)
        return 0


def first_member(f: BinaryIO, lo: int, hi: int) -> int | None:
    """The first place from lo on, before hi, at which a gzip member begins that holds a WARC record."""
    at = lo
    while at < hi:
        f.seek(at)
        block = f.read((1 << 16) + 2)
        i = block.find(GZIP)
        while i >= 0 and at + i < hi and i < 1 << 16:
            try:
                if io.BufferedReader(Inflated(f, at + i), 64).read(5) == b"WARC/":
                    return at + i
            except (zlib.error, EOFError):
                pass
            i = block.find(GZIP, i + 1)
        at += 1 << 16
    return None


def told_length(f: BinaryIO, at: int) -> int | None:
    f.seek(at)
    head = f.read(len(GZIP_EXTRA) + 8)
    return struct.unpack("<II", head[len(GZIP_EXTRA) :])[0] if head.startswith(GZIP_EXTRA) and len(head) == len(GZIP_EXTRA) + 8 else None


def member_records(f: BinaryIO, lo: int, hi: int, tests: Tests, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Header and block of each record of the members that begin from lo on, before hi."""
    at = lo if not lo else first_member(f, lo, hi)
    while at is not None and at < hi:
        length = told_length(f, at)
        inflated = Inflated(f, at)
        b = io.BufferedReader(inflated, 1 << 12)
        if length is None:  # another writer's: all records of the member
            if b.peek(1):
                yield from records(b, tests, with_payload)
            else:
                inflated.end = max(inflated.end, at + 1)
            at = inflated.end
            f.seek(at)
            if not f.read(1):
                return
            continue
        header = header_of(b)
        at += length
        if header is not None and wanted(header, tests):
            yield header, b.read(int(header.get("content-length", "0"))) if with_payload else None


class WarcSource(DataSource):
    """Format "warc" with the option path: one row per record. Option payload=false reads headers only, info=true warcinfo records too.

    Written rows have record_type, record_id, target_uri, payload_digest, refers_to, payload_bytes and payload, see `write`.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: Any, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, path: str, payload: bool = True, partition_bytes: int = 32 << 20) -> DataFrame:
    """The records below path. Tests of record_type, record_id, target_uri, payload_digest and refers_to are pushed down.

    record_id and refers_to are the keys that `write` was given (null for other writers' records). Records of any length are read whole, in the task whose range they begin in. A
    folder without archives gives no rows.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).option("partitionBytes", partition_bytes).load()
