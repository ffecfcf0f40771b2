"""WARC archives as a Python data source.

Files are gzip members of one record each (or plain records). A member written here says its compressed length in a gzip
extra field, so a reader that does not want a record steps over it unread; elsewhere the end of a member is found by
inflating it without keeping anything. Headers are inflated and parsed first: predicates on the record type and on headers are
pushed down to them, and a payload is decoded only if the record passes and the payload is asked for.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from palimpsest.llm.shared import fresh, open_fs

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, content_type string, payload_digest string, "
    "refers_to string, payload_length long, file string, offset long, payload binary"
)
#: Columns that come from headers.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "payload_length": "x-payload-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_HEAD = 4096


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _clean(value: str) -> str:
    """A header's value keeps to its line; a line break has no place in an address and is escaped, all else stands as it is."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def member(block: bytes, level: int = 3) -> bytes:
    """A gzip member whose extra field sl holds its own length and that of its content."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(block) + z.flush()
    size = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(block) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def record(kind: str, rid: str, uri: str | None, date: str, digest: str | None, refers_to: str | None, length: int, payload: bytes) -> bytes:
    block = HTTP + (payload if kind != "revisit" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {_clean(uri)}"] if uri is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}"] if digest else []
    lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"] if refers_to else []
    lines += [f"X-Payload-Length: {length}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


@dataclass
class Files(InputPartition):
    """Whole files of one read task: (path, size)."""

    files: list[tuple[str, int]]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Window:
    """Reads of a file by offset, a chunk at a time."""

    def __init__(self, f, size: int, chunk: int = 1 << 20):
        self.f, self.size, self.chunk, self.at, self.data = f, size, chunk, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if at < self.at or at + n > self.at + len(self.data):
            self.at, self.data = at, self.f.read_at(min(max(n, self.chunk), self.size - at), at)
        return self.data[at - self.at : at - self.at + n]


def _parse(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def records(w: _Window, wanted) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """(offset, headers, block) of each record. wanted(headers): False to step over the record, None for its headers alone,
    True for its block too. Raises on bytes that are no record."""
    at = 0
    while at < w.size:
        first = w.get(at, 24)
        if first[:2] == b"\x1f\x8b":
            stated = 0
            if len(first) == 24 and first[3] == 4 and first[10:16] == b"\x0c\0sl\x08\0":
                stated = struct.unpack("<I", first[16:20])[0]
            z, raw, pos = zlib.decompressobj(31), b"", at
            while (end := raw.find(b"\r\n\r\n")) < 0 and not z.eof and pos < w.size:
                part = w.get(pos, _HEAD if not stated else min(_HEAD, at + stated - pos))
                raw += z.decompress(part)
                pos += len(part)
            if end < 0:
                raise ValueError(f"no WARC header at byte {at}")
            headers = _parse(raw[:end])
            take = wanted(headers)
            if stated and not take:
                nxt = at + stated
            else:
                parts = [raw] if take else []
                while not z.eof and pos < w.size:
                    part = w.get(pos, at + stated - pos if stated else 1 << 16)
                    got = z.decompress(part)
                    pos += len(part)
                    if take:
                        parts.append(got)
                if not z.eof:
                    raise ValueError(f"the record at byte {at} is cut off")
                nxt = pos - len(z.unused_data)
                raw = b"".join(parts) if take else b""
        else:
            raw, n = first, _HEAD
            while (end := raw.find(b"\r\n\r\n")) < 0 and len(raw) < w.size - at:
                raw = w.get(at, n)
                n *= 4
            if end < 0 or not raw.startswith(b"WARC/"):
                raise ValueError(f"no WARC header at byte {at}")
            headers = _parse(raw[:end])
            take = wanted(headers)
            size = int(headers["content-length"])
            nxt = at + end + 4 + size + 4
            if take:
                raw = w.get(at, end + 4 + size)
        if take is not False:
            yield at, headers, raw[end + 4 : end + 4 + int(headers["content-length"])] if take else None
        at = nxt


def _value(headers: dict[str, str], column: str):
    v = headers.get(HEADERS[column])
    if v is None:
        return None
    if column in ("record_id", "refers_to"):
        return v.strip("<>")
    if column == "payload_digest":
        return v.rpartition(":")[2]
    return int(v) if column == "payload_length" else v


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.columns = options["path"], [f.name for f in schema.fields]
        self.split = int(options.get("maxPartitionBytes", 64 << 20))
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.tests: list[tuple[str, str, tuple]] = []
        self.schema = schema

    def pushFilters(self, filters):
        """Equality, membership, prefixes and presence of header columns are decided here; the rest goes back to Spark, and so does what
        is asked of the payload's length: archives of others do not state it in a header."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            column = None if column == "payload_length" else column
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", (f.value,)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, "there", ()))
            else:
                yield f

    def partitions(self):
        """Files in order of name, small ones together up to maxPartitionBytes. A folder with manifests holds the files that
        they name: what a failed task left behind is not among them."""
        fs, root = open_fs(self.path)
        infos = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
        size = {i.path: i.size for i in infos if i.type == pafs.FileType.File}
        named = [m for p in sorted(size) if p.endswith("/_manifest.json") or "/_manifest-" in p for m in json.loads(fs.open_input_stream(p).read())]
        files = sorted(f"{root}/{n}" for n in named) if named or any("/_manifest" in p for p in size) else sorted(p for p in size if re.search(r"\.warc(\.gz)?$", p))
        out, now, n = [], [], 0
        for p in files:
            if now and n + size[p] > self.split:
                out.append(Files(now))
                now, n = [], 0
            now.append((p, size[p]))
            n += size[p]
        return [*out, Files(now)] if now or not out else out

    def _wanted(self, headers):
        for column, how, args in self.tests:
            v = _value(headers, column)
            if v is None or how == "in" and v not in args or how == "starts" and not v.startswith(args[0]):
                return False
        unknown = "payload_length" in self.columns and HEADERS["payload_length"] not in headers
        return True if ("payload" in self.columns or unknown) and headers.get("warc-type") != "revisit" else None

    def read(self, partition):
        fs, _ = open_fs(self.path)
        schema = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "binary": pa.binary()}.get(f.dataType.simpleString(), pa.string())) for f in self.schema.fields])
        rows, held = [], 0
        for path, size in partition.files:
            with fs.open_input_file(path) as f:
                for at, headers, block in records(_Window(f, size), self._wanted):
                    row = {c: _value(headers, c) for c in self.columns if c in HEADERS}
                    payload = None
                    if block is not None:
                        payload = block[block.find(b"\r\n\r\n") + 4 :] if headers.get("content-type", "").startswith("application/http") else block
                        if "payload_length" in row:
                            row["payload_length"] = len(payload)
                        if self.verify and (d := _value(headers, "payload_digest")) and base32(hashlib.sha1(payload).digest()) != d:
                            raise ValueError(f"{path}, byte {at}: the payload does not have its digest")
                    rows.append(row | {"file": path, "offset": at, "payload": payload})
                    held += len(payload or b"") + 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in self.columns} for r in rows], schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in self.columns} for r in rows], schema)


class WarcWriter(DataSourceArrowWriter):
    """Rows of (record_type, record_id, target_uri, date, payload_digest, refers_to, payload_length, payload). Each task writes
    files under names of its own, closed at maxFileBytes; the commit names those of the tasks that count."""

    def __init__(self, options):
        self.path, self.limit = options["path"], int(options.get("maxFileBytes", 64 << 20))

    def write(self, iterator):
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        names, out, n = [], None, 0
        for batch in iterator:
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            for i in range(batch.num_rows):
                r = {c: v[i].as_py() for c, v in cols.items()}
                if out is None or n >= self.limit:
                    if out:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, n = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                n += out.write(member(record(r["record_type"], r["record_id"], r["target_uri"], r["date"], r["payload_digest"], r["refers_to"], r["payload_length"], r["payload"] or b"")))
        if out:
            out.close()
        return Written(names)

    def commit(self, messages):
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([n for m in messages if m for n in m.files]).encode())

    def abort(self, messages):
        fs, root = open_fs(self.path)
        for m in messages:
            for n in m.files if m else []:
                fs.delete_file(f"{root}/{n}")


class WarcDataSource(DataSource):
    """spark.read.format("warc"): path, maxPartitionBytes, verify; write: path, maxFileBytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """The records of a folder or file. columns: those wanted; without payload no payload is decoded."""
    register(spark)
    kinds = dict(c.split(" ") for c in SCHEMA.split(", "))
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    return spark.read.format("warc").schema(schema).options(**options).load(path)


def archive(pages: DataFrame, path: str, *, min_payload: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record for each page: of equal payloads of at least min_payload bytes the one with the smallest page_id is a
    response and the others revisit it; smaller ones are all responses.

    A null html is an empty payload. Rows that share the smallest page_id are all responses; a null page_id sorts last, and a
    group of nulls alone is all responses. A null url leaves its header out. Payloads are grouped by SHA-1 and length; the group's
    smallest id is found by a combined aggregation and joined back, so that many equal pages can be split over tasks.
    """
    spark = pages.sparkSession
    register(spark)
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.select("*", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("payload_length"))
    firsts = p.where(F.col("payload_length") >= min_payload).groupBy("sha", "payload_length").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    p = p.join(firsts, ["sha", "payload_length"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    rows = p.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.col("sha"),
        F.when(again, urn(F.col("first_id"))).alias("refers_to"),
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )
    rows.withColumn("payload_digest", _base32(F.col("sha"))).drop("sha").write.format("warc").mode("append").save(path)


def _base32(sha: Column) -> Column:
    """Base32 of 40 hexadecimal digits: 8 groups of 5 digits are 20 bits, 4 letters each."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for g in range(8):
        n = F.conv(F.substring(sha, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(letters, F.shiftright(n, 15 - 5 * i).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for i in range(4)]
    return F.concat(*out)


def round_trip(pages: DataFrame, path: str | None = None, *, min_payload: int = 0) -> DataFrame:
    """Archives the pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to. Response
    payloads are decoded and held against their digests; a revisit's length and digest are those its headers state."""
    spark = pages.sparkSession
    path = path or fresh(spark, "warc")
    archive(pages, path, min_payload=min_payload)
    columns = ["record_type", "record_id", "payload_digest", "refers_to", "payload_length", "payload"]
    r = read(spark, path, columns, verify="true")
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return r.select(
        number(F.col("record_id")).alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )
