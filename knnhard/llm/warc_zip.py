"""WARC records in ZIP packages: written by Spark tasks, read by range without extraction.

A package is one ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` (every
record its own gzip member) and ``indexes/index.cdx`` (one JSON line a record with its offset and
length in the archive member). The reader takes the end record (and, for large packages, the ZIP64
one) from the file's last bytes, parses the central directory, finds where the members' bytes begin,
and reads the index and single records by range.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knnhard.llm._common import attach, col, materialise, scratch_path, table

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Signatures and fixed sizes of the ZIP records (fixed values of the format).
_END, _END64, _LOCATOR64, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_END_SIZE, _END64_SIZE, _LOCATOR64_SIZE, _CENTRAL_SIZE, _LOCAL_SIZE = 22, 56, 20, 46, 30
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF
_EPOCH = "1970-01-01T00:00:00Z"

ReadRange = Callable[[int, int], bytes]


# ---- reading a package by range

@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int


def open_ranges(path: str) -> tuple[int, ReadRange, Callable[[], None]]:
    """(size, read(offset, length), close) of a file in any store that Arrow's file systems know."""
    from pyarrow import fs

    scheme, sep, rest = path.partition(":")
    if scheme == "file" and sep:
        store, name = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    elif path.startswith("/"):
        store, name = fs.LocalFileSystem(), path
    else:
        store, name = fs.FileSystem.from_uri(path)
    handle = store.open_input_file(name)

    def read(offset: int, length: int) -> bytes:
        data = handle.read_at(length, offset)
        if len(data) != length:
            raise ValueError(f"{path}: {length} bytes at {offset} are not there")
        return data

    return handle.size(), read, handle.close


def _directory_place(size: int, read: ReadRange) -> tuple[int, int, int]:
    """(offset, length, entries) of the central directory."""
    tail_size = min(size, _END_SIZE + _FULL16)
    tail = read(size - tail_size, tail_size)
    at = tail.rfind(_END)
    while at >= 0:  # the comment may hold the signature: its length has to reach the file's end
        if at + _END_SIZE <= len(tail) and at + _END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("no ZIP end record")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if entries == _FULL16 or length == _FULL32 or offset == _FULL32:
        where = size - tail_size + at - _LOCATOR64_SIZE
        locator = read(where, _LOCATOR64_SIZE)
        if not locator.startswith(_LOCATOR64):
            raise ValueError("no ZIP64 locator")
        end64 = read(struct.unpack_from("<Q", locator, 8)[0], _END64_SIZE)
        if not end64.startswith(_END64):
            raise ValueError("no ZIP64 end record")
        entries, length, offset = struct.unpack_from("<QQQ", end64, 32)
    return offset, length, entries


def _extra64(extra: bytes) -> bytes:
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return extra[at + 4:at + 4 + n]
        at += 4 + n
    return b""


def members(size: int, read: ReadRange) -> dict[str, Member]:
    """The package's members by name, from its central directory."""
    offset, length, entries = _directory_place(size, read)
    data, at, out = read(offset, length), 0, {}
    for _ in range(entries):
        if data[at:at + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
        header_at = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + _CENTRAL_SIZE:at + _CENTRAL_SIZE + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        wide, k = _extra64(data[at + _CENTRAL_SIZE + n_name:at + _CENTRAL_SIZE + n_name + n_extra]), 0
        values = []
        for v in (plain, packed, header_at):  # the ZIP64 field holds, in this order, those that are full
            if v == _FULL32:
                v, k = struct.unpack_from("<Q", wide, k)[0], k + 8
            values.append(v)
        out[name] = Member(name, method, values[1], values[2])
        at += _CENTRAL_SIZE + n_name + n_extra + n_comment
    return out


def stored_at(member: Member, read: ReadRange) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed: it cannot be read by range")
    head = read(member.header_at, _LOCAL_SIZE)
    if not head.startswith(_LOCAL):
        raise ValueError(f"{member.name}: broken local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header_at + _LOCAL_SIZE + n_name + n_extra


def index_lines(data: bytes) -> list[dict[str, Any]]:
    return [json.loads(x) for x in data.split(b"\n") if x.strip()]


def parse_record(packed: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one gzip member that holds one WARC record."""
    raw = zlib.decompress(packed, wbits=31)
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    lines = head.decode("utf-8").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, rest[:int(headers["content-length"])]


# ---- writing a package

def _header(value: Any) -> str:
    """A header value on one line; other control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in str(value))


def _record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'record:' + key)}>"


def make_record(key: str, url: str | None, kind: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    block = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(key)}", f"WARC-Date: {_EPOCH}",
            f"WARC-Target-URI: {_header(url or '')}", f"X-Page-ID: {_header(key)}",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-ID: {_header(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def make_package(records: list[bytes], entries: list[dict[str, Any]]) -> bytes:
    """A ZIP file of the records and their index; its comment is one newline, so it ends in one."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((ARCHIVE, b"".join(records)), (INDEX, b"".join(json.dumps(e).encode() + b"\n" for e in entries))):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
        z.comment = b"\n"
    return out.getvalue()


def write_packages(rows: DataFrame, path: str, package_bytes: int = 16 << 20) -> None:
    """Write ``rows`` (key, url, kind, payload, digest, refers) as packages of about ``package_bytes``.

    Each package is one row of a text file of its own: Spark's committed writer puts it into any
    store, and a lost task leaves nothing behind. The writer ends a row with a newline, which is
    the last byte of the package.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        entries: list[dict[str, Any]] = []
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([make_package(records, entries)[:-1]], pa.binary())], names=["value"])

        for b in batches:
            for key, url, kind, payload, digest, refers in zip(*(c.to_pylist() for c in b.columns)):
                rec = make_record(key, url, kind, payload or b"", digest, refers)
                entries.append({"key": key, "type": kind, "offset": size, "length": len(rec)})
                records.append(rec)
                size += len(rec)
                if size >= package_bytes:
                    yield out()
                    records, entries, size = [], [], 0
        if records:
            yield out()

    packages = rows.select("key", "url", "kind", "payload", "digest", "refers").mapInArrow(run, "value binary")
    packages.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


# ---- Spark operators

def _paths(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "length").where("length > 0")


def read_packages(spark: SparkSession, folder: str, records_per_stretch: int = 500) -> DataFrame:
    """(path, key, kind, payload, payload_bytes, digest, refers) of every record in the packages below ``folder``.

    One job lists the packages' indexes, the next deals the records out by package and stretch, so a large
    package is read by many tasks, each by range. A response's digest is recomputed from its payload
    and has to equal the recorded one; a revisit's payload is null, its size and digest are those recorded.
    """
    def list_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                size, read, close = open_ranges(path)
                inside = members(size, read)
                index, at = inside[INDEX], stored_at(inside[ARCHIVE], read)
                lines = index_lines(read(stored_at(index, read), index.size))
                close()
                for i in range(0, len(lines), 4096):
                    part = lines[i:i + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(part)), pa.array([at + e["offset"] for e in part], pa.int64()),
                         pa.array([e["length"] for e in part], pa.int64()),
                         pa.array([(i + k) // records_per_stretch for k in range(len(part))], pa.int64())],
                        names=["path", "at", "length", "stretch"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, Any, Any] | None = None
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            for i in range(0, len(rows), 256):
                out: list[list] = [[] for _ in range(7)]
                for path, at, length, _ in rows[i:i + 256]:
                    if held is None or held[0] != path:
                        if held:
                            held[2]()
                        _, read, close = open_ranges(path)
                        held = (path, read, close)
                    headers, block = parse_record(held[1](at, length))
                    kind = headers["warc-type"]
                    for o, v in zip(out, (path, headers["x-page-id"], kind, block if kind == "response" else None,
                                          int(headers["x-payload-length"]),
                                          headers["warc-payload-digest"].removeprefix("sha256:"),
                                          headers.get("x-refers-to-page-id"))):
                        o.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(o, t) for o, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(),
                                                          pa.string(), pa.string()))],
                    names=["path", "key", "kind", "payload", "payload_bytes", "digest", "refers"])
        if held:
            held[2]()

    listed = _paths(spark, folder).select("path").mapInArrow(list_records, "path string, at long, length long, stretch long")
    # a listed row is short but stands for a record: the number is given, or adaptive planning would join tasks by the rows' bytes
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = listed.repartition(tasks, "path", "stretch").sortWithinPartitions("path", "at")
    got = dealt.mapInArrow(fetch, "path string, key string, kind string, payload binary, payload_bytes long, digest string, refers string")
    response = F.col("kind") == "response"
    same = (F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("payload_bytes"))
    return got.withColumn("digest", F.when(response & ~same, F.raise_error(F.concat(F.lit("damaged record "), "key")))
                          .otherwise(F.col("digest")))


def plan_records(pages: DataFrame, id_col: str, url_col: str, text_col: str, min_bytes: int = 100) -> DataFrame:
    """(key, url, kind, payload, digest, refers): which pages are written whole and which revisit another.

    Of equal payloads of ``min_bytes`` or more the smallest id is the response (an id of null only if there is
    no other); of rows that repeat it too, each is a response. Shorter payloads are responses.
    """
    payload = F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(col(id_col).alias("id"), col(url_col).cast("string").alias("url"), payload.alias("payload")) \
        .withColumn("digest", F.sha2("payload", 256))
    long_ones = pages.select(col(id_col).alias("id"), payload.alias("payload")).where(F.octet_length("payload") >= min_bytes) \
        .select("id", F.sha2("payload", 256).alias("digest"))
    firsts = long_ones.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = materialise(firsts.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "repeated")
    # only pages that repeat another's payload meet that table, by id, digest and salt; few bytes each
    revisits = attach(long_ones, "digest", repeated, F.col("id")).where("NOT (id <=> first)") \
        .select(F.coalesce(F.col("id").cast("string"), F.lit("-")).alias("k"), F.col("digest").alias("d"), "first").distinct()
    keyed = rows.withColumn("k", F.coalesce(F.col("id").cast("string"), F.lit("-")))
    out = keyed.join(revisits, (keyed["k"] == revisits["k"]) & (keyed["digest"] == revisits["d"]), "left")
    return out.select(keyed["k"].alias("key"), "url",
                      F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("kind"),
                      "payload", "digest", F.col("first").cast("string").alias("refers"))


def package_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
                  min_bytes: int = 100, package_bytes: int = 16 << 20) -> None:
    """Write every row of ``pages`` as a WARC record into packages below ``folder`` (any shared store).

    Null texts are empty payloads; an id of null is written as ``-``; repeated rows give repeated
    records; an empty table gives an empty folder; other columns are not read. Memory: one package a task.
    """
    write_packages(plan_records(pages, id_col, url_col, text_col, min_bytes), folder, package_bytes)


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` through packages: written below the shared folder, then read back by range."""
    folder = scratch_path(spark, "packages")
    package_pages(table(spark, sf_dir, "pages"), folder)
    number = F.when(F.col("key") != "-", F.col("key")).cast("long")
    return read_packages(spark, folder).select(
        number.alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"),
        F.col("refers").cast("long").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha256(t) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
