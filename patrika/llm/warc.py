"""WARC files as a PySpark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans partitions of whole files, takes record-type and header predicates from the filters that Spark pushes
down, parses a record's header first, and skips the payload of records that the predicates or the options don't want.
Compressed files hold one gzip member per record; members written here carry their length in the gzip extra field
`sl`, so skipping one is a seek. Writing appends files under names of their own and shows them only on commit, so
retried tasks and lost executors leave no doubled records. Files are reached with pyarrow's file systems, by URI.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .common import fresh_path, with_group

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, headers map<string,string>, payload_bytes long, payload_sha1 string, payload binary"
#: Columns that header fields alone decide, and the header each one comes from.
FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 8 << 20


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    """A header value without control characters and other line ends, which would end the header for some readers."""
    return "".join(urllib.parse.quote(c) if c < " " or "\x7f" <= c < "\xa0" or c in "\u2028\u2029" else c for c in value)


def _member(raw: bytes, level: int) -> bytes:
    """raw as one gzip member with its lengths in the extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    if total >= 1 << 32 or len(raw) >= 1 << 32:
        return b"\x1f\x8b\x08\x00" + bytes(4) + b"\x00\xff" + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(raw)) + body + struct.pack("<II", zlib.crc32(raw), len(raw))


def _record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    head = [f"WARC-Type: {kind}", *(f"{k}: {_safe(v)}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    """Columns taken by name: record_id, record_type, target_uri, date, refers_to, payload_digest, payload; others are ignored."""

    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("the warc format appends only; write to a new path")
        self.path, self.gzip = options["path"], options.get("compression", "gzip") == "gzip"
        self.level, self.most = int(options.get("level", 4)), int(options.get("max_bytes", 128 << 20))

    def _rows(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in iterator:
            have = set(batch.schema.names)
            cols = {c: batch.column(c) if c in have else None for c in ("record_id", "record_type", "target_uri", "date", "refers_to", "payload_digest", "payload")}
            for i in range(batch.num_rows):
                r = {c: None if v is None else v[i].as_py() for c, v in cols.items()}
                payload = r["payload"] or b""
                kind, digest = r["record_type"] or "response", r["payload_digest"] or base32_sha1(payload)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                yield _record(
                    kind,
                    {
                        "WARC-Record-ID": f"<{r['record_id'] if r['record_id'] is not None else uuid.uuid4().urn}>",
                        "WARC-Date": r["date"] or "1970-01-01T00:00:00Z",
                        "WARC-Target-URI": r["target_uri"],
                        "WARC-Payload-Digest": f"sha1:{digest}",
                        "WARC-Refers-To": f"<{r['refers_to']}>" if r["refers_to"] is not None else None,
                        "WARC-Profile": REVISIT_PROFILE if kind == "revisit" else None,
                        "Content-Type": "application/http;msgtype=response",
                    },
                    http if kind == "revisit" else http + payload,
                )

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = _fs(self.path)
        fs.create_dir(base, recursive=True)
        files, out, size = [], None, 0
        try:
            for raw in self._rows(iterator):
                if out is None or size >= self.most:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
                    files.append((f"{base}/.{name}.part", f"{base}/{name}"))
                    out, size = fs.open_output_stream(files[-1][0], compression=None), 0
                    info = _record("warcinfo", {"WARC-Record-ID": f"<{uuid.uuid4().urn}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                    out.write(_member(info, self.level) if self.gzip else info)
                size += len(data := _member(raw, self.level) if self.gzip else raw)
                out.write(data)
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = _fs(self.path)
        fs.create_dir(base, recursive=True)
        for m in messages:
            for part, final in m.files if m else ():
                fs.move(part, final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = _fs(self.path)
        for m in messages:
            for part, _ in m.files if m else ():
                fs.delete_file(part)


@dataclass
class _Files(InputPartition):
    paths: list[str]


def _pushable(f: Filter) -> bool:
    return isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in FIELDS


def _holds(f: Filter, value: str | None) -> bool:
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    return isinstance(f, IsNotNull) or value.startswith(f.value)


class _Source:
    """A buffered file from which gzip members or plain records are read one by one, headers first."""

    def __init__(self, raw):
        self.f = io.BufferedReader(raw, 1 << 20)

    def records(self, wanted) -> Iterator[tuple[dict, bytes | None]]:
        """Each record's headers, and its block where wanted(headers) asks for it (None means: not even the headers)."""
        while start := self.f.read(2):
            if start == b"\x1f\x8b":
                yield from self._gzip(wanted)
            elif start.strip():
                yield from self._plain(start, wanted)

    def _plain(self, start: bytes, wanted) -> Iterator[tuple[dict, bytes | None]]:
        head = bytearray(start)
        while (line := self.f.readline()) not in (b"\r\n", b"\n", b""):
            head += line
        headers = _parse(bytes(head))
        size, want = int(headers.get("content-length", 0)), wanted(headers)
        if want:
            block = self.f.read(size)
        else:
            block = self.f.seek(size, io.SEEK_CUR) and None
        if want is not None:
            yield headers, block

    def _gzip(self, wanted) -> Iterator[tuple[dict, bytes | None]]:
        f, at = self.f, self.f.tell() - 2
        method, flags = f.read(8)[:2]
        end = None
        if flags & 4:
            extra = f.read(struct.unpack("<H", f.read(2))[0])
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and n == 8:
                    end = at + struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n :]
        for bit in (8, 16):
            while flags & bit and f.read(1) not in (b"\0", b""):
                pass
        f.read(2 if flags & 2 else 0)
        inflate, text = zlib.decompressobj(-15), bytearray()

        def more(size: int) -> bool:
            if inflate.eof or not (chunk := f.read(size)):
                return False
            text.extend(inflate.decompress(chunk))
            return True

        while b"\r\n\r\n" not in text and more(1024):
            pass
        head, _, _ = bytes(text).partition(b"\r\n\r\n")
        headers = _parse(head)
        want, size, first = wanted(headers), int(headers.get("content-length", 0)), len(head) + 4
        if want:
            while len(text) < first + size and more(65536):
                pass
            block = bytes(text[first : first + size])
        else:
            block = None
        if end is not None:
            f.seek(end)
        else:
            while not inflate.eof and more(65536):
                text.clear()
            f.seek(8 - len(inflate.unused_data), io.SEEK_CUR)
        if want is not None:
            yield headers, block


def _parse(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; continued lines are joined, repeated names keep the first. Lines end at line
    feeds only, with or without a carriage return: other line ends of Unicode belong to the values."""
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\n")[1:]:
        line = line.removesuffix("\r")
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip(" \t")
            continue
        name, _, value = line.partition(":")
        last = name.strip(" \t").lower()
        out.setdefault(last, value.strip(" \t"))
    return out


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.filters, self.columns = options["path"], [], schema
        self.payload, self.digest = options.get("payload", "true").lower() == "true", options.get("digest", "false").lower() == "true"
        self.target = int(options.get("partition_bytes", 0))

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if _pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Whole files, small ones together up to `partition_bytes`; the writer bounds a file by `max_bytes`. Unless told,
        partitions are a 200th of all bytes, 4 MB at least and 128 MB at most."""
        from pyarrow import fs as pafs

        fs, base = _fs(self.path)
        infos = [fs.get_file_info(base)]
        if infos[0].type == pafs.FileType.Directory:
            infos = fs.get_file_info(pafs.FileSelector(base, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.is_file and i.path.endswith((".warc", ".warc.gz")) and not i.base_name.startswith((".", "_")))
        target = self.target or min(128 << 20, max(4 << 20, sum(size for _, size in files) // 200))
        parts, held = [], 0
        for path, size in files:
            if not parts or held + size > target:
                parts.append(_Files([]))
                held = 0
            parts[-1].paths.append(path)
            held += size
        return parts or [_Files([])]

    def _wanted(self, headers: dict[str, str]) -> bool | None:
        if not all(_holds(f, self._field(headers, f.attribute[0])) for f in self.filters):
            return None
        return self.payload or self.digest or "application/http" in headers.get("content-type", "")

    @staticmethod
    def _field(headers: dict[str, str], column: str) -> str | None:
        v = headers.get(FIELDS[column])
        if v is not None and column in ("record_id", "refers_to"):
            return v.removeprefix("<").removesuffix(">")
        return v.removeprefix("sha1:") if v is not None and column == "payload_digest" else v

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, _ = _fs(self.path)
        schema = to_arrow_schema(self.columns)
        rows, held = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                for headers, block in _Source(raw).records(self._wanted):
                    row, body = {c: self._field(headers, c) for c in FIELDS} | {"headers": list(headers.items())}, block or b""
                    row["payload_bytes"] = len(body)
                    if "application/http" in headers.get("content-type", ""):
                        http, _, body = body.partition(b"\r\n\r\n")
                        row["payload_bytes"] = len(body)
                        if row["record_type"] == "revisit":  # the block is the HTTP header of the full response
                            row["payload_bytes"] = int(_parse(http).get("content-length", 0))
                    if row["record_type"] != "revisit":
                        row["payload_sha1"] = base32_sha1(body) if self.digest else None
                        row["payload"] = body if self.payload else None
                    rows.append(row)
                    held += len(body) if self.payload else 500
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcDataSource(DataSource):
    """Options: path (a file or folder, by URI); reading: payload (default true), digest (default false: the payload's
    base32 SHA-1 in payload_sha1), partition_bytes; writing: compression (gzip or none), level, max_bytes a file."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets Spark push filters to it."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32_of_hex(hexed: F.Column) -> F.Column:
    """Bare base32 of 40 hexadecimal digits: each 5 digits are 20 bits, which are 4 characters."""
    fives = [F.conv(F.substring(hexed, 1 + 5 * j, 5), 16, 10).cast("int") for j in range(8)]
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*[F.substr(letters, F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for v in fives for s in (15, 10, 5, 0)])


def records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """A WARC record for each page (page_id, url, html): columns of the writer.

    Payload is the html in UTF-8, empty where it is null. Of equal payloads of `min_revisit_bytes` or more, the one
    with the largest page_id is the response and the others revisit it; shorter ones are all responses. Pages with
    equal id and payload are alike: both responses or both revisits. A null page_id counts as smallest, and its
    record id ends in nothing.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).select("*", F.sha1("payload").alias("_sha1"), F.length("payload").alias("_len"), F.coalesce("page_id", F.lit(-(2**63))).alias("_id"))
    grouped = with_group(rows, ["_sha1", "_len"], [F.max("_id").alias("_kept")], ["_id", "url"])
    revisit = (F.col("_len") >= min_revisit_bytes) & (F.col("_id") < F.col("_kept"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return grouped.select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, urn(F.col("_kept"))).alias("refers_to"),
        base32_of_hex(F.col("_sha1")).alias("payload_digest"),
        "payload",
    )


def digest(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages to WARC files, reads those back, and returns the contract's row per page. For responses,
    length and digest are those of the payload read back; for revisits, those that their headers give. A null html is an
    empty payload, a null url no target, a null id the smallest; a payload of any length is one record."""
    spark = pages.sparkSession
    register(spark)
    path = path or fresh_path(spark, "warc")
    records(pages).write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").option("payload", "false").option("digest", "true").load(path).filter(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    return back.select(
        page("record_id").alias("page_id"), "payload_bytes", F.coalesce("payload_sha1", "payload_digest").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to")
    )


#: DuckDB SQL for digest().
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept FROM pages)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < kept THEN kept END AS refers_to
FROM p
"""
