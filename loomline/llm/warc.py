"""WARC archives as a Python data source, read and written.

Reading plans a partition per file; predicates on record_type, record_id, target_uri and payload_digest are pushed down.
A record's headers are parsed first: where they fail a predicate, the block is passed over, never kept, and no text of it
decoded. Where the option payload is "false", only the HTTP header at the start of a block is kept, to tell the payload's
length, and the rest is passed over too. Writing gives each task files of its own, rolled at ROLL bytes, every record a
gzip member; each job adds a manifest that names the files of its committed tasks, so what a lost executor left is not
read, appended jobs are all read, and overwriting takes the older manifests away once the new one stands. A folder
without manifests, as other tools write it, is read by its files' names.

Header names count in any case. payload_bytes is the length of the block behind its HTTP header, and of a revisit, which
has none, the length that the HTTP header gives. Null payloads are empty records; null ids, addresses and dates are left
out of the headers and read back as null. Line ends in header values are percent-encoded. Repeated rows are records of
their own; an empty table makes an archive without records. Columns of a table that the format has no place for are not written.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from loomline.llm.common import bitmap, cut, in_bitmap, lookup, prefix

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
WRITTEN = ["record_id", "record_type", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes", "payload"]
#: Bytes of a file before the next is begun, and records handed on at once.
ROLL, BATCH, BATCH_BYTES, STEP = 64 << 20, 1024, 16 << 20, 1 << 16
MANIFEST = "_manifest-"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADER = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else re.sub(r"^file:/*", "/", path))


def record(row: dict) -> bytes:
    """One record. A revisit keeps the headers of the response, whose length stays that of the full payload."""
    revisit = row["record_type"] == "revisit"
    size = row["payload_bytes"] if row["payload_bytes"] is not None else len(row["payload"] or b"")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + (row["payload"] or b"")
    values = row | {"record_id": f"<{row['record_id']}>" if row["record_id"] else None, "refers_to": f"<{row['refers_to']}>" if row["refers_to"] else None, "payload_digest": f"sha1:{row['payload_digest']}" if row["payload_digest"] else None}
    lines = ["WARC/1.1"]
    for name, header in _HEADER.items():
        if values[name] is not None:
            lines.append(f"{header}: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", str(values[name])))
    lines += [f"WARC-Profile: {PROFILE}"] * revisit + ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


@dataclass
class Committed(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(record(row)) + packer.flush()
                out.write(member)
                size += len(member)
                if size >= ROLL:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Committed(files)

    def commit(self, messages: list) -> None:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        older = [i.path for i in manifests(fs, root)] if self.overwrite else []
        name = f"{root}/{MANIFEST}{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{name}.tmp") as out:
            out.write(json.dumps(sorted(f for m in messages if m for f in m.files)).encode())
        fs.move(f"{name}.tmp", f"{name}.json")
        for path in older:
            fs.delete_file(path)

    def abort(self, messages: list) -> None:
        """Nothing to undo: files that no manifest names are not read."""


class Part(InputPartition):
    def __init__(self, files: list[str]) -> None:
        self.files = files


def manifests(fs: pafs.FileSystem, root: str) -> list[pafs.FileInfo]:
    return [i for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if i.base_name.startswith(MANIFEST) and i.base_name.endswith(".json")]


def members(fs: pafs.FileSystem, file: str, wanted) -> Iterator[tuple[dict, bytes | None]]:  # noqa: ANN001
    """(headers, block) of each record, header names in lower case. wanted(headers) tells how much of the block is kept:
    all (True), nothing (False, the block is None) or what comes before the first empty line (None)."""
    with fs.open_input_stream(file, compression=None) as stream:
        raw = stream.read(STEP)
        packed = raw[:2] == b"\x1f\x8b"
        while raw:
            gz = zlib.decompressobj(31) if packed else None

            def more(gz: object = gz) -> bytes:
                nonlocal raw
                if gz is None:
                    got, raw = raw, stream.read(STEP)
                    return got
                while not gz.eof:
                    got = gz.decompress(gz.unconsumed_tail or raw, STEP)
                    if gz.eof:
                        raw = gz.unused_data or stream.read(STEP)
                    elif not gz.unconsumed_tail:
                        raw = stream.read(STEP)
                        if not raw and not got:
                            raise EOFError(f"{file} ends within a record")
                    if got:
                        return got
                return b""

            held = b""
            while (end := held.find(b"\r\n\r\n")) < 0:
                if not (got := more()):
                    break
                held = (held + got).lstrip(b"\r\n") if not held else held + got
            if end < 0:
                if held.strip():
                    raise ValueError(f"{file} holds a record without headers")
                continue
            headers = {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in held[:end].decode("utf-8", "replace").split("\r\n")[1:]) if colon}
            left, keep = int(headers.get("content-length", 0)), wanted(headers)
            body, parts, seen = held[end + 4 :], [], b""
            while True:
                if keep:
                    parts.append(body[:left])
                elif keep is None and b"\r\n\r\n" not in seen:
                    seen += body[:left]
                over, left = body[left:], left - min(left, len(body))
                if not left:
                    break
                if not (body := more()):
                    raise EOFError(f"{file} ends within a record")
            if packed:
                while more():
                    pass
            else:
                raw = over.lstrip(b"\r\n") + raw
                if not raw:
                    raw = stream.read(STEP)
            yield headers, b"".join(parts) if keep else seen.partition(b"\r\n\r\n")[0] if keep is None else None


class Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in ("record_type", "record_id", "target_uri", "payload_digest") and isinstance(f, EqualTo | In | StringStartsWith | IsNotNull):
                self.tests.append((name, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Part]:
        fs, root = open_fs(self.path)
        names = []
        if listed := manifests(fs, root):
            for info in listed:
                with fs.open_input_stream(info.path) as stream:
                    names += json.loads(stream.read())
        else:
            names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(root)) if i.base_name.endswith((".warc", ".warc.gz"))]
        return [Part([f"{root}/{n}"]) for n in sorted(names)] or [Part([])]

    def passes(self, headers: dict) -> bool:
        for name, kind, value in self.tests:
            own = plain(headers, name)
            if own is None or not {"EqualTo": lambda: own == value, "In": lambda: own in value, "StringStartsWith": lambda: own.startswith(value), "IsNotNull": lambda: True}[kind]():
                return False
        return True

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(self.path)
        rows, size = [], 0

        def wanted(headers: dict) -> bool | None:
            if not self.passes(headers):
                return False
            return True if self.payload else None if is_http(headers) else False

        for file in partition.files:
            for headers, block in members(fs, file, wanted):
                if block is None and not self.passes(headers):
                    continue
                total = int(headers.get("content-length", 0))
                http, payload = b"", block or b""
                if is_http(headers):
                    http, _, payload = block.partition(b"\r\n\r\n") if self.payload else (block, b"", b"")
                    total = max(0, total - len(http) - 4)
                kind = plain(headers, "record_type")
                told = re.search(rb"(?im)^content-length: *(\d+)", http) if kind == "revisit" else None
                rows.append({n: plain(headers, n) for n in _HEADER} | {"payload_bytes": int(told[1]) if told else total, "headers": list(headers.items()), "payload": payload if self.payload and kind != "revisit" else None})
                size += len(payload)
                if len(rows) >= BATCH or size >= BATCH_BYTES:
                    yield table(rows)
                    rows, size = [], 0
        if rows:
            yield table(rows)


def is_http(headers: dict) -> bool:
    return "application/http" in headers.get("content-type", "").lower()


def plain(headers: dict, name: str) -> str | None:
    value = headers.get(_HEADER[name].lower())
    if value is None:
        return None
    return value.removeprefix("sha1:") if name == "payload_digest" else value.strip("<>") if name in ("record_id", "refers_to") else value


def table(rows: list[dict]) -> pa.RecordBatch:
    kinds = [(n, pa.string()) for n in _HEADER] + [("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Reader:
        return Reader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema: object, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets the session push filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def with_revisits(pages: DataFrame, key: str, payload: str, least: int = 0) -> DataFrame:
    """pages with _refers: of rows whose payloads are equal and have least bytes, all but the largest key refer to it.

    Keys and digests alone tell which payloads stand more than once; a broadcast bitmap of their digests tells which rows may
    be such, and only those move.
    """
    inner = prefix(*pages.columns, "_refers")
    own, long, top, n = (f"{inner}{x}" for x in ("sum", "long", "top", "n"))
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    marked = pages.withColumn(own, F.unhex(F.sha2(body, 256))).withColumn(long, F.octet_length(body) >= least)
    several = marked.where(F.col(long)).groupBy(own).agg(F.max(key).alias(top), F.count(F.lit(1)).alias(n)).where(F.col(n) > 1)
    groups = cut(several, "equal")
    found, total = bitmap(groups, own), groups.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    alone = in_bitmap(marked, own, found, "left_anti").withColumn(top, F.lit(None).cast(pages.schema[key].dataType))
    joined = lookup(in_bitmap(marked, own, found, "left_semi"), groups, own, n, total).drop(n)
    refers = F.when(F.col(long) & ~F.col(top).eqNullSafe(F.col(key)), F.col(top)).alias("_refers")
    return alone.unionByName(joined).select(*[c for c in pages.columns if c != "_refers"], refers)


def write_pages(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives a record per row, equal payloads of least bytes as revisits of the row with the largest key.

    The key is the record's id, urn:page:<key>; rows with a null key have a record without id.
    """
    register(pages.sparkSession)
    own = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("body"))
    rows = with_revisits(own, "key", "body", least).withColumn("_digest", F.sha1("body"))
    name = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    hexed = F.unhex("_digest")
    rows.select(
        name(F.col("key")).alias("record_id"),
        F.when(F.col("_refers").isNotNull(), "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        name(F.col("_refers")).alias("refers_to"),
        base32(hexed).alias("payload_digest"),
        F.octet_length("body").cast("long").alias("payload_bytes"),
        F.when(F.col("_refers").isNull(), F.col("body")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def base32(digest20: object) -> object:
    """Upper-case base32 of 20 bytes, of which each 5 make 8 letters."""
    hexed = F.hex(digest20)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    number = lambda i: F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 10).cast("long")
    each = [F.substring(F.lit(letters), (F.shiftright(number(i), 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(4) for j in range(8)]
    return F.concat(*each)
