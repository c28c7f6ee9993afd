"""WARC 1.1 archives as a Spark data source, and revisit records for equal payloads.

    register(spark)
    records.write.format("warc").mode("append").save(folder)
    spark.read.format("warc").option("payload", "false").load(folder).filter("record_type = 'revisit'")

Each record is a gzip member of its own whose header holds its length, so a reader inflates
the first bytes, tests the pushed predicates on the WARC headers, and steps over records and
payloads that nobody asked for.  A write lists the files of its successful tasks, and where
they may be split, in a manifest of its own; files of lost attempts are in none and are not read.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull,
    StringStartsWith, WriterCommitMessage)

from gleaner.session import Steps, materialize

SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
          "payload_length long, payload binary")
ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
                   ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()),
                   ("payload", pa.binary())])
# Header names by column; the length of the whole payload is an extension field, as a revisit doesn't hold it.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI",
           "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "WARC-Payload-Length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
MANIFEST = "_manifest-"


def storage(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _bracketed(name: str) -> bool:
    return name in ("record_id", "refers_to")


def encode_record(row: dict, date: str) -> bytes:
    """One record as a gzip member with its lengths in the header.

    Line ends in header values are written as percent escapes.  A null value has no header.
    """
    payload = row["payload"] or b""
    lines = ["WARC/1.1", f"WARC-Date: {date}"]
    for column, name in HEADERS.items():
        if row[column] is not None:
            value = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", str(row[column]))
            lines.append(f"{name}: <{value}>" if _bracketed(column) else f"{name}: {value}")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    else:
        block += payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    data = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    total = 24 + len(body) + 8
    extra = struct.pack("<2sHII", b"sl", 8, total if total < 1 << 32 else 0, len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(data: bytes) -> dict[str, str]:
    """Fields of a header block by lower-case name."""
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if v}


class RecordFile:
    """The records of one file from one offset on: headers first, content only when asked for."""

    def __init__(self, source: io.BufferedReader, start: int, end: int):
        self.source, self.at, self.end = source, start, end
        self.inflated = 0  # bytes given out by the decompressor, for tests

    def __iter__(self) -> Iterator[tuple[dict[str, str], object]]:
        while self.at < self.end:
            self.source.seek(self.at)
            magic = self.source.read(2)
            if not magic:
                return
            self.source.seek(self.at)
            yield from self._member() if magic == b"\x1f\x8b" else self._plain()

    def _member(self) -> Iterator[tuple[dict[str, str], object]]:
        """A gzip member; one without lengths in its header must be inflated to find its end."""
        start = self.at
        head = self.source.read(24)
        known = head[3] == 4 and head[12:14] == b"sl" and struct.unpack("<I", head[16:20])[0] or 0
        self.source.seek(start)
        inflate, data, content = zlib.decompressobj(31), b"", None

        def more(size: int) -> bytes:
            fresh = inflate.unconsumed_tail or self.source.read(4096)
            out = inflate.decompress(fresh, size)
            if not fresh and not out and not inflate.eof:
                raise EOFError("a record is cut short")
            self.inflated += len(out)
            return out

        while (cut := data.find(b"\r\n\r\n")) < 0 and not inflate.eof:
            data += more(2048)
        fields = parse_headers(data[:cut])

        def block() -> bytes:
            nonlocal content
            if content is None:
                parts = [data[cut + 4:]]
                while not inflate.eof:
                    parts.append(more(1 << 20))
                content = b"".join(parts)[:int(fields["content-length"])]
            return content

        yield fields, block
        if known:
            self.at = start + known
        else:
            block()
            self.at = self.source.tell() - len(inflate.unused_data)

    def _plain(self) -> Iterator[tuple[dict[str, str], object]]:
        start, data = self.at, b""
        while (cut := data.find(b"\r\n\r\n")) < 0:
            fresh = self.source.read(2048)
            if not fresh:
                if data.strip():
                    raise EOFError("a record is cut short")
                self.at = self.end
                return
            data += fresh
        fields = parse_headers(data[:cut])
        length = int(fields["content-length"])

        def block() -> bytes:
            self.source.seek(start + cut + 4)
            return self.source.read(length)

        yield fields, block
        self.at = start + cut + 4 + length + 4


def as_row(fields: dict[str, str]) -> dict:
    row = {}
    for column, name in HEADERS.items():
        value = fields.get(name.lower())
        row[column] = value[1:-1] if value and _bracketed(column) else value
    row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
    return row


def payload_of(block: bytes, fields: dict[str, str]) -> bytes:
    """The block without its HTTP header, if it is an HTTP message."""
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.filters = path, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, IN, prefix and null tests on header columns are answered here."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, IsNull, IsNotNull)) and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def wants(self, row: dict) -> bool:
        for f in self.filters:
            value = row[f.attribute[0]]
            if isinstance(f, IsNull):
                good = value is None
            elif value is None:
                good = False
            elif isinstance(f, EqualTo):
                good = value == f.value
            elif isinstance(f, In):
                good = value in f.value
            elif isinstance(f, StringStartsWith):
                good = value.startswith(f.value)
            else:
                good = True
            if not good:
                return False
        return True

    def partitions(self) -> list[Part]:
        """Splits from the manifests; without any, each .warc or .warc.gz file is one."""
        store, root = storage(self.path)
        files = store.get_file_info(fs.FileSelector(root, recursive=True))
        lists = [f.path for f in files if f.base_name.startswith(MANIFEST)]
        parts = []
        for name in sorted(lists):
            with store.open_input_stream(name) as source:
                for file, cuts in json.loads(source.read()):
                    parts += [Part(f"{root}/{file}", a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        if not lists:
            parts = [Part(f.path, 0, f.size) for f in files if re.search(r"\.warc(\.gz)?$", f.path)]
        return sorted(parts, key=lambda p: (p.path, p.start)) or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.end:
            return
        store, _ = storage(self.path)
        rows, held = [], 0
        with store.open_input_file(partition.path) as file:
            for fields, block in RecordFile(io.BufferedReader(file, 1 << 20), partition.start, partition.end):
                row = as_row(fields)
                if not self.wants(row):
                    continue
                row["payload"] = payload_of(block(), fields) if self.payload else None
                rows.append(row)
                held += 256 + len(row["payload"] or b"")
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    file: str
    cuts: list[int]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str):
        self.path, self.date = path, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = storage(self.path)
        store.create_dir(root, recursive=True)
        name, at, cuts = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    record = encode_record(row, self.date)
                    out.write(record)
                    at += len(record)
                    if at - cuts[-1] >= SPLIT_BYTES:
                        cuts.append(at)
        return Written(name, cuts if cuts[-1] == at else [*cuts, at])

    def commit(self, messages: list[Written | None]) -> None:
        store, root = storage(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([[m.file, m.cuts] for m in messages if m]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = storage(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{root}/{m.file}")


class WarcSource(DataSource):
    """Options: path; payload (true), whether contents are decoded; date, of the records written."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with predicate push-down to Python sources on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


NAME = "urn:page:"


def records(pages: DataFrame, steps: Steps, least_bytes: int = 100) -> DataFrame:
    """The archive's records for pages (page_id, url, html), one a row.

    Of equal payloads of at least `least_bytes`, the smallest page_id's is the response and
    the others revisit it; rows that repeat the smallest page_id are responses too.  Shorter
    payloads are always responses.  A null html is an empty payload.  A null page_id counts
    as larger than any other; if no row has one, all are responses.  The payloads that occur
    more than once are written to `steps` first, so that Spark can split the rows of a hot one.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("target_uri"),
                        F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("long"))
    first = steps.keep(rows.filter(F.col("payload_length") >= least_bytes).groupBy("sha").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("sha").alias("same"), "first"))
    rows = rows.join(first, (F.col("sha") == F.col("same")) & (F.col("payload_length") >= least_bytes), "left")
    again = F.col("same").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select(
        F.concat(F.lit(NAME), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(again, F.concat(F.lit(NAME), F.col("first").cast("string"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.col("sha")).alias("payload_digest"), "payload_length",
        F.when(~again, F.col("payload")).alias("payload"))


def page_id(name: str) -> Column:
    return F.expr(f"try_cast(substring({name}, {len(NAME) + 1}) as bigint)")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the records of pages, read the archives back, and describe every page from what was read.

    Columns page_id, payload_bytes, payload_digest, record_type, refers_to.  Length and digest
    of a response are taken from its decoded payload, those of a revisit from its headers; its
    record's content is never inflated.
    """
    spark = pages.sparkSession
    register(spark)
    with Steps(spark, "warc") as steps:
        folder = f"{steps.root}/archive"
        records(pages, steps).write.format("warc").mode("append").save(folder)
        full = spark.read.format("warc").load(folder).filter("record_type = 'response'").select(
            page_id("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
        light = spark.read.format("warc").option("payload", "false").load(folder).filter("record_type = 'revisit'").select(
            page_id("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
            F.substring("payload_digest", 8, 64).alias("payload_digest"), "record_type",
            page_id("refers_to").alias("refers_to"))
        return materialize(full.union(light))
