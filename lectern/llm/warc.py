"""WARC archives as a Python data source, and a writer that stores equal payloads once.

Reading plans one partition for each file (the writer rotates files, so that none grows with the data), takes equality and
range predicates on record type and other header columns from the plan, parses a record's header first, and seeks past
payloads of records that a predicate rejects or whose payload no column of the schema wants. Writing makes one file or more
for each task; a commit names the files of successful tasks, and readers take only those, so that lost and repeated tasks
leave nothing behind.

Null html counts as empty. Payloads under SHORTEST bytes are never revisits. Rows with a null page_id are responses of
their own; rows that share page_id and payload are all responses.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import bounded_batches, hot_keys, saved, shared_dir, sized, spread_join, text_bytes

SHORTEST = 100
#: A file is closed when it has grown to this size, and a batch of records that a reader returns to this many.
FILE_BYTES, READ_ROWS, READ_BYTES = 64 << 20, 500, 4 << 20
SCHEMA = "page_id long, record_type string, target_uri string, refers_to long, payload_digest string, payload_bytes long, payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed: archives of the same rows are the same bytes.
DATE = "2000-01-01T00:00:00Z"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI, local or remote, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def record(page_id: int | None, kind: str, uri: str | None, refers_to: int | None, digest: str, size: int, payload: bytes) -> bytes:
    """One record; the payload is deflated, which its header says."""
    block = zlib.compress(payload, 1) if kind == "response" else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>" if page_id is not None else f"<urn:digest:{digest}>"), ("WARC-Date", DATE)]
    if uri is not None:
        head.append(("WARC-Target-URI", uri.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    head += [("X-Payload-Length", str(size)), ("Content-Encoding", "deflate"), ("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parsed(head: dict[str, str]) -> dict:
    """Columns of a record from its header."""
    page = head.get("warc-record-id", "").strip("<>")
    refers = head.get("warc-refers-to", "").strip("<>")
    uri = head.get("warc-target-uri")
    return {
        "page_id": int(page[9:]) if page.startswith("urn:page:") else None,
        "record_type": head.get("warc-type"),
        "target_uri": None if uri is None else uri.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%"),
        "refers_to": int(refers[9:]) if refers.startswith("urn:page:") else None,
        "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha256:") or None,
        "payload_bytes": int(head["x-payload-length"]) if "x-payload-length" in head else None,
    }


_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


@dataclass
class FilePart(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, [f.name for f in schema.fields]
        self.arrow = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[dict(x.split() for x in SCHEMA.split(", "))[n]] for n in self.names]
        self.filters: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] != "payload":
                self.filters.append((type(f), f.attribute[0], f.value))
            elif not (isinstance(f, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] == "record_type"):
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = filesystem(self.path)
        found = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.is_file)
        commits = [x for x in found if x.rsplit("/", 1)[-1].startswith("_committed-")]
        if commits:
            files = []
            for c in commits:
                with fs.open_input_stream(c) as f:
                    files += [f"{root}/{name}" for name in json.loads(f.read())]
        else:
            files = [x for x in found if x.endswith(".warc")]
        return [FilePart(x) for x in sorted(files)] or [FilePart("")]

    def wanted(self, row: dict) -> bool:
        return all(row[name] is not None and _TESTS[kind](row[name], value) for kind, name, value in self.filters)

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = filesystem(self.path)
        with_payload = "payload" in self.names
        rows, size = [], 0
        with fs.open_input_file(partition.path) as f:
            for row, block, at in headers(f):
                if not self.wanted(row):
                    continue
                if with_payload:
                    f.seek(at)
                    body = f.read(block[0])
                    row["payload"] = zlib.decompress(body) if block[1] and body else body
                    size += len(row["payload"])
                rows.append([row[n] for n in self.names])
                if len(rows) >= READ_ROWS or size > READ_BYTES:
                    yield self.batch(rows)
                    rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), self.arrow, strict=True)], names=self.names)


def headers(f) -> Iterator[tuple[dict, tuple[int, bool], int]]:
    """(columns, (length, deflated) of the block, its offset) of each record; blocks are not read but for what a buffer holds."""
    end, at, buffer, start = f.size(), 0, b"", 0
    while at < end:
        if not start <= at < start + len(buffer):
            f.seek(at)
            buffer, start = f.read(1 << 16), at
        stop = buffer.find(b"\r\n\r\n", at - start)
        while stop < 0:
            f.seek(start + len(buffer))
            more = f.read(1 << 16)
            if not more:
                return
            buffer += more
            stop = buffer.find(b"\r\n\r\n", at - start)
        lines = buffer[at - start : stop].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length, block = int(head.get("content-length", 0)), start + stop + 4
        yield parsed(head), (length, head.get("content-encoding") == "deflate"), block
        at = block + length + 4


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for b in iterator:
            for r in b.to_pylist():
                if out is None or size > FILE_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc")
                    out, size = fs.open_output_stream(f"{root}/{names[-1]}"), 0
                one = record(r["page_id"], r["record_type"], r["target_uri"], r["refers_to"], r["payload_digest"], r["payload_bytes"], r["payload"] or b"")
                out.write(one)
                size += len(one)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_committed-{uuid.uuid4().hex}") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            for x in m.files if m else ():
                fs.delete_file(f"{root}/{x}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame) -> DataFrame:
    """A record for each row of (page_id, url, html); payloads of revisits are null. Payloads are never shuffled by digest."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), text_bytes("html").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    keys = saved(rows.where(f"payload_bytes >= {SHORTEST} and page_id is not null").select("page_id", "payload_digest"), "warc-keys")
    first = keys.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    again = saved(spread_join(keys, first, ["payload_digest"], "inner", hot_keys(keys, ["payload_digest"], "warc"), "warc").where("page_id <> first").select("page_id", F.col("payload_digest").alias("of"), F.col("first").alias("refers_to")).distinct(), "warc-revisits")
    out = rows.join(sized(again), (rows.page_id == again.page_id) & (rows.payload_digest == again.of), "left").drop(again.page_id).drop("of")
    revisit = F.col("refers_to").isNotNull()
    return out.select("page_id", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", "refers_to", "payload_digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"))


def archived(pages: DataFrame, path: str) -> None:
    """Write the archives of `pages` into a folder that all executors reach."""
    register(pages.sparkSession)
    bounded_batches(pages.sparkSession)
    records(pages).write.format("warc").mode("append").option("path", path).save()


def read(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(columns).option("path", path).load()


def query(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archived(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    whole = read(spark, path).where(F.col("record_type") == "response")
    whole = whole.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")
    again = read(spark, path, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long").where(F.col("record_type") == "revisit")
    return whole.unionByName(again.select(whole.columns))


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {SHORTEST} GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= {SHORTEST}
"""
