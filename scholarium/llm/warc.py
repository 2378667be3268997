"""WARC archives: a Spark data source that writes one gzip member per record and reads byte ranges in parallel.

Read tasks get ranges of the archive files. A task scans its range for the gzip magic, takes a candidate as a
member once its head decodes to a WARC version line, and owns the records that start inside its range, also where they
end beyond it. No index and no serial pass over a file is needed.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from scholarium.llm.common import column, step
from scholarium.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, "
    "payload_bytes long, payload binary"
)
MANIFEST = "_archives.json"
READ_BYTES = 1 << 18


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def member(row: dict) -> bytes:
    """One record as a gzip member. Revisits carry the HTTP head of the full payload and no body."""
    payload = row["payload"] or b""
    body = b"" if row["record_type"] == "revisit" else payload
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_clean(row['record_id'])}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
    ]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if row["refers_to"] is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{_clean(row['refers_to'])}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    squeeze = zlib.compressobj(5, zlib.DEFLATED, 31)
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"
    return squeeze.compress(whole) + squeeze.flush()


def record(raw: bytes) -> dict:
    """The fields of a decoded record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = len(payload)
    for line in http.decode("latin-1").split("\r\n"):
        name, _, value = line.partition(":")
        if name.strip().lower() == "content-length":
            length = int(value)
    kind = fields.get("warc-type", "")
    sha1 = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and sha1 != digest(payload):
        raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
    bare = lambda v: None if v is None else v.removeprefix("<").removesuffix(">")
    return {
        "record_id": bare(fields.get("warc-record-id")), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
        "payload_digest": sha1, "refers_to": bare(fields.get("warc-refers-to")), "payload_bytes": length, "payload": payload,
    }


def _decode(f, at: int, size: int) -> tuple[bytes, int] | None:
    """The member that starts at ``at`` and where it ends, or None if none starts there."""
    inflate, out, pos = zlib.decompressobj(31), [], at
    while not inflate.eof:
        chunk = f.read_at(min(READ_BYTES if out else 4096, size - pos), pos) if pos < size else b""
        if not chunk:
            return None
        try:
            out.append(inflate.decompress(chunk))
        except zlib.error:
            return None
        pos += len(chunk)
        start = b"".join(out) if len(out) < 4 else out[0]
        if len(start) >= 7 and not start.startswith(b"WARC/1."):
            return None
    return b"".join(out), pos - len(inflate.unused_data)


def members(f, size: int, start: int, end: int):
    """Decoded members whose first byte lies in start..end."""
    at = start
    while at < end:
        block = f.read_at(min(READ_BYTES, size - at), at)
        hit = block.find(MAGIC)
        if hit < 0:
            if at + len(block) >= size:
                return
            at += max(1, len(block) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= end:
            return
        found = _decode(f, at, size)
        if found is None:
            at += 1
            continue
        raw, at = found
        yield raw


@dataclass
class Range(InputPartition):
    path: str
    size: int
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, path: str, split: int, payload: bool):
        self.path, self.split, self.payload = path, split, payload

    def partitions(self):
        fs, root = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
            files = json.loads(f.read())
        ranges = [Range(name, size, at, min(size, at + self.split)) for name, size in files for at in range(0, size, self.split)]
        return ranges or [Range("", 0, 0, 0)]

    def read(self, partition: Range):
        if not partition.size:
            return
        fs, root = pafs.FileSystem.from_uri(self.path)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        rows, held = [], 0
        with fs.open_input_file(f"{root}/{partition.path}") as f:
            for raw in members(f, partition.size, partition.start, partition.end):
                r = record(raw)
                if r["record_type"] not in ("response", "revisit"):
                    continue
                if not self.payload:
                    r["payload"] = None
                rows.append(r)
                held += len(r["payload"] or b"") + 200
                if held > 4 << 20:
                    yield self._batch(rows, names, types)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows, names, types)

    @staticmethod
    def _batch(rows, names, types):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        fs, root = pafs.FileSystem.from_uri(self.path)
        # A new name for each attempt; only files of committed attempts enter the manifest.
        name, size, out = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)  # members are compressed one by one
                size += out.write(member(row))
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, size)

    def commit(self, messages):
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(sorted([m.name, m.size] for m in messages if m and m.name)).encode())

    def abort(self, messages):
        """Files of failed attempts are in no manifest."""


class WarcSource(DataSource):
    """``format("warc")``: options ``split_bytes`` and ``payload`` (false: only headers and lengths) for reading."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def _path(self):
        path = self.options["path"]
        return path if "://" in path or path.startswith("file:") else f"file://{path}"

    def reader(self, schema):
        return WarcReader(self._path(), int(self.options.get("split_bytes", 16 << 20)), self.options.get("payload", "true") == "true")

    def writer(self, schema, overwrite):
        return WarcWriter(self._path())


def as_records(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Records to write, with the columns of the data source.

    Of pages with equal payloads of at least ``min_bytes`` bytes that with the largest id is the response and the others
    revisit it; null ids are smaller than all others, and rows that repeat the largest id are all responses. Null html is
    an empty payload.
    """

    @F.arrow_udf("string")
    def sha1(payload: pa.Array) -> pa.Array:
        return pa.array([digest(x) for x in payload.to_pylist()], pa.string())

    body = F.coalesce(column(pages, html), F.lit("")).cast("binary")
    rows = pages.select(column(pages, key).alias("id"), column(pages, url).cast("string").alias("target_uri"), body.alias("payload"))
    rows = rows.withColumn("payload_digest", sha1("payload"))
    # Only payloads that several pages share take part; one row each, combined before the shuffle.
    shared = rows.where(F.octet_length("payload") >= min_bytes).groupBy("payload_digest").agg(
        F.max("id").alias("first"), F.count("*").alias("n")
    )
    shared = step(shared.where("n > 1").select(F.col("payload_digest").alias("d"), "first"))
    joined = rows.join(shared, F.col("payload_digest") == F.col("d"), "left")
    revisit = F.col("d").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return joined.select(
        name(F.col("id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        "payload_digest", F.when(revisit, name(F.col("first"))).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), "payload",
    )


def write_archives(records: DataFrame, path: str) -> None:
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").save(path)


def read_archives(spark, path: str, split_bytes: int = 16 << 20, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("split_bytes", split_bytes).option("payload", str(payload).lower()).load(path)


def archived_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write all pages to archives, read these back: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(as_records(pages), path)
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS BIGINT)")
    return read_archives(spark, path, payload=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
