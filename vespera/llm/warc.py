"""WARC archives: a writer, and a sequential reader for one gzip member per record.

Writing. Payload digests are compared first: of equal payloads of at least ``min_bytes`` bytes the
record with the largest id is a response and the others are revisits of it; only digests, never payloads, are
grouped, and a hot payload is pre-aggregated. Each task then streams its rows into archives of
about ``roll_bytes`` in the shared folder, under names of its own attempt. A manifest table,
committed by Spark, lists the archives of the attempts that won; others are never read.

Reading. A task takes whole archives of the manifest and walks each from start to end in small
reads: zlib inflates one member at a time, the header block is parsed, the content length
frames the block, and SHA-1 digests of block and payload are verified. A reader holds one
record and one read buffer.

Paths. Executors open archives in local or mounted folders (file), hdfs, S3 (s3, s3a, s3n), Google (gs, gcs) and Azure
(abfs, abfss) stores, by the names that Spark gives them.

Defined results: null html is the empty payload; very long payloads are streamed through zlib, one record at a time;
other columns than id, url and html are not read, whatever their names; rows that share the largest id of their payload
are responses all of them; a null id is written as an absent one and sorts before all others (if
every copy has a null id, all are responses); an empty table gives no archive and an empty result. A damaged record raises
:class:`WarcError` that names the archive and the offset.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vespera.llm.common import keep, new_dir

#: Fixed values of the format.
VERSION = b"WARC/1.1"
CRLF = b"\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
ID_PREFIX = "<urn:x-page:"
READ = 1 << 16


class WarcError(ValueError):
    """A record that breaks the format or fails its digest."""


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"{ID_PREFIX}{'' if page_id is None else page_id}>"


def _page_id(name: str | None) -> int | None:
    digits = (name or "")[len(ID_PREFIX) : -1]
    return int(digits) if digits else None


def pack_record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, level: int = 3) -> bytes:
    """One record as one gzip member."""
    if kind == "response":
        block = HTTP_HEAD % len(payload) + payload
    else:
        block = HTTP_HEAD % len(payload)
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", _digest(payload)),
        ("WARC-Block-Digest", _digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        fields += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    head = VERSION + CRLF + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + CRLF
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(head + block + CRLF + CRLF) + deflate.flush()


class _Member:
    """Bytes of the current gzip member of a stream, inflated as they are asked for."""

    def __init__(self, source: BinaryIO):
        self.source, self.raw, self.offset = source, b"", 0
        self.inflate: zlib._Decompress | None = None
        self.ready = bytearray()

    def open(self) -> bool:
        """Begin the next member; False at the end of the archive."""
        if not self.raw:
            self.raw = self.source.read(READ)
        self.inflate, self.ready = zlib.decompressobj(31), bytearray()
        return bool(self.raw)

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        if not self.raw:
            self.raw = self.source.read(READ)
        before = len(self.raw)
        new = self.inflate.decompress(self.raw, READ)
        if not before and not new and not self.inflate.eof:
            raise WarcError(f"the archive ends within a record, after byte {self.offset}")
        self.ready += new
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.offset += before - len(self.raw)
        return True

    def line(self) -> bytes:
        at = 0
        while (end := self.ready.find(CRLF, at)) < 0:
            at = max(0, len(self.ready) - 1)
            if not self._more():
                raise WarcError(f"a header has no end, before byte {self.offset}")
        out = bytes(self.ready[:end])
        del self.ready[: end + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self._more():
                raise WarcError(f"a block is shorter than its content length, before byte {self.offset}")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def close(self) -> None:
        """The record must end with two line ends, and the member with the record."""
        while self._more():
            pass
        if self.ready != CRLF + CRLF:
            raise WarcError(f"a record is not followed by two line ends, before byte {self.offset}")


def read_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers with lower-case names, HTTP header, payload) of each record; digests are verified."""
    member = _Member(source)
    while member.open():
        if member.line() != VERSION:
            raise WarcError(f"no record begins before byte {member.offset}")
        headers: dict[str, str] = {}
        while line := member.line():
            name, colon, value = line.decode().partition(":")
            if not colon:
                raise WarcError(f"a header line without a colon, before byte {member.offset}")
            headers[name.lower()] = value.strip()
        block = member.take(int(headers["content-length"]))
        member.close()
        if headers.get("warc-block-digest", _digest(block)) != _digest(block):
            raise WarcError(f"block digest differs, before byte {member.offset}")
        head, gap, payload = block.partition(CRLF + CRLF)
        if headers["warc-type"] == "response" and headers.get("warc-payload-digest") != _digest(payload):
            raise WarcError(f"payload digest differs, before byte {member.offset}")
        yield headers, head + gap, payload


#: Schemes of Hadoop's file systems and those under which Arrow opens the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "abfss": "abfs"}


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, mark, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + mark + rest)


def _write_archives(batches: Iterator[pa.RecordBatch], folder: str, roll_bytes: int, level: int) -> Iterator[pa.RecordBatch]:
    fs, base = _open(folder)
    names: list[str] = []
    counts: list[int] = []
    out = None
    size = 0
    for batch in batches:
        for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
            if out is None:
                names.append(f"{uuid.uuid4().hex}.warc.gz")
                counts.append(0)
                out, size = fs.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
            record = pack_record(page_id, url, html or b"", "revisit" if revisit else "response", refers_to, level)
            out.write(record)
            size += len(record)
            counts[-1] += 1
            if size >= roll_bytes:
                out.close()
                out = None
    if out is not None:
        out.close()
    yield pa.record_batch([pa.array([f"{folder}/{n}" for n in names], pa.string()), pa.array(counts, pa.int64())], ["path", "records"])


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000, roll_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Write every row as a record; returns the manifest (path, records)."""
    spark = pages.sparkSession
    folder = folder or new_dir(spark, "warc")
    _make(spark, folder)
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("n", F.length("html"))
    # Which payloads occur more than once: digests only, pre-aggregated.
    groups = rows.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.count("*").alias("copies"), F.max("page_id").alias("best"))
    repeated = keep(groups.where("copies > 1").select("digest", "n", "best"), "warc-groups")
    joined = rows.join(repeated, ["digest", "n"], "left").withColumn("revisit", F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best")))
    joined = joined.select("page_id", "url", "html", "best", "revisit")
    manifest = joined.mapInArrow(lambda it: _write_archives(it, folder, roll_bytes, level), "path string, records long")
    return keep(manifest, "warc-manifest")


def _make(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def _read_archives(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            fs, path = _open(uri)
            rows: list[tuple] = []
            size = 0
            with fs.open_input_stream(path, compression=None) as source:
                try:
                    for headers, http, payload in read_records(source):
                        sha1 = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
                        length = int(http.rpartition(b"Content-Length: ")[2].split()[0])
                        if headers["warc-type"] == "response" and length != len(payload):
                            raise WarcError("the payload is not as long as its HTTP header says")
                        rows.append((_page_id(headers["warc-record-id"]), headers["warc-target-uri"], length, sha1, headers["warc-type"], _page_id(headers.get("warc-refers-to")), payload if payloads else None))
                        size += len(payload)
                        if len(rows) >= 10_000 or payloads and size >= 8 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                except WarcError as e:
                    raise WarcError(f"{uri}: {e}") from None
            yield _batch(rows)


SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives that a manifest (column path) lists; they are dealt over as many tasks."""
    paths = manifest.select("path")
    tasks = max(1, min(paths.count(), 20_000))
    return paths.repartition(tasks).mapInArrow(lambda it: _read_archives(it, payloads), SCHEMA)
