"""WARC archives: revisit resolution by payload digest."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, own_dir, parts, table

#: Shorter payloads are always written as responses.
LEAST = 100
#: Bytes of archive after which a task begins another file.
ROLL = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit of the response of page first."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest) if not revisit else f'<urn:uuid:{uuid.uuid4()}>'}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub(r'[^\x21-\x7e]', lambda m: ''.join(f'%{b:02X}' for b in m[0].encode('utf-8', 'surrogatepass')), url or 'urn:none')}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}", f"WARC-Refers-To-Date: {date}"] + ([f"X-Refers-To-Page-ID: {first}"] if first is not None else [])
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _writer(to: str, roll: int, date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(to)
        task = TaskContext.get()
        out, at, files, seen = None, "", [], set()

        def close() -> None:
            out.close()
            final = f"{root}/part-{task.partitionId():05d}-{len(files):04d}.warc.gz"
            if system.get_file_info(final).type != fs.FileType.NotFound:
                system.delete_file(final)  # of an attempt that was lost
            system.move(at, final)
            files.append(final)

        for b in batches:
            for page, url, payload, digest, first, tied in zip(*(c.to_pylist() for c in b.columns), strict=True):
                revisit = digest is not None and len(payload) >= LEAST and first is not None and page != first
                if tied and not revisit and len(payload) >= LEAST:
                    revisit = (page, digest) in seen  # a repeated row: the first one met is the response
                    seen.add((page, digest))
                if out is None:
                    at = f"{root}/_part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(files)}"
                    out = system.open_output_stream(at)
                out.write(record(page, url, payload, digest, first, revisit, date))
                if out.tell() >= roll:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string())], names=["file"])

    return write


def write(pages: DataFrame, to: str, roll: int = ROLL) -> DataFrame:
    """pages (page_id, url, html) to archives in the folder; returns their files, written once.

    Only headers (digest and id) meet by digest, pre-aggregated; payloads move once,
    by id and digest, so copies of one payload do not gather in a task.
    """
    d = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    d = d.withColumns({"digest": F.sha2("payload", 256), "key": F.coalesce(F.col("page_id").cast("string"), F.lit(""))})
    heads = d.where(F.octet_length("payload") >= LEAST).groupBy("digest", "key").agg(F.count("*").alias("n"), F.first("page_id").alias("page_id"))
    first = heads.groupBy("digest").agg(F.min("page_id").alias("first"))
    known = heads.join(first, "digest").select(F.col("digest").alias("_d"), F.col("key").alias("_k"), "first", ((F.col("n") > 1) & F.col("page_id").eqNullSafe(F.col("first"))).alias("tied"))
    d = d.repartition(parts(pages.sparkSession), "key", "digest")
    d = d.join(known, (d["key"] == known["_k"]) & (d["digest"] == known["_d"]), "left").select("page_id", "url", "payload", "digest", "first", F.coalesce("tied", F.lit(False)).alias("tied"))
    system, root = fs.FileSystem.from_uri(to)
    system.create_dir(root, recursive=True)
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")  # one for all tasks and attempts, as revisits name their response's
    return cut(d.mapInArrow(_writer(to, roll, date), "file string"))


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed WARC stream, one at a time."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        block = stream.read(n := int(head["content-length"]))
        if len(block) != n:
            raise ValueError("a record is cut short")
        yield head, block


_READ = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, refers_id string, record_id string"


def _reader(to: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(to)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in _READ.split(", ")]
        for b in batches:
            for file in b.column(0).to_pylist():
                rows = []
                with gzip.GzipFile(fileobj=system.open_input_stream(file, compression=None)) as stream:
                    for head, block in records(stream):
                        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
                        body = block.partition(b"\r\n\r\n")[2]
                        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"digest of {head['warc-record-id']} does not hold")
                        number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                        rows.append((number("x-page-id"), kind, digest, len(body) if kind == "response" else None, number("x-refers-to-page-id"), head.get("warc-refers-to"), head["warc-record-id"]))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return read


def resolve(files: DataFrame, to: str) -> DataFrame:
    """The archives' records, a revisit with the length of the response that it refers to; it fails where that is missing."""
    r = files.repartition(parts(files.sparkSession), "file").mapInArrow(_reader(to), _READ)
    r = cut(r)
    whole = r.where("record_type = 'response'")
    again = r.where("record_type = 'revisit'")
    known = whole.join(again.select(F.col("refers_id").alias("_of")).distinct(), F.col("record_id") == F.col("_of"), "left_semi").select(F.col("record_id").alias("_id"), F.col("payload_bytes").alias("_n"), F.col("payload_digest").alias("_d"))
    again = again.join(known, (F.col("refers_id") == F.col("_id")) & (F.col("payload_digest") == F.col("_d")), "left")
    again = again.withColumn("payload_bytes", F.coalesce("_n", F.raise_error(F.lit("a revisit without its response")).cast("long")))
    keep = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return whole.select(*keep).unionByName(again.select(*keep))


def archive(pages: DataFrame, to: str) -> DataFrame:
    """pages (page_id, url, html) written as archives and read back; a row for each row.

    Null html is an empty payload. Of rows that repeat an id and a payload, one is
    the response and the others revisit it. A row without id is a response only
    where no row with that payload has one; then each such row is. An empty table
    gives no archive and no row.
    """
    return resolve(write(pages, to), to)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back; nulls, repeats and empty tables as in archive()."""
    return archive(table(spark, sf_dir, "pages"), own_dir(spark, "warc"))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p),
r AS (SELECT *, payload_bytes >= 100 AND page_id <> first AS again FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r
"""
