"""WARC archives: writing, normalising and reading.

Archives are written as whole-file gzip streams, as crawlers and tar-like
tools leave them: no record can be reached without inflating all before it.
The normaliser inflates such a stream once, as a stream of bounded buffers,
rewrites every record as a gzip member of its own, and writes a sidecar index
of member offsets (JSON lines). With it records are read in parallel, by
ranges of the index rather than by files.

Records with equal payloads of at least LEAST_BYTES are stored once: the one
with the largest page id is the response, the others are revisit records that
name it. Payloads are never shuffled: only digests of payloads that occur more
than once meet the rows again.

Defined cases: a null html is an empty payload; a null url gives a record
without a target; a null page_id sorts below all others; rows that repeat the
largest id of a payload are all responses; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import Scratch, open_fs, table, write_file

LEAST_BYTES, LEVEL = 0, 6
#: Repeated payloads whose digests are broadcast to the pages; beyond it a shuffled join is used.
BROADCAST_DIGESTS = 500_000
STAMP = "2020-01-01T00:00:00Z"
BUFFER = 1 << 20


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 response record, or a revisit record without payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {STAMP}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers (lower-case names), and the payload behind the HTTP headers, of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    block = rest[: int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return out | {"http": http, "payload": payload}


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, in bounded pieces."""
    unzip, pending = zlib.decompressobj(31), b""
    while data := pending or stream.read(BUFFER):
        piece = unzip.decompress(data, 4 * BUFFER)
        pending = unzip.unconsumed_tail
        if unzip.eof:
            pending = unzip.unused_data
            unzip = zlib.decompressobj(31)
        if piece:
            yield piece
    if piece := unzip.flush():
        yield piece


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated archive; no more is kept than one record and one piece."""
    held, at, more = bytearray(), 0, True
    while True:
        end = held.find(b"\r\n\r\n", at)
        if end >= 0:
            size = next(int(x.split(b":", 1)[1]) for x in bytes(held[at:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
            stop = end + 4 + size + 4
            if stop <= len(held):
                yield bytes(held[at:stop])
                at = stop
                continue
        if not more:
            if bytes(held[at:]).strip():
                raise ValueError("the archive ends within a record")
            return
        del held[:at]
        at = 0
        piece = next(pieces, b"")
        more = bool(piece)
        held += piece


def _write(base: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{base}/archive-{TaskContext.get().partitionId():06d}.warc.gz"
        count = 0

        def write(out) -> None:
            nonlocal count
            deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
            for batch in batches:
                for page, url, html, revisit, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out.write(deflate.compress(record(page, url, html.encode(), to, revisit)))
                    count += 1
            out.write(deflate.flush())

        write_file(path, write)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["path", "records"])

    return run


def write_archives(pages: DataFrame, base: str, *, least: int = LEAST_BYTES, level: int = LEVEL) -> DataFrame:
    """One monolithic archive for each partition of pages (page_id, url, html); returns their paths and record counts."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    raw = F.col("html").cast("binary")
    keyed = pages.withColumn("digest", F.when(F.octet_length("html") >= least, F.sha1(raw)))
    twice = keyed.filter("digest is not null").groupBy("digest").agg(F.max("page_id").alias("to"), F.count("*").alias("n")).filter("n > 1").drop("n").persist()
    few = twice.count() <= BROADCAST_DIGESTS
    joined = keyed.join(F.broadcast(twice) if few else twice, "digest", "left")
    revisit = F.coalesce((F.col("page_id") < F.col("to")) | (F.col("page_id").isNull() & F.col("to").isNotNull()), F.lit(False))
    out = joined.select("page_id", "url", "html", revisit.alias("revisit"), "to").mapInArrow(_write(base, level), "path string, records long")
    rows = [(r["path"], r["records"]) for r in out.collect()]
    twice.unpersist()
    return pages.sparkSession.createDataFrame(rows, "path string, records long")


def _normalise(base: str, level: int):
    def one(path: str) -> tuple[str, int]:
        name = path.rsplit("/", 1)[1].removesuffix(".warc.gz")
        fs, local = open_fs(path)
        index = []

        def write(out) -> None:
            at = 0
            with fs.open_input_stream(local, compression=None) as f:
                for raw in records(inflate(f)):
                    member = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = member.compress(raw) + member.flush()
                    out.write(data)
                    index.append((at, len(data)))
                    at += len(data)

        target = f"{base}/{name}.records.warc.gz"
        write_file(target, write)
        write_file(f"{base}/{name}.index.jsonl", lambda out: out.write("".join(json.dumps({"path": target, "offset": a, "length": n}) + "\n" for a, n in index).encode()))
        return target, len(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                target, n = one(path)
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64())], ["path", "records"])

    return run


def normalise(archives: DataFrame, base: str, *, level: int = LEVEL) -> int:
    """Rewrite monolithic archives (path) record by record below base, with an index beside each; returns the records."""
    n = max(1, archives.count())
    write_file(f"{base}/none.index.jsonl", lambda out: out.write(b""))  # so that an index is there without archives too
    done = archives.select("path").repartition(n).mapInArrow(_normalise(base, level), "path string, records long")
    return done.agg(F.sum("records")).first()[0] or 0


INDEX = "path string, offset long, length long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None
        page = lambda x: int(x[10:-1]) if len(x) > 11 else None  # noqa: E731  <urn:page:7>
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != opened:
                    fs, local = open_fs(path)
                    opened, f = path, fs.open_input_file(local)
                f.seek(offset)
                r = parse(zlib.decompress(f.read(length), 31))
                kind, said = r["warc-type"], r["warc-payload-digest"].removeprefix("sha1:")
                digest, size = said, None
                if kind == "response":
                    size, digest = len(r["payload"]), base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
                    if digest != said:
                        raise ValueError(f"the payload of {r['warc-record-id']} does not match its digest")
                rows.append((page(r["warc-record-id"]), size, digest, kind, page(r["warc-refers-to"]) if kind == "revisit" else None, r["payload"] if payloads else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return run


def read_records(spark: SparkSession, base: str, *, payloads: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """All records by way of the indexes below base; a revisit has the size and payload of the response it names.

    Given scratch space the archives are read once; else once for each side of that join.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = spark.read.schema(INDEX).json(f"{base}/*.index.jsonl")
    rows = index.repartitionByRange(parts, "path", "offset").sortWithinPartitions("path", "offset").mapInArrow(_read(payloads), READ)
    rows = rows if scratch is None else scratch.cut(rows, "parsed")
    source = rows.filter("record_type = 'response'").select(F.col("page_id").alias("to"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("size"), F.col("payload").alias("body")).dropDuplicates(["to", "digest"])
    again = rows.filter("record_type = 'revisit'")
    on = again["refers_to"].eqNullSafe(source["to"]) & (again["payload_digest"] == source["digest"])
    full = again.join(source, on, "left").select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", F.col("body").alias("payload"))
    return rows.filter("record_type = 'response'").union(full)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages to archives, normalised, and read back."""
    scratch = Scratch(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages"), scratch.path("whole"))
    normalise(archives, scratch.path("records"))
    scratch.drop("whole")
    rows = read_records(spark, scratch.path("records"), scratch=scratch).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return scratch.cut(rows, "read")


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), m AS (
  SELECT page_id, strlen(html) AS n, hex, max(page_id) OVER (PARTITION BY hex) AS top FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m
"""
