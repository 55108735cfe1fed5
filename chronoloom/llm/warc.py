"""WARC archives through a chunked record table.

Payloads travel as rows (record, chunk number, bytes). Writing: a task gets its records' chunks
in order and appends each to the record's gzip member. Reading: a task streams its part of an
archive through buffers of fixed size and yields the chunks of each record, every row with the
digest of the payload up to there. Neither side holds a whole record.

Archives go to a folder all executors share. A task writes under a name of its own and reports
the file only when it has ended; readers open reported files alone, so what a lost or repeated
task has left is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require, shared_dir, table, written

#: Bytes of a payload in one row, of a part that one task reads, and after which a new archive begins.
CHUNK, PART, ARCHIVE = 1 << 18, 64 << 20, 1 << 30
URN = "urn:chronoloom:page:"
DATE = "1970-01-01T00:00:00Z"

WRITTEN = "file string, first long, length long, records long"
WRITTEN_FIELDS = pa.schema([("file", pa.string()), ("first", pa.int64()), ("length", pa.int64()), ("records", pa.int64())])
CHUNKS = (
    "page_id long, record_type string, target_uri string, refers_to long, declared_digest string, "
    "chunk long, data binary, payload_bytes long, payload_digest string, last boolean"
)


def base32_sha1(payload: Column) -> Column:
    """Base32 of SHA-1: each 5 hexadecimal digits are 4 letters."""
    hexed = F.sha1(payload)
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(8):
        number = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(letters, F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def revisits(df: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, record_type, refers_to).

    Of equal payloads of at least `min_bytes`, that with the largest page_id is the response.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = df.select("page_id", "url", payload.alias("payload")).withColumn("key", F.sha2("payload", 256))
    keepers = rows.groupBy("key").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    several = written(keepers.filter("n > 1"), "warc-payloads")
    revisit = (F.octet_length("payload") >= min_bytes) & (F.col("page_id") < F.col("keeper"))
    return rows.withColumn("digest", base32_sha1(F.col("payload"))).join(several, "key", "left").select(
        "page_id",
        "url",
        "payload",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        "digest",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("keeper")).alias("refers_to"),
    )


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk of a record's payload, in order; one for an empty payload or a revisit."""
    size = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.lit(0)).cast("int")
    last = F.greatest(F.ceil(size / chunk).cast("int") - 1, F.lit(0))
    return (
        records.withColumn("__last", last)
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), "__last")))
        .select(
            "page_id", "url", "payload_bytes", "digest", "record_type", "refers_to", "chunk",
            F.when(
                F.col("record_type") == "response", F.substring(F.col("payload"), F.col("chunk") * chunk + 1, F.lit(chunk))
            ).otherwise(F.lit(b"")).alias("data"),
            (F.col("chunk") == F.col("__last")).alias("last"),
        )
    )


def _head(row: dict) -> bytes:
    """Header of the record and of the response in it."""
    body = row["payload_bytes"] if row["record_type"] == "response" else 0
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {body}\r\n\r\n".encode()
    name = "" if row["page_id"] is None else row["page_id"]
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", f"<{URN}{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{row['digest']}"),
    ]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", row["url"])))
    if row["refers_to"] is not None:
        fields.append(("WARC-Refers-To", f"<{URN}{row['refers_to']}>"))
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + body))]
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + http


def _writer(directory: str, archive: int, part: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(directory)
        out = name = packer = None
        at = first = records = 0
        parts: list[tuple] = []

        def put(data: bytes) -> int:
            out.write(data)
            return len(data)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(WRITTEN_FIELDS.names, p, strict=True)) for p in parts], WRITTEN_FIELDS)

        for batch in batches:
            heads = batch.select([c for c in batch.schema.names if c != "data"]).to_pylist()
            for row, data in zip(heads, batch.column("data"), strict=True):  # one chunk's bytes at a time
                if row["chunk"] == 0:
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, at, first, records = files.open_output_stream(f"{root}/{name}", compression=None), 0, 0, 0
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    at += put(packer.compress(_head(row)))
                at += put(packer.compress(data.as_py()))
                if row["last"]:
                    at += put(packer.compress(b"\r\n\r\n") + packer.flush())
                    records += 1
                    if at - first >= part or at >= archive:
                        parts.append((name, first, at - first, records))
                        first, records = at, 0
                    if at >= archive:
                        out.close()
                        out = None
                        yield told()
                        parts = []
        if out is not None:
            out.close()
            if records:
                parts.append((name, first, at - first, records))
            yield told()

    return write


def write_archives(records: DataFrame, directory: str, chunk: int = CHUNK, archive: int = ARCHIVE, part: int = PART) -> DataFrame:
    """Writes archives below `directory`; returns the parts written (file, first byte, length, records) as a table."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(directory)
    files.create_dir(root, recursive=True)
    return written(chunked(records, chunk).mapInArrow(_writer(directory, archive, part), WRITTEN), "warc-parts")


class _Members:
    """Bytes of consecutive gzip members, through a buffer of fixed size."""

    def __init__(self, source, length: int, size: int = 1 << 16):
        self.source, self.left, self.size = source, length, size
        self.packed, self.plain, self.unpacker = b"", b"", None

    def more(self) -> bool:
        while True:
            if not self.packed and self.left:
                self.packed = self.source.read(min(self.size, self.left))
                self.left -= len(self.packed)
                if not self.packed:
                    raise EOFError("the archive is shorter than was reported")
            if not self.packed and self.unpacker is None:
                return False
            self.unpacker = self.unpacker or zlib.decompressobj(31)
            got = self.unpacker.decompress(self.packed, self.size)
            self.packed = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
            if self.unpacker.eof:
                self.unpacker = None
            elif not got and not self.packed and not self.left:
                raise EOFError("a record is cut short")
            if got:
                self.plain += got
                return True

    def line(self) -> bytes:
        while (end := self.plain.find(b"\r\n")) < 0:
            if not self.more():
                if self.plain:
                    raise ValueError("a header line has no end")
                return b""
        got, self.plain = self.plain[:end], self.plain[end + 2 :]
        return got

    def take(self, most: int) -> bytes:
        if not self.plain and not self.more():
            raise EOFError("a record is cut short")
        got, self.plain = self.plain[:most], self.plain[most:]
        return got


def read_records(source, length: int, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of CHUNKS from one part of an archive."""
    stream = _Members(source, length)
    while version := stream.line():
        if version != b"WARC/1.0":
            raise ValueError(f"not a record: {version[:40]!r}")
        head = {}
        while line := stream.line():
            key, _, value = line.partition(b":")
            head[key.strip().lower()] = value.strip().decode()
        left = int(head[b"content-length"])
        while line := stream.line():  # the response's own header
            left -= len(line) + 2
        left -= 2
        page = head[b"warc-record-id"][1:-1].removeprefix(URN)
        refers = head.get(b"warc-refers-to", "")[1:-1].removeprefix(URN)
        fixed = (
            int(page) if page else None,
            head[b"warc-type"],
            head.get(b"warc-target-uri"),
            int(refers) if refers else None,
            head[b"warc-payload-digest"].removeprefix("sha1:"),
        )
        digest, done, number = hashlib.sha1(), 0, 0
        while True:
            pieces, want = [], min(chunk, left)
            while want:
                pieces.append(stream.take(want))
                want -= len(pieces[-1])
            data = b"".join(pieces)
            left -= len(data)
            done += len(data)
            digest.update(data)
            yield (*fixed, number, data, done, base64.b32encode(digest.digest()).decode(), not left)
            number += 1
            if not left:
                break
        if stream.line() or stream.line():
            raise ValueError("a record is longer than it says")


KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
CHUNK_FIELDS = pa.schema([(name, KINDS[kind]) for name, kind in (x.split() for x in CHUNKS.split(", "))])


def _reader(directory: str, chunk: int):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CHUNK_FIELDS, strict=True)], schema=CHUNK_FIELDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(directory)
        for part in (p for batch in batches for p in batch.to_pylist()):
            with files.open_input_file(f"{root}/{part['file']}") as source:
                source.seek(part["first"])
                rows, size = [], 0
                for row in read_records(source, part["length"], chunk):
                    rows.append(row)
                    size += len(row[6]) + 200
                    if size >= 16 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return read


def read_archives(parts: DataFrame, directory: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk table (CHUNKS) of the archives that `parts` lists; each part is read by one task.

    payload_bytes and payload_digest cover the payload up to and with the row's chunk.
    """
    spread = parts.repartition(max(1, parts.sparkSession.sparkContext.defaultParallelism) * 4, "file", "first")
    return spread.mapInArrow(_reader(directory, chunk), CHUNKS)


def archive_pages(df: DataFrame, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Writes a record per row of (page_id, url, html), reads the archives back, and returns a row per record.

    page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, intact (the
    digest read agrees with the header's). Null html is an empty payload, null url gives no
    target; a null page_id is always a response; rows that repeat the largest page_id of a
    payload are all responses. Other columns don't matter. An empty table gives no archive and
    an empty result.
    """
    require(df, "page_id", "url", "html")
    spark = df.sparkSession
    directory = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    parts = write_archives(revisits(df, min_bytes), directory, chunk)
    rows = written(
        read_archives(parts, directory, chunk)
        .filter("last")
        .select("page_id", "record_type", "target_uri", "refers_to", "declared_digest", "payload_bytes", "payload_digest"),
        "warc-records",
    )
    full = rows.filter("record_type = 'response'")
    seen = full.filter("page_id IS NOT NULL").groupBy(F.col("page_id").alias("refers_to")).agg(
        F.max("payload_bytes").alias("__bytes"), F.max("payload_digest").alias("__digest")
    )
    again = rows.filter("record_type = 'revisit'").join(seen, "refers_to", "left")
    return full.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri",
        (F.col("payload_digest") == F.col("declared_digest")).alias("intact"),
    ).unionByName(
        again.select(
            "page_id", F.col("__bytes").alias("payload_bytes"), F.col("declared_digest").alias("payload_digest"), "record_type", "refers_to",
            "target_uri", (F.col("__digest") == F.col("declared_digest")).alias("intact"),
        )
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS keeper FROM p
)
SELECT page_id, payload_bytes,
       list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) % 32 + 1, 1)), lambda a, x: a || x) AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM d
"""
