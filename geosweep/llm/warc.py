"""WARC archives as a chunked record table.

A payload travels as rows (record id, chunk number, bytes): ``chunk_table`` cuts it into
chunks of bounded size, ``write_archives`` streams those rows into gzip members of WARC
1.1 files, and ``read_archives`` streams archives back into chunk rows, each carrying the
length and the SHA-256 digest of its payload so far.  The last chunk of a record
therefore carries the digest of the whole, and neither side ever holds a whole record
in Python.

Files lie in a fresh folder below spark.checkpoint.dir.  A task writes to a name of its
own attempt, and only names in the table of finished files are read, so a retried or
lost task leaves no duplicate.

Edge cases: null html is an empty payload; records with a null url get a urn as target;
rows that share the smallest page id of a group of copies are all responses; in a group
of copies without any page id all are responses.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geosweep.llm.frames import MOST_PARTITIONS, shared_dir, split_join, table, written

CHUNK = 1 << 20
MIN_REVISIT = 100
_BLANK = b"\r\n\r\n"

CHUNKS = "record_id string, chunk_no int, last boolean, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, data binary"
READ = "record_id string, chunk_no int, last boolean, page_id long, target string, record_type string, refers_to long, bytes_so_far long, digest_so_far string, stated_digest string, data binary"


def decide(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Pages with payload, digest, record type and, for revisits, the response's page id."""
    full = pages.select("page_id", "url", F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    copies = (
        full.where(F.col("payload_bytes") >= min_revisit)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("payload_digest", "first")
    )
    # only the small columns meet in the join on the digest; payloads stay where they are
    revisits = split_join(full.select("page_id", "payload_digest"), copies, ["payload_digest"]).where(
        F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))
    )
    known = revisits.where("page_id IS NOT NULL").select("page_id", F.col("payload_digest").alias("d"), "first").distinct()
    # rows without a page id are told apart by their digest, through the same bounded split
    numbered = full.where("page_id IS NOT NULL").join(
        known.withColumnRenamed("page_id", "p"), (F.col("page_id") == F.col("p")) & (F.col("payload_digest") == F.col("d")), "left"
    )
    nameless = split_join(full.where("page_id IS NULL"), copies, ["payload_digest"], "left")
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "first"]
    both = numbered.select(*columns).unionByName(nameless.select(*columns))
    return both.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("first").alias("refers_to"),
    )


def chunk_table(decided: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Record rows cut into chunk rows, in order; revisits carry no payload."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    pieces = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / chunk)).cast("int")
    return (
        decided.withColumn("body", body)
        .withColumn("pieces", pieces)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("chunk_no"))
        .select(
            F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("x-"), "payload_digest"))).alias("record_id"),
            "chunk_no", (F.col("chunk_no") == F.col("pieces") - 1).alias("last"), "page_id", "url", "record_type", "refers_to",
            "payload_bytes", "payload_digest", F.substring("body", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("data"),
        )
    )


def _open(path: str, write: bool):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner, compression=None) if write else store.open_input_stream(inner, compression=None)


def _safe(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _headers(row: dict) -> tuple[bytes, int]:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += b"Content-Length: %d" % row["payload_bytes"] + _BLANK
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {_safe(row['url']) if row['url'] else row['record_id']}", f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        "Content-Type: application/http;msgtype=response",
    ]
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{row['refers_to']}>")
        length = len(http)
    else:
        length = len(http) + row["payload_bytes"]
    return ("\r\n".join([*lines, f"Content-Length: {length}"]) + "\r\n\r\n").encode() + http, length


def write_archives(chunks: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """Stream chunk rows (in order within a partition) to archives; the folder and a table of its files."""
    folder = folder or shared_dir(chunks.sparkSession)
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(folder)
        store.create_dir(inner, recursive=True)
        path, out, member, records = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, None, 0
        for batch in batches:
            for row in (r for piece in range(batch.num_rows) for r in batch.slice(piece, 1).to_pylist()):
                out = out or _open(path, True)
                if row["chunk_no"] == 0:
                    member = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=5, mtime=0)
                    member.write(_headers(row)[0])
                member.write(row["data"])
                if row["last"]:
                    member.write(_BLANK)
                    member.close()
                    records += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records])], schema=schema)

    return folder, written(chunks.mapInArrow(run, "path string, records long"))


def _line(stream: io.BufferedReader) -> bytes:
    """A header line, however long: it holds a URI or an id, never payload."""
    return stream.readline().rstrip(b"\r\n")


def records(stream: io.BufferedReader, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of every record of one archive."""
    while True:
        head = _line(stream)
        if not head:
            if not stream.peek(1):
                return
            continue
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {head[:40]!r}")
        fields = {}
        while line := _line(stream):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        left = int(fields["content-length"])
        http = {}
        if fields.get("content-type", "").startswith("application/http"):
            while line := stream.readline():
                left -= len(line)
                name, _, value = line.decode("latin-1").partition(":")
                http[name.strip().lower()] = value.strip()
                if line in (b"\r\n", b"\n"):
                    break
        revisit = fields["warc-type"] == "revisit"
        record_id = fields["warc-record-id"].strip("<>")
        page = record_id.removeprefix("urn:page:")
        stated = fields.get("warc-payload-digest", "").removeprefix("sha256:")
        refers = fields.get("warc-refers-to", "").strip("<>").removeprefix("urn:page:")
        digest, size, number = hashlib.sha256(), 0, 0
        while True:
            data = stream.read(min(chunk, left))
            if left and not data:
                raise ValueError(f"record {record_id} is cut short")
            left -= len(data)
            size += len(data)
            digest.update(data)
            yield {
                "record_id": record_id, "chunk_no": number, "last": not left, "page_id": int(page) if re.fullmatch(r"-?\d+", page) else None,
                "target": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": int(refers) if refers else None,
                "bytes_so_far": int(http.get("content-length", 0)) if revisit else size,
                "digest_so_far": stated if revisit else digest.hexdigest(), "stated_digest": stated, "data": data,
            }
            number += 1
            if not left:
                break
        if stream.read(4) != _BLANK:
            raise ValueError(f"record {record_id} has no end")


def read_archives(files: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """Chunk rows of all archives in a table of paths; one archive is one task's work."""
    schema = pa.schema([(f.name, {"string": pa.string(), "integer": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[f.dataType.typeName()]) for f in files.sparkSession.createDataFrame([], READ).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with gzip.open(_open(path, False), "rb") as raw:
                    rows, held = [], 0
                    for row in records(io.BufferedReader(raw, 1 << 16), chunk):
                        row["data"] = row["data"] if with_data else b""
                        rows.append(row)
                        held += len(row["data"]) + 200
                        if held > 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # ranges of a hash deal the archives evenly, at most so many at once
    n = min(max(1, files.count()), MOST_PARTITIONS)
    return files.select("path", F.xxhash64("path").alias("k")).repartitionByRange(n, "k").select("path").mapInArrow(run, READ)


def payloads(chunks: DataFrame) -> DataFrame:
    """One row per record: its last chunk's totals."""
    return chunks.where("last").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, files = write_archives(chunk_table(decide(table(spark, sf_dir, "pages"))))
    return payloads(read_archives(files, with_data=False))


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM f
"""
