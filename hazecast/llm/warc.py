"""WARC archives as a chunked record table.

Writing: each payload is cut into segments of ``SEGMENT`` bytes; the first is a ``response`` (or
``revisit``) record, the others are ``continuation`` records with the origin's id and their number.
Every segment is one row that Spark's text writer puts out (gzipped, at most ``PER_ARCHIVE``
segments to an archive), so no archive grows with a payload.

Reading: archives are unpacked and parsed as streams, led by their length fields, whatever the
payloads hold, into rows (record id, chunk number, payload slice).  A record of several chunks is
brought together by a shuffle on its id, sorted by chunk number, and hashed as its chunks stream by:
the running digest is all that is kept of it.  A record of one chunk is hashed where it is read and
its bytes move no further.

Of records with equal payloads of ``MIN_REVISIT`` bytes or more, that with the largest page id is
the response, and the others are revisits without payload that name it.

Defined cases: a null payload is empty; a null id is written as no id and comes back as null, is
never a response for others, and is a response itself where all equal payloads lack ids; rows that
share the largest id are all responses; repeated rows each become a record (told apart by their
place in the input); an empty table gives an archive folder without records; other columns are not
written.
"""

from __future__ import annotations

import gzip
import io
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: bytes of a segment, and of a chunk that is read
SEGMENT = 64 * 1024
#: segments of an archive at most
PER_ARCHIVE = 4096
MIN_REVISIT = 1000
#: rows of one digest are joined with its response in so many parts
SALTS = 16
CRLF = "\r\n"
VERSION = "WARC/1.1"


def record_table(pages: DataFrame, page_id: str, url: str, payload: str) -> DataFrame:
    """A row per page: key, page_id, url, body, size, digest, record_type, refers_to."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).alias("page_id"),
                        F.col(url).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({"size": F.octet_length("body").cast("long"), "digest": F.sha1("body")})
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "row"), F.lit(SALTS)).cast("int"))
    equal = (pages.select(F.col(page_id).alias("page_id"), body.alias("body"))
             .select("page_id", F.sha1("body").alias("digest"), F.octet_length("body").alias("size"))
             .where(F.col("size") >= MIN_REVISIT).groupBy("digest")
             .agg(F.count("*").alias("n"), F.max("page_id").alias("best")).where("n > 1 and best is not null"))
    equal = equal.select("digest", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.join(equal, ["digest", "salt"], "left")
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    key = F.md5(F.concat_ws("|", F.col("row").cast("string"), F.col("page_id").cast("string"), "digest"))
    return rows.select(key.alias("key"), "page_id", "url", "body", "size", "digest",
                       F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                       F.when(revisit, F.col("best")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
                   date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row as gzipped WARC archives into the folder ``path``."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    maybe = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    part_of = lambda at, n: F.substring("key", at, n)
    urn = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[part_of(*x) for x in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
    stored = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("body"))
    segments = (record_table(pages, page_id, url, payload).withColumn("stored", stored)
                .withColumn("parts", F.greatest(F.ceil(F.octet_length("stored") / F.lit(SEGMENT)), F.lit(1)).cast("int"))
                .withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
                .withColumn("slice", F.substring("stored", (F.col("part") - 1) * SEGMENT + 1, F.lit(SEGMENT))))
    first = F.col("part") == 1
    head = F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        line("WARC-Record-ID", F.concat(urn, F.when(first, "").otherwise(F.concat(F.lit("-"), F.col("part"))), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        maybe("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        maybe("WARC-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("size").cast("string")),
        maybe("WARC-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        F.when(F.col("parts") > 1, F.concat(line("WARC-Segment-Number", F.col("part").cast("string")),
                                            line("WARC-Segment-Count", F.col("parts").cast("string")),
                                            line("WARC-Segment-Origin-ID", F.concat(urn, F.lit(">"))))).otherwise(""),
        line("Content-Length", F.octet_length("slice").cast("string")),
        F.lit(CRLF))
    (segments.select(F.concat(head, F.col("slice").cast("string")).alias("value"))
     .write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", PER_ARCHIVE).option("compression", "gzip").text(path))


# The header fields that are read.
FIELDS = {"warc-type": "kind", "warc-record-id": "id", "warc-target-uri": "url", "warc-page-id": "page_id",
          "warc-payload-digest": "digest", "warc-payload-length": "size", "warc-refers-to-page-id": "refers_to",
          "warc-segment-number": "part", "warc-segment-count": "parts", "warc-segment-origin-id": "origin",
          "content-length": "length"}


def parse_archive(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """(header, chunk, chunks, bytes) of each record, in chunks of at most SEGMENT bytes."""
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {version[:40]!r}")
        head: dict[str, str] = {}
        while (x := stream.readline()) not in (b"\r\n", b"\n"):
            if not x:
                raise ValueError("a record's header is cut short")
            name, _, value = x.partition(b":")
            if (field := FIELDS.get(name.decode("latin-1").strip().lower())) is not None:
                head[field] = value.decode("utf-8", "replace").strip()
        length = int(head["length"])
        chunks = max(1, -(-length // SEGMENT))
        for chunk in range(1, chunks + 1):
            data = stream.read(min(SEGMENT, length - (chunk - 1) * SEGMENT))
            if len(data) < min(SEGMENT, length - (chunk - 1) * SEGMENT):
                raise ValueError("a record is cut short")
            yield head, chunk, chunks, data
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def open_archive(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if content[:2] == b"\x1f\x8b" else raw


#: rows of one output batch, and the payload bytes in them, at most
BATCH, BATCH_BYTES = 1000, 8 << 20
_CHUNKS = pa.schema([("record", pa.string()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("page_id", pa.int64()),
                     ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("size", pa.int64()),
                     ("digest", pa.string()), ("n_bytes", pa.int64()), ("bytes", pa.binary()), ("sha1", pa.string())])
_DDL = ("record string, chunk int, chunks int, page_id long, url string, record_type string, refers_to long, size long, "
        "digest string, n_bytes long, bytes binary, sha1 string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_chunks(spark: SparkSession, path: str, all_bytes: bool = True) -> DataFrame:
    """A row per chunk: record, chunk (from 1) of chunks, header fields, n_bytes, bytes and sha1
    (of this chunk).  Without ``all_bytes``, records of one chunk come without their bytes."""
    number = lambda x: int(x) if x else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for content in batch.column(0):
                for head, chunk, chunks, data in parse_archive(open_archive(content.as_py())):
                    parts = int(head.get("parts", 1))
                    if parts > 1:
                        chunk, chunks = int(head["part"]), parts
                    keep = all_bytes or chunks > 1
                    rows.append((head.get("origin", head["id"]), chunk, chunks, number(head.get("page_id")), head.get("url"),
                                 head["kind"], number(head.get("refers_to")), number(head.get("size")),
                                 head.get("digest", "").rpartition(":")[2] or None, len(data), data if keep else None,
                                 hashlib.sha1(data).hexdigest()))
                    held += len(data) * keep
                    if len(rows) >= BATCH or held >= BATCH_BYTES:
                        yield _batch(rows, _CHUNKS)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, _CHUNKS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, _DDL)


_RECORDS = pa.schema([("record", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                      ("size", pa.int64()), ("digest", pa.string()), ("read_bytes", pa.int64()), ("read_sha1", pa.string())])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: page_id, record_type, refers_to, payload_bytes and payload_digest of the
    full payload.  Of responses these are measured on the bytes read, and a record whose bytes do
    not give the digest in its header raises an error; revisits have them from their header."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks in order of (record, chunk); of a record its first row's fields and hash are kept."""
        first = state = None
        for batch in batches:
            out = []
            cols = [batch.column(n) for n in ("record", "chunk", "chunks", "page_id", "record_type", "refers_to", "size",
                                              "digest", "n_bytes", "bytes", "sha1")]
            for *row, data, sha1 in zip(*cols):
                record, chunk, chunks, page_id, kind, refers_to, size, digest, n = [x.as_py() for x in row]
                if chunks == 1:
                    out.append((record, page_id, kind, refers_to, size, digest, n, sha1.as_py()))
                    continue
                if chunk == 1:
                    first, state, upto, length = (record, page_id, kind, refers_to, size, digest), hashlib.sha1(), 0, 0
                if first is None or first[0] != record or chunk != upto + 1:
                    raise ValueError(f"chunk {chunk} of {record} does not follow")
                state.update(data.as_buffer())
                upto, length = chunk, length + n
                if chunk == chunks:
                    out.append((*first, length, state.hexdigest()))
                    first = None
            if out:
                yield _batch(out, _RECORDS)
        if first is not None:
            raise ValueError(f"record {first[0]} is cut short")

    got = (read_chunks(spark, path, all_bytes=False).drop("url").repartition("record").sortWithinPartitions("record", "chunk")
           .mapInArrow(stream, "record string, page_id long, record_type string, refers_to long, size long, digest string, "
                               "read_bytes long, read_sha1 string"))
    revisit = F.col("record_type") == "revisit"
    same = revisit | ((F.col("read_sha1") == F.col("digest")) & (F.col("read_bytes") == F.col("size")))
    return got.select("page_id", F.when(revisit, F.col("size")).otherwise(F.col("read_bytes")).alias("payload_bytes"),
                      F.when(same, F.col("digest")).otherwise(
                          F.raise_error(F.concat(F.lit("wrong payload of record "), F.col("record"))).cast("string")).alias("payload_digest"),
                      "record_type", "refers_to")


def archive_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write all pages as archives into the shared scratch folder and read the records back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, page_id, url, payload)
    return read_records(pages.sparkSession, path)
