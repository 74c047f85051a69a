"""Document fingerprints: 128-bit SimHash, compared along the table and searched by block tables.

Terms are the pairs of adjacent words (A-Z lower-cased; the word itself if there is one alone).  A
term's hash votes for or against each bit with the bit length of the term's count as its weight;
a bit is set where the votes are for it.  All votes are whole numbers, so equal texts have equal
fingerprints wherever they are computed.

``edited_fingerprints`` pairs each document with the next by ascending id (after the last: the
first).  The table is range-partitioned by (id, hash of the text) and streamed in order; of each
partition only the last document waits for the first of the next one, and these, one pair per
partition, are joined in a second step.

``near_fingerprints`` finds all fingerprints within a Hamming radius by permuted block tables: of
radius + 1 blocks at least one must agree, so each table holds the fingerprints under one block,
rotated to the front as the key; candidates are verified, and counted in the first table whose
blocks agree.

Defined cases: null and empty texts have no terms and fingerprint zero; likeness is 1 for two
of them; null ids come last; rows with one id are ordered by their text's hash; repeated rows
each have the next row as their next document; a single row is its own next document; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, words_of

BITS = 128
RADIUS = 3
#: parts that the rows of one fingerprint are dealt over
SALTS = 32
#: distinct terms whose bits are held at once
CHUNK = 32_768
#: likeness of two fingerprints with k differing bits
LIKENESS = [1 - k / BITS for k in range(BITS + 1)]


def fingerprint(text: str | None) -> bytes:
    words = words_of(text)
    if not words:
        return bytes(BITS // 8)
    terms = Counter(zip(words, words[1:])) if len(words) > 1 else {(words[0],): 1}
    votes = np.zeros(BITS, np.int64)
    weights = np.array([n.bit_length() for n in terms.values()], np.float32)
    keys = list(terms)
    for at in range(0, len(keys), CHUNK):
        raw = b"".join([xxhash.xxh3_128_digest(b" ".join(t)) for t in keys[at:at + CHUNK]])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, BITS)
        # Products and sums are whole numbers far below 2^24, so float32 holds them exactly.
        votes += (weights[at:at + CHUNK] @ bits.astype(np.float32)).astype(np.int64)
    return np.packbits(votes * 2 > int(weights.sum(dtype=np.float64))).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return LIKENESS[(int.from_bytes(a) ^ int.from_bytes(b)).bit_count()]


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _row(doc_id, text: str, own: bytes, following: str, next_own: bytes) -> tuple:
    changed = edited(text, following)
    other = fingerprint(changed)
    return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8")).hexdigest(), own.hex(), other.hex(),
            likeness(own, other), likeness(own, next_own))


_RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
           ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_RESULT_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double")
#: place: 0 a result, 1 a partition's first document, 2 its last
_STREAM = pa.schema([("place", pa.int32()), ("part", pa.int32()), ("text", pa.string()), *_RESULT])
_STREAM_DDL = "place int, part int, text string, " + _RESULT_DDL
BATCH = 2_000


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order; holds one document and its fingerprint besides the batch."""
    part, held, rows = TaskContext.get().partitionId(), None, []
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            doc_id, text = doc_id.as_py(), text.as_py() or ""
            own = fingerprint(text)
            if held is None:
                rows.append((1, part, text, doc_id, None, None, own.hex(), None, None, None))
            else:
                rows.append((0, part, None, *_row(*held, text, own)))
            held = doc_id, text, own
        if len(rows) >= BATCH:
            yield _batch(rows, _STREAM)
            rows = []
    if held is not None:
        rows.append((2, part, held[1], held[0], None, None, held[2].hex(), None, None, None))
    if rows:
        yield _batch(rows, _STREAM)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a partition's last document and the next partition's first."""
    schema = pa.schema(_RESULT)
    for batch in batches:
        rows = [_row(doc_id, text, bytes.fromhex(own), following, bytes.fromhex(next_own)) for doc_id, text, own, following, next_own
                in zip(*[batch.column(n).to_pylist() for n in ("doc_id", "text", "own", "following", "next_own")])]
        if rows:
            yield _batch(rows, schema)


def edited_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next."""
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    got = staged(docs.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_along, _STREAM_DDL), "fingerprints")
    ends = got.where("place > 0").select("place", "part", "doc_id", "text", F.col("fingerprint").alias("own"))
    # One number for each partition that has rows.
    parts = sorted(r.part for r in ends.where("place = 1").select("part").collect())
    result = got.where("place = 0").select(*[n for n, _ in _RESULT])
    if not parts:
        return result
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    last = ends.where("place = 2").join(follows, "part").select("doc_id", "text", "own", "next")
    first = ends.where("place = 1").select(F.col("part").alias("next"), F.col("text").alias("following"), F.col("own").alias("next_own"))
    return result.unionByName(last.join(first, "next").mapInArrow(_across, _RESULT_DDL))


def near_fingerprints(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b, distance), a < b, of the distinct hex fingerprints ``fp`` within ``radius``."""
    tables = radius + 1
    digits = BITS // 4
    cut = [digits * i // tables for i in range(tables + 1)]
    rotated = F.array(*[F.struct(F.lit(i).alias("table"),
                                 F.substring("fp", cut[i] + 1, cut[i + 1] - cut[i]).alias("key")) for i in range(tables)])
    entered = fps.select("fp").distinct().select("fp", F.explode(rotated).alias("t")).select("fp", "t.*")
    a, b = entered.withColumnRenamed("fp", "a"), entered.withColumnRenamed("fp", "b")
    spans = [(at, min(15, digits + 1 - at)) for at in range(1, digits + 1, 15)]
    distance = sum((F.bit_count(F.conv(F.substring("a", at, n), 16, 10).cast("long").bitwiseXOR(
        F.conv(F.substring("b", at, n), 16, 10).cast("long"))) for at, n in spans), F.lit(0))
    earlier = F.lit(False)
    for i in range(tables):
        same = F.substring("a", cut[i] + 1, cut[i + 1] - cut[i]) == F.substring("b", cut[i] + 1, cut[i + 1] - cut[i])
        earlier = earlier | (same & (F.col("table") > i))
    # Estimates do not see how explode() multiplies rows, so broadcasting is ruled out.
    return (a.join(b.hint("merge"), ["table", "key"]).where((F.col("a") < F.col("b")) & (distance <= radius) & ~earlier)
            .select("a", "b", distance.alias("distance")))


def fingerprint_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``edited_fingerprints`` with n_near: the other documents whose fingerprint lies within
    ``radius``.  Only distinct fingerprints are searched; copies enter by their number."""
    got = staged(edited_fingerprints(df, doc_id, text), "fingerprint-rows")
    classes = got.groupBy(F.col("fingerprint").alias("fp")).agg(F.count("*").alias("n"))
    pairs = staged(near_fingerprints(classes, radius).select("a", "b"), "near-fingerprints")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(classes, both.b == classes.fp).groupBy("a").agg(F.sum("n").alias("others"))
    near = (classes.join(others, classes.fp == others.a, "left")
            .select("fp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near")).where("n_near > 0"))
    # Few fingerprints have others near; the rows of a large group of copies are dealt over SALTS parts.
    near = near.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    rows = got.withColumn("__part", F.pmod(F.xxhash64("doc_id", "edited_sha256"), F.lit(SALTS)).cast("int"))
    return (rows.join(near, (F.col("fingerprint") == F.col("fp")) & (F.col("__part") == F.col("part")), "left")
            .select(*got.columns, F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")))
