"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's bit is set if it is set in over half the XXH64 hashes of the text's word
shingles.  Fingerprints are mapped to bit counts of segments of their bits; the Manhattan distance
of two such vectors is at most the Hamming distance, so a grid range-join on the vectors with
the Hamming radius gives all candidates, which are then verified exactly.

The grid: the 64 bits are three bands.  Within radius 2, at least one band agrees in all its bit
counts (pigeonhole), and the others differ by 2 in Manhattan distance at most.  For each band, the
cell is the vector of the band's 2-bit segments (equal) with the counts of four coarse segments of
the other bits (within the radius).  A fingerprint is entered in one cell of each band and probes
the cells in reach, of each pair of opposite directions one.

Only distinct fingerprints are joined, so a group of copies is one row, and a fingerprint has at
most 2,080 others within 2 bits, whatever the size of its group.

Defined cases: null and empty texts, and those of white space, have fingerprint zero and are
linked like others; fewer words than a shingle: the whole sequence is one; rows without an id are
fingerprinted and linked, but are never a component's id; repeated rows stay; an empty table gives
an empty result; other columns are not read (``drop_near_copies`` keeps them); a very long text is hashed
in pieces of ``CHUNK`` shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import staged, words_of
from .components import components

SEED, SHINGLE, RADIUS = 42, 3, 2
#: shingles that are held at once
CHUNK = 65_536
#: bits of the bands; each has an even number, for segments of 2 bits
BANDS = (range(0, 22), range(22, 44), range(44, 64))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = words_of(text)
    if not words:
        return 0
    size = min(shingle, len(words))
    total = len(words) - size + 1
    votes = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        part = words[at:min(at + CHUNK, total) + size - 1]
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*[part[i:] for i in range(size)])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > total, bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def fingerprint_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Fingerprint as a signed long."""
    for batch in texts:
        yield pa.array(np.array([fingerprint(x.as_py()) for x in batch], np.uint64).view(np.int64), pa.int64())


def _mask(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _steps() -> list[tuple[int, ...]]:
    """Vectors of four numbers within the radius; of opposite ones the larger."""
    near = [(a, b, c, d) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3) for d in range(-2, 3)
            if abs(a) + abs(b) + abs(c) + abs(d) <= RADIUS]
    return [v for v in near if v >= (0, 0, 0, 0)]


def _cells(fp: Column) -> Column:
    """For each band (fine, c0..c3): the counts of its 2-bit segments, and four coarse counts."""
    low = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    one, two = fp.bitwiseXOR(high).bitwiseAND(low), fp.bitwiseAND(high).bitwiseAND(low)
    pairs = one.bitwiseOR(F.shiftleft(two, 1))
    bands = []
    for k, band in enumerate(BANDS):
        others = [b for b in range(64) if b not in band]
        quarter = [others[i * len(others) // 4:(i + 1) * len(others) // 4] for i in range(4)]
        bands.append(F.struct(F.lit(k).alias("band"), pairs.bitwiseAND(F.lit(_mask(band))).alias("fine"),
                              *[F.bit_count(fp.bitwiseAND(F.lit(_mask(q)))).cast("int").alias(f"c{i}")
                                for i, q in enumerate(quarter)]))
    return F.array(*bands)


def _cell(*counts: Column) -> Column:
    """One number for the band and four counts of -2 to 18."""
    out = F.col("band")
    for c in counts:
        out = out * 32 + (c + 2)
    return out


def linked_pairs(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints of a table with distinct ``fp`` within the radius."""
    cells = fps.select("fp", F.explode(_cells(F.col("fp"))).alias("s")).select("fp", "s.*")
    entered = cells.select(F.col("fp").alias("b"), "fine", _cell(*[F.col(f"c{i}") for i in range(4)]).alias("cell"))
    steps = F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(v)]) for v in _steps()])
    probes = (cells.withColumn("d", F.explode(steps))
              .select(F.col("fp").alias("a"), "fine", _cell(*[F.col(f"c{i}") + F.col(f"d.d{i}") for i in range(4)]).alias("cell"),
                      (F.abs("d.d0") + F.abs("d.d1") + F.abs("d.d2") + F.abs("d.d3") == 0).alias("own")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    # Estimates do not see how explode() multiplies rows, so broadcasting is ruled out.
    return (probes.join(entered.hint("merge"), ["fine", "cell"])
            .where(near & (F.col("a") != F.col("b")) & (~F.col("own") | (F.col("a") < F.col("b")))).select("a", "b"))


def simhash_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: 16 hex digits, and the smallest id that
    can be reached over links."""
    docs = staged(df.select(F.col(doc_id).alias("doc_id"), fingerprint_of(F.col(text)).alias("fp")), "simhash")
    fps = docs.groupBy("fp").agg(F.min("doc_id").alias("first"))
    # Each fingerprint becomes some sixty rows: as many tasks as a shuffle has, however few bytes they are now.
    dealt = fps.select("fp").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    linked = components(linked_pairs(dealt), "a", "b")
    of = fps.join(linked, fps.fp == linked.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    of = staged(of, "simhash-classes")
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = of.join(least, "component").select("fp", "component_id")
    return (docs.join(classes, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def drop_near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``df`` for each component: that of the smallest (id, hash of the text), rows without an
    id after all others.  Of rows with one id and one text, one stays."""
    key, body = F.col("__key"), F.col(text)
    keyed = df.withColumn("__key", F.struct(F.col(doc_id).isNull().alias("unnamed"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("id"),
                                            F.coalesce(F.md5(body.cast("binary")), F.lit("")).alias("hash")))
    # A component's id is its smallest key: the row that stays.
    kept = simhash_components(keyed, "__key", text).select(F.col("component_id").alias("__kept")).distinct()
    # Rows of one key go before the join, so that they do not meet in one of its tasks.
    return keyed.dropDuplicates(["__key"]).join(kept, key == F.col("__kept"), "left_semi").drop("__key")
