"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: ASCII white space of every word definition here: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: bytes.translate table that lower-cases A-Z alone
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what is staged.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8") if text else b""


def doc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text as bytes."""
    return text_bytes(text).translate(LOWER).split()


def bounded_sample(df: DataFrame, n: int, total: int, order: Column, *ties: str) -> DataFrame:
    """``n`` of ``df``'s ``total`` rows (all, if they are fewer), by ``order``, a number from 0 to
    1 that is spread evenly.  What is far from being among the first n goes before the sort, so
    about 2 n rows meet in its last task, whatever the input."""
    picked = df.withColumn("__order", order).where(F.col("__order") <= F.lit(2 * n / max(total, 1)))
    return picked.orderBy("__order", *ties).limit(n).drop("__order")


def hash_order(*columns: str) -> Column:
    """A number from 0 to 1 by the hash of columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))
