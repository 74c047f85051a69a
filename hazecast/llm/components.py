"""Connected components of an edge table by alternating star contractions.

Each round replaces every node's edges by edges to the smallest neighbour, first towards
larger neighbours and then towards smaller ones, until only stars are left.  All steps are
joins and pre-aggregated minima on the node, so a hub's rows may be split over tasks, and
each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _pairs(df: DataFrame, a, b) -> DataFrame:
    return (df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
            .where("u <> v").distinct())


def _state(df: DataFrame):
    r = df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (both ends of one integer type):
    ``component`` is the smallest node reachable.  Loops, repeated and reversed edges change
    nothing; rows with a null end are ignored; no edges give no rows."""
    e = staged(_pairs(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()), F.col(a), F.col(b)), "edges")
    state = _state(e)
    while state[0]:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = staged(_pairs(large, F.col("u"), F.col("v")), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))))
        e = staged(_pairs(small, F.col("u"), F.col("v")), "small-star")
        new = _state(e)
        if new == state:
            break
        state = new
    return (e.groupBy("u").agg(F.min("v").alias("v"))
            .select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
