"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one kept per group.

Equal vectors are one class, which enters with its number of rows.  Spherical k-means is fitted on
a sample of at most ``SAMPLE`` classes; every class is assigned to its nearest cell (its home) and
enters as a probe each other cell whose border lies within ``margin``: the hyperplane halfway between
the two centroids is no farther than that.  Two unit vectors with cosine 0.95 are sqrt(0.1) = 0.316
apart at most, and their distances to the border between their cells add up to no more, so one of
them is within half of it: with the default margin, that half, the search is exact.  Within a cell
all home pairs and all probe-home pairs are compared in blocks of at most ``BLOCK`` rows a side, in
double precision; where both rows of a pair probe, the later cell alone counts it.

A block yields, per vector, the number of its links and the smallest member of its group within
the block, not pairs; so a dense group costs products but no rows.  Groups are the connected
components of these.

Defined cases: a vector that is null, empty or zero, or holds null or non-finite components, links
with nothing and is its own component; vectors of different lengths do not link; rows without an id
count as links of others but never name a component, and are not kept where they have links; rows
with one id are each a vector; repeated rows link with each other; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, hash_order, staged
from .components import components

THRESHOLD = 0.95
#: what rounding may add to a distance to a border
SLACK = 1e-6
#: classes that k-means is fitted on at most, numbers in them at most, its cells at most, its rounds
SAMPLE, SAMPLE_NUMBERS, CELLS, ROUNDS = 16_384, 1 << 22, 4_096, 10
#: rows of a block
BLOCK = 1_024


def unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small numbers would not hold
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """k unit centroids; cells that run empty keep their centroid."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        order = np.argsort(near, kind="stable")
        own, first = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], first)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = c.copy()
        c[own[size[:, 0] > 0]] = (sums / np.maximum(size, 1e-300))[size[:, 0] > 0]
    return c


def exact_margin(threshold: float) -> float:
    """Half the distance of two unit vectors with that cosine."""
    return max(2 - 2 * threshold, 0.0) ** 0.5 / 2


def cells_of(x: np.ndarray, c: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of each row, and (row, cell) of its probes: other cells with a border in reach."""
    gap = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
    sim = x @ c.T
    home = sim.argmax(axis=1)
    row, cell = np.nonzero((sim[np.arange(len(x)), home][:, None] - sim <= margin * gap[home] + SLACK)
                           & (np.arange(len(c))[None, :] != home[:, None]))
    return home, row, cell


def groups_within(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest member of each row's and column's group in the bipartite link matrix."""
    a, b, most = a.copy(), b.copy(), np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(a, np.where(linked, b[None, :], most).min(axis=1, initial=most))
        new_b = np.minimum(b, np.where(linked, new_a[:, None], most).min(axis=0, initial=most))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def met_elsewhere(probes: pd.DataFrame, homes: pd.DataFrame) -> np.ndarray:
    """Pairs of probes and homes that the probe's home cell counts: a later cell that the home row probes."""
    cells, at = np.unique(probes["home"].to_numpy(), return_inverse=True)
    sizes = [len(r) for r in homes["later"]]
    row, cell = np.repeat(np.arange(len(homes)), sizes), np.concatenate([np.asarray(r, np.int64) for r in homes["later"]])
    place = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
    own = cells[place] == cell
    reached = np.zeros((len(cells), len(homes)), bool)
    reached[place[own], row[own]] = True
    return reached[at]


def compare(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one block pair: rows with side 0 against side 1, or among themselves."""
    a = frame[frame["side"] == 0]
    same = frame["kind"].iloc[0] == 0 and frame["x"].iloc[0] == frame["y"].iloc[0]
    b = a if same else frame[frame["side"] == 1]
    if not len(a) or not len(b):
        return pd.DataFrame({"cid": [], "links": [], "to": []}, dtype="int64")
    xa = unit(a["vec"])
    linked = xa @ (xa if same else unit(b["vec"])).T >= threshold
    if same:
        np.fill_diagonal(linked, False)
    elif frame["kind"].iloc[0] == 1:
        linked &= ~met_elsewhere(a, b)
    ra, rb = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    linked = linked[np.ix_(ra, rb)]
    ia, ib = a["cid"].to_numpy(np.int64)[ra], b["cid"].to_numpy(np.int64)[rb]
    na, nb = a["n"].to_numpy(np.int64)[ra], b["n"].to_numpy(np.int64)[rb]
    ga, gb = groups_within(linked, ia, ib)
    out = [pd.DataFrame({"cid": ia, "links": linked @ nb, "to": ga})]
    if not same:
        out.append(pd.DataFrame({"cid": ib, "links": na @ linked, "to": gb}))
    return pd.concat(out)


def link_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
                 margin: float | None = None, block: int = BLOCK, cells: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row; no link is missed unless a margin less than the default is given."""
    margin = exact_margin(threshold) if margin is None else margin
    spark = df.sparkSession
    v = F.col("v")
    # Kept in the type given: floats and doubles alike are compared as doubles.
    base = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    fine = (v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists(v, lambda x: x != 0))
    base = staged(base.select("vec_id", F.when(fine, v).alias("v")).withColumn("cid", F.when(v.isNotNull(), F.xxhash64("v"))), "vectors")
    classes = staged(base.where("cid is not null").groupBy("cid", "v")
                     .agg(F.min("vec_id").alias("first"), F.count("*").alias("n")), "vector-classes")
    n_classes, n_keys = classes.agg(F.count("*"), F.count_distinct("cid")).first()
    if n_classes != n_keys:
        raise ValueError("two different vectors have one 64-bit hash")
    links = None
    for (size,) in classes.select(F.size("v")).distinct().collect() if n_classes else []:  # a number per vector length
        some = _links_of_length(classes.where(F.size("v") == size), size, threshold, margin, block, cells)
        links = some if links is None else links.unionByName(some)
    if links is None:
        links = spark.createDataFrame([], "cid long, links long, to long")
    links = staged(links.groupBy("cid", "to").agg(F.sum("links").alias("links")), "vector-links")
    groups = components(links.select("cid", "to"), "cid", "to")
    of = (classes.join(links.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
          .join(groups.withColumnRenamed("node", "cid"), "cid", "left")
          .select("cid", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                  F.coalesce("component", "cid").alias("component")))
    of = staged(of, "vector-groups")
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    of = of.join(least, "component").select("cid", "n_links", "component_id")
    alone = F.col("cid").isNull()
    # Rows without a class get keys of their own, so that they spread out.
    got = base.select("vec_id", "cid", F.coalesce("cid", F.xxhash64("vec_id", F.lit("alone"))).alias("k")).join(
        of.withColumnRenamed("cid", "of"), (F.col("k") == F.col("of")) & ~alone, "left")
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return got.select("vec_id", F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
                      component.cast("long").alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.coalesce(F.col("n_links"), F.lit(0)) == 0).alias("kept"))


def _links_of_length(classes: DataFrame, size: int, threshold: float, margin: float, block: int, cells: int | None) -> DataFrame:
    spark = classes.sparkSession
    n = classes.count()
    k = cells or int(min(CELLS, max(1, n ** 0.5)))
    rows = max(k, min(SAMPLE, SAMPLE_NUMBERS // size))
    sample = bounded_sample(classes, rows, n, hash_order("cid"), "cid").select("v").collect()  # at most SAMPLE vectors
    centroids = spherical_kmeans(unit([r.v for r in sample]), k)
    sent = spark.sparkContext.broadcast(centroids)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 4096):
                part = f.iloc[at:at + 4096]
                home, row, cell = cells_of(unit(part["v"]), sent.value, margin)
                up = cell > home[row]
                later = np.split(cell[up], np.searchsorted(row[up], np.arange(1, len(part))))
                yield pd.DataFrame({"cell": home, "probe": 0, "home": home, "later": later, "cid": part["cid"].to_numpy(),
                                    "n": part["n"].to_numpy(), "vec": part["v"].to_numpy()})
                p = part.iloc[row]
                yield pd.DataFrame({"cell": cell, "probe": 1, "home": home[row], "later": None, "cid": p["cid"].to_numpy(),
                                    "n": p["n"].to_numpy(), "vec": p["v"].to_numpy()})

    kind = classes.schema["v"].dataType.simpleString()
    assigned = staged(classes.select("cid", "n", "v").mapInPandas(assign, f"cell int, probe int, home int, later array<int>, cid long, n long, vec {kind}"), "vector-cells")
    counts = assigned.groupBy("cell").agg(F.sum(1 - F.col("probe")).alias("homes"), F.sum("probe").alias("probes"))  # a row per cell
    blocks = lambda c: F.ceil(F.col(c) / F.lit(block)).cast("int")
    counts = counts.select("cell", blocks("homes").alias("hb"), blocks("probes").alias("pb")).where("hb > 0")
    spread = assigned.join(F.broadcast(counts), "cell")  # at most CELLS rows
    own = lambda c: F.pmod(F.xxhash64("cid"), F.col(c)).cast("int")
    up_to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    homes = spread.where("probe = 0").withColumn("i", own("hb"))
    among = homes.withColumn("j", up_to("hb")).select("cell", F.lit(0).alias("kind"), F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"),
                                                      (F.col("i") > F.col("j")).cast("int").alias("side"), "home", F.lit(None).cast("array<int>").alias("later"),
                                                      "cid", "n", "vec")
    against = homes.where("pb > 0").withColumn("j", up_to("pb")).select("cell", F.lit(1).alias("kind"), F.col("j").alias("x"), F.col("i").alias("y"),
                                                                       F.lit(1).alias("side"), "home", "later", "cid", "n", "vec")
    probes = spread.where("probe = 1").withColumn("j", up_to("hb")).select("cell", F.lit(1).alias("kind"), own("pb").alias("x"), F.col("j").alias("y"),
                                                                          F.lit(0).alias("side"), "home", "later", "cid", "n", "vec")
    return (among.unionByName(against).unionByName(probes).groupBy("cell", "kind", "x", "y")
            .applyInPandas(lambda f: compare(f, threshold), "cid long, links long, to long"))
