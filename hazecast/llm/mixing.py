"""Mixing sources to target weights: temperature mixing realised as block permutations.

Source token shares p are raised to an exponent t, w = p^t / sum p^t.  The exponent is bisected:
either to the one whose weights have the target entropy, or to the smallest one (the flattest
mix) at which no source is repeated more often than the limit; with both, the limit wins.  The
weights are then realised: each source's documents fall into a power-of-two number of blocks of
about ``block_tokens`` tokens, an epoch is a keyed permutation of the blocks (an affine map and a
shift, so a block's rank needs no sort), whole epochs are used up first, and of the last epoch the
leading blocks up to the budget.  Reading the result by slot / n_slots interleaves the sources in
proportion to their weights.

Without a budget, the smallest one is taken at which every document is used at least once.

Defined cases: a null source is a source of its own; null and empty texts have no tokens; a source
without tokens is used once and has weight 0; documents without an id are dealt to blocks by
their text; repeated rows are used each; an empty table gives an empty result; a very long
text is read whole and lies in one block.  Columns of the input stay; one of a result's name is replaced.
A source has 2^30 blocks at most, as ranks are 64-bit products: beyond 2^30 times ``block_tokens`` tokens
(4.4e12 for the default) its blocks are larger than that.

DataFrame operations only.  Shuffles carry pre-aggregated rows of (source) and (source, block
rank); the documents themselves do not move, except where there are more sources than
``BROADCAST_ROWS``: then they meet the plan in a salted join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

#: bisections of the exponent; a job does LEVELS of them, by trying all their possible midpoints
STEPS, LEVELS = 40, 4
#: range of the exponent when an entropy is asked for, and of 0 to 1 for a repetition limit
WIDEST = 4.0
#: plans of at most so many sources (under 200 bytes each) are broadcast
BROADCAST_ROWS = 20_000
SALTS = 32
#: digits to which the exponent, the weights and the repetitions are rounded
DIGITS = 9


def _hash(*parts: Column) -> Column:
    """60-bit number from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def _plan_join(df: DataFrame, plan: DataFrame, n_sources: int, key: str) -> DataFrame:
    if n_sources <= BROADCAST_ROWS:
        return df.join(F.broadcast(plan), key)
    salted = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("__salt", (F.col("__mix_doc") % SALTS).cast("int")).join(salted, [key, "__salt"]).drop("__salt")


def _rank(block: Column, blocks: Column, source: Column, epoch: Column, seed: int) -> Column:
    """Place of a block in an epoch's permutation; ``blocks`` is a power of two up to 2^30."""
    key = _hash(F.lit(str(seed)), source, epoch.cast("string"))
    factor = (key % (1 << 28)) * 2 + 1
    shift = F.shiftrightunsigned(F.floor(F.log2(blocks)).cast("int") + 1, 1)
    x = F.pmod(block * factor + F.shiftright(key, 28), blocks)
    x = x.bitwiseXOR(F.expr("0L") + F.call_function("shiftright", x, shift))
    return F.pmod(x * factor, blocks)


def solve_exponent(shares: DataFrame, budget_share: float | None, target_entropy: float | None,
                   max_repetition: float | None) -> float:
    """The exponent for a staged table (p) of positive token shares.

    ``budget_share`` is the budget over all tokens, None for the smallest that uses everything.
    Each job tries the midpoints of several bisections at once; 15 sums reach the driver.
    """
    def bisect(high: float, too_flat) -> float:
        low, high, left = 0.0, high, STEPS
        while left > 0:
            n = 1 << min(LEVELS, left)
            points = [low + (high - low) * i / n for i in range(1, n)]
            rows = (shares.withColumn("t", F.explode(F.array(*[F.lit(t) for t in points])))
                    .groupBy("t").agg(F.sum(F.pow("p", "t")).alias("z"),
                                      F.sum(F.pow("p", "t") * F.log("p")).alias("s"),
                                      F.max(F.pow("p", F.col("t") - 1)).alias("most"),
                                      F.min(F.pow("p", F.col("t") - 1)).alias("least")).collect())
            flat = {r.t: too_flat(r) for r in rows}
            for t in points:  # all that are too flat lie below the solution
                if flat[t]:
                    low = t
                else:
                    high = t
                    break
            left -= LEVELS
        return round(high, DIGITS)

    t = 1.0
    if target_entropy is not None:
        t = bisect(WIDEST, lambda r: math.log(r.z) - r.t * r.s / r.z > target_entropy)
    if max_repetition is not None:
        def repeated(r):
            return r.most / r.least if budget_share is None else r.most / r.z * budget_share
        limit = bisect(1.0, lambda r: repeated(r) > max_repetition)
        t = max(t, limit) if target_entropy is not None else limit
    return t


def mix_sources(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                budget_tokens: int | None = None, target_entropy: float | None = None,
                max_repetition: float | None = None, block_tokens: int = 4_096, seed: int = 0) -> DataFrame:
    """One row for each use of a document: ``df`` with n_tokens, epoch (from 1), block, slot,
    n_slots, weight and exponent."""
    src = F.concat(F.when(F.col(source).isNull(), "n").otherwise("v"), F.coalesce(F.col(source).cast("string"), F.lit("")))
    doc = _hash(F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    tokens = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    slim = staged(df.select(src.alias("__mix_source"), doc.alias("__mix_doc"), tokens.alias("__mix_tokens")), "mix-slim")
    sources = staged(slim.groupBy("__mix_source").agg(F.sum("__mix_tokens").alias("tokens")), "mix-sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    n_sources = sources.count()
    positive = sources.where("tokens > 0").withColumn("p", F.col("tokens") / F.lit(float(max(total, 1))))
    share = None if budget_tokens is None else budget_tokens / max(total, 1)
    t = solve_exponent(positive.select("p"), share, target_entropy, max_repetition) if total else 1.0
    power = positive.withColumn("v", F.pow("p", F.lit(t)))
    z, least = power.agg(F.sum("v"), F.min(F.col("v") / F.col("p"))).first()
    # uses of a document of a source: its weight times the budget over its tokens
    scale = None if not total else 1 / least if share is None else share / z
    plan = (power.select("__mix_source", "tokens", F.round(F.col("v") / F.lit(z), DIGITS).alias("weight"),
                         F.round(F.col("v") / F.col("p") * F.lit(scale), DIGITS).alias("uses"))
            .unionByName(sources.where("tokens = 0").select("__mix_source", "tokens", F.lit(0.0).alias("weight"),
                                                            F.lit(1.0).alias("uses"))))
    wanted = F.greatest(F.ceil(F.col("tokens") / F.lit(block_tokens)), F.lit(1))
    plan = (plan.withColumn("blocks", F.least(F.pow(F.lit(2.0), F.ceil(F.log2(wanted.cast("double")))), F.lit(2.0 ** 30)).cast("long"))
            .withColumn("epochs", F.floor("uses").cast("long"))
            .withColumn("rest", F.round((F.col("uses") - F.floor("uses")) * F.col("tokens")).cast("long")))
    plan = staged(plan, "mix-plan")
    block = F.pmod(F.col("__mix_doc"), F.col("blocks"))
    # Where the last epoch ends: tokens by block rank, summed up by runs of 1,024 ranks first.
    ranks = staged(_plan_join(slim, plan.where("rest > 0"), n_sources, "__mix_source")
                   .withColumn("rank", _rank(block, F.col("blocks"), F.col("__mix_source"), F.col("epochs") + 1, seed))
                   .groupBy("__mix_source", "rank").agg(F.sum("__mix_tokens").alias("n"), F.first("rest").alias("rest"))
                   .withColumn("run", F.shiftright("rank", 10)), "mix-ranks")
    up_to = Window.partitionBy("__mix_source").rowsBetween(Window.unboundedPreceding, -1)
    runs = (ranks.groupBy("__mix_source", "run").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
            .withColumn("before", F.coalesce(F.sum("n").over(up_to.orderBy("run")), F.lit(0)))
            .where("before < rest and before + n >= rest").select("__mix_source", "run", "before"))
    ends = (ranks.join(runs, ["__mix_source", "run"])
            .withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(up_to.orderBy("rank")), F.lit(0)))
            .where("before < rest").groupBy("__mix_source").agg((F.max("rank") + 1).alias("last_ranks")))
    plan = staged(plan.join(ends, "__mix_source", "left").fillna(0, ["last_ranks"])
                  .select("__mix_source", "blocks", "epochs", "weight", "last_ranks"), "mix-final")
    got = df.withColumns({"__mix_source": src, "__mix_doc": doc})
    got = _plan_join(got, plan.withColumnsRenamed({c: f"__mix_{c}" for c in ("blocks", "epochs", "weight", "last_ranks")}),
                     n_sources, "__mix_source")
    blocks, epochs = F.col("__mix_blocks"), F.col("__mix_epochs")
    got = got.withColumn("__mix_block", F.pmod(F.col("__mix_doc"), blocks))
    last = _rank(F.col("__mix_block"), blocks, F.col("__mix_source"), epochs + 1, seed)
    got = got.withColumn("__mix_n", epochs + (last < F.col("__mix_last_ranks")).cast("long"))
    got = got.where("__mix_n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_n"))))
    got = got.withColumns({
        "n_tokens": tokens,
        "block": F.col("__mix_block"),
        "slot": (F.col("epoch") - 1) * blocks + _rank(F.col("__mix_block"), blocks, F.col("__mix_source"), F.col("epoch"), seed),
        "n_slots": epochs * blocks + F.col("__mix_last_ranks"),
        "weight": F.col("__mix_weight"),
        "exponent": F.lit(t),
    })
    return got.drop(*[c for c in got.columns if c.startswith("__mix_")])
