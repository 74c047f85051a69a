"""Chat formatting with cumulative-snapshot collapse.

A chat log often holds a conversation several times, as it grew.  Rolling hashes of the turn
prefixes show which logged conversations are prefixes of longer ones; an anti-join keeps the
maximal conversations (of equal ones that with the smallest id), whose turns are then rendered.

The rolling hash of a prefix is the exclusive-or of 128-bit hashes of its (turn, role, text)
elements, so it can be built in runs of turns: windows within a run of ``RUN`` turn numbers, and a
carry over the runs' totals.  A conversation that holds a large part of all rows is thus spread
over many tasks, and joins are on (conversation, run) or on the hash.

Defined cases: null role and text are empty; a null turn comes last; rows of one turn are ordered
by role and text; repeated rows count once; rows with a null conversation id are one conversation,
which gives way to an equal one with an id; an empty table gives an empty result; columns besides
the four are not carried; a very long text is one row and is read whole.  Markers of the template
within texts are broken up by a blank.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

RUN = 1024
LAST = (1 << 62) - 1


def _elements(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
                     F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def prefix_states(elements: DataFrame) -> DataFrame:
    """(conv, n, x, y, last) for each turn prefix: turns in it, its hash, whether it is all."""
    turn = F.coalesce("turn", F.lit(LAST))
    salted = lambda h: F.bit_xor(F.xxhash64("at", h))
    by_turn = (elements.select("conv", turn.alias("at"), F.xxhash64("role", "text").alias("h"),
                               F.xxhash64(F.lit(7), "text", F.lit(11), "role").alias("g")).distinct()
               .groupBy("conv", "at").agg(salted("h").alias("x"), salted("g").alias("y"))
               .withColumn("run", F.floor(F.col("at") / F.lit(RUN))))
    by_turn = staged(by_turn, "chat-turns")
    w = Window.partitionBy("conv", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rolled = by_turn.select("conv", "run", F.count("*").over(w).alias("n"), F.bit_xor("x").over(w).alias("x"),
                            F.bit_xor("y").over(w).alias("y"))
    before = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = (by_turn.groupBy("conv", "run").agg(F.count("*").alias("m"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
            .select(F.col("conv").alias("c"), F.col("run").alias("r"),
                    F.coalesce(F.sum("m").over(before), F.lit(0)).alias("n0"),
                    F.coalesce(F.bit_xor("x").over(before), F.lit(0)).alias("x0"),
                    F.coalesce(F.bit_xor("y").over(before), F.lit(0)).alias("y0"),
                    F.sum("m").over(Window.partitionBy("conv")).alias("total")))
    n = F.col("n") + F.col("n0")
    return (rolled.join(runs, F.col("conv").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")))
            .select("conv", n.alias("n"), F.col("x").bitwiseXOR(F.col("x0")).alias("x"),
                    F.col("y").bitwiseXOR(F.col("y0")).alias("y"), (n == F.col("total")).alias("last")))


def maximal_conversations(elements: DataFrame) -> DataFrame:
    """(conv, n_turns, n_equal): conversations that are no prefix of a longer one; of equal
    ones that with the smallest id, with their number."""
    states = staged(prefix_states(elements), "chat-states")
    longer = states.where("not last").select("n", "x", "y").distinct()
    whole = states.where("last").groupBy("n", "x", "y").agg(F.min("conv").alias("conv"), F.count("*").alias("n_equal"))
    return whole.join(longer, ["n", "x", "y"], "left_anti").select("conv", F.col("n").alias("n_turns"), "n_equal")


def render_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", open_mark: str = "<|im_start|>", close_mark: str = "<|im_end|>") -> DataFrame:
    """One row per turn of the maximal conversations, in columns conv_id, turn, role, n_turns,
    n_equal and rendered; the rendered texts of a conversation in order of (turn, role, text)
    make up its training text."""
    elements = _elements(df, conv, turn, role, text)
    kept = maximal_conversations(elements)
    rows = elements.distinct()
    plain = F.col("text")
    name = F.col("role")
    for mark in (open_mark, close_mark):
        plain = F.replace(plain, F.lit(mark), F.lit(f"{mark[0]} {mark[1:]}"))
        name = F.replace(name, F.lit(mark), F.lit(f"{mark[0]} {mark[1:]}"))
    # The turns meet their conversation in its runs, so that a long conversation is spread over tasks.
    run = F.floor(F.coalesce("turn", F.lit(LAST)) / F.lit(RUN))
    rows = rows.withColumn("__run", run)
    kept = kept.withColumnRenamed("conv", "__kept")
    runs = (rows.select(F.col("conv").alias("__conv"), F.col("__run").alias("__at")).distinct()
            .join(kept, F.col("__conv").eqNullSafe(F.col("__kept"))))
    return (rows.join(runs, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("__run") == F.col("__at")))
            .select(F.col("conv").alias("conv_id"), "turn", "role", "n_turns", "n_equal",
                    F.concat(F.lit(open_mark), name, F.lit("\n"), plain, F.lit(f"{close_mark}\n")).alias("rendered")))
