"""Runs (maximal periodic stretches) of words by common extensions on suffix trees.

For a sequence of words two trees are built by Ukkonen's algorithm, one of the sequence and one of
its reversal.  The length of the longest common extension of two places is the string depth of the
lowest common ancestor of their leaves: a minimum over the Euler tour, answered from sparse-table
levels in constant time each.  The longest Lyndon word at each place, under the order of the
leaves and under the inverse order of words, is a candidate for the root of a run; the candidate
is extended to the right on the first tree and to the left on the second.  Every run has such a
root (Bannai et al., "The runs theorem"), with the run's smallest period as its length.

Asked are runs of at least ``MIN_LENGTH`` words and ``MIN_POWER`` periods.  Each five words that
begin in such a run, and end in it, are found again one period on or back in it, that is within a
quarter of the text.  Trees are built for the stretches made of such places, each alone; a run lies
within one of them, with what ends it, so no run is lost.

A text is one row and its trees lie in one task: some 500 bytes per word of its longest stretch.

Defined cases: null and empty texts, and those of white space, have no words and no runs; repeated
rows are each searched; columns of the input stay, and one of a result's name is replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import text_bytes

MIN_LENGTH, MIN_POWER = 6, 4
#: words that must be found again
GRAM = 5


def suffix_tree(s: list[int], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ukkonen's tree of ``s``, numbers below ``size`` whose last occurs nowhere else.

    By node (0 is the root): parent, first place and length of the label, string depth; and the
    leaf of each suffix.
    """
    n = len(s)
    # A leaf's label is open: its end is the text's.
    start, end, link, parent = array("q", [0]), array("q", [0]), array("q", [0]), array("q", [0])
    leaf = array("q")
    child: dict[int, int] = {}  # node * size + word -> child
    node = edge = length = 0  # the active point: length words below node, on the edge that begins with s[edge]
    pending = 0
    for i, c in enumerate(s):
        pending += 1
        inner = 0
        while pending:
            if not length:
                edge = i
            key = node * size + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                leaf.append(len(start))
                start.append(i), end.append(n), link.append(0), parent.append(node)
                if inner:
                    link[inner] = node
                inner = 0
            else:
                a = start[below]
                size_below = min(end[below], i + 1) - a
                if length >= size_below:
                    node, edge, length = below, edge + size_below, length - size_below
                    continue
                if s[a + length] == c:
                    if inner:
                        link[inner] = node
                    length += 1
                    break
                split = len(start)
                child[key] = split
                start.append(a), end.append(a + length), link.append(0), parent.append(node)
                start[below] = a + length
                parent[below] = split
                child[split * size + s[a + length]] = below
                child[split * size + c] = split + 1
                leaf.append(split + 1)
                start.append(i), end.append(n), link.append(0), parent.append(split)
                if inner:
                    link[inner] = split
                inner = split
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - pending + 1
    del child
    start, end, parent = (np.frombuffer(x, np.int64).copy() for x in (start, end, parent))
    size_of = end - start
    leaves = np.frombuffer(leaf, np.int64).copy()
    depth = size_of.copy()  # string depths by doubling the way upwards
    up = parent.copy()
    while up.any():
        depth += depth[up]
        up = up[up]
    return parent, start, size_of, depth, leaves


def children_in_order(parent: np.ndarray, word: np.ndarray) -> tuple[list[int], list[int]]:
    """Nodes other than the root by (parent, word), and where each parent's begin."""
    order = np.lexsort((word[1:], parent[1:])) + 1
    return order.tolist(), np.searchsorted(parent[order], np.arange(len(parent) + 1)).tolist()


def tour(order: list[int], first: list[int]) -> np.ndarray:
    """Euler tour: each node when it is come to, and again after each of its children."""
    out, nodes, upto = array("q", [0]), [0], [first[0]]
    while nodes:
        k = upto[-1]
        if k < first[nodes[-1] + 1]:
            upto[-1] = k + 1
            node = order[k]
            out.append(node)
            nodes.append(node)
            upto.append(first[node])
        else:
            nodes.pop()
            upto.pop()
            if nodes:
                out.append(nodes[-1])
    return np.frombuffer(out, np.int64)


class Extensions:
    """Longest common extensions to the right between places of a sequence."""

    def __init__(self, words: np.ndarray, inverse: bool = False):
        n = len(words)
        size = int(words.max()) + 2
        s = np.append(words + 1, 0)
        parent, start, _, depth, leaves = suffix_tree(s.tolist(), size)
        label = s[np.minimum(start, n)]
        way = tour(*children_in_order(parent, label))
        self.depth = depth[way]
        seen = np.full(len(parent), -1)
        seen[way[::-1]] = np.arange(len(way))[::-1]
        self.at = seen[leaves]
        #: number of each suffix in the order of the leaves; the empty one is the lowest
        self.rank = np.argsort(np.argsort(self.at))
        if inverse:  # words the other way round, the end still before all of them
            way = tour(*children_in_order(parent, np.where(label > 0, size - label, 0)))
            seen[way[::-1]] = np.arange(len(way))[::-1]
            self.inverse = np.argsort(np.argsort(seen[leaves]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``a`` and ``b`` (different ones) begin with alike."""
        low, high = np.minimum(self.at[a], self.at[b]), np.maximum(self.at[a], self.at[b])
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out, table = np.zeros(len(low), np.int64), self.depth
        for k in range(int(level.max(initial=0)) + 1):  # one level of the sparse table at a time
            if k:
                table = np.minimum(table[:-(1 << (k - 1))], table[1 << (k - 1):])
            here = np.flatnonzero(level == k)
            out[here] = np.minimum(table[low[here]], table[high[here] + 1 - (1 << k)])
        return out


def lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place: the way to the next lower suffix."""
    r = rank.tolist()
    out, stack = [0] * len(r), []
    for i in range(len(r) - 1, -1, -1):
        while stack and r[stack[-1]] > r[i]:
            stack.pop()
        out[i] = (stack[-1] if stack else len(r)) - i
        stack.append(i)
    return np.array(out, np.int64)


def runs_within(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the runs of a stretch."""
    n = len(words)
    forth = Extensions(words, inverse=True)
    back = Extensions(words[::-1])
    root = np.concatenate([lyndon_lengths(forth.rank)[:n], lyndon_lengths(forth.inverse)[:n]])
    at = np.tile(np.arange(n), 2)
    fits = (at + root < n) & (MIN_POWER * root <= n)
    at, root = at[fits], root[fits]
    right = forth.common(at, at + root)
    # Place i of the reversal is n - 1 - i; the empty suffix n stands for what lies before the first word.
    left = back.common(n - at, n - at - root)
    found = np.stack([at - left, left + root + right, root], axis=1)
    return np.unique(found[found[:, 1] >= np.maximum(MIN_LENGTH, MIN_POWER * root)], axis=0)


def stretches(words: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of the stretches that can hold runs."""
    todo = [(0, len(words))]
    while todo:
        a, b = todo.pop()
        n = b - a
        if n < MIN_LENGTH:
            continue
        gram = np.zeros(n - GRAM + 1, np.uint64)
        for k in range(GRAM):
            gram = (gram ^ words[a + k:b - GRAM + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            gram ^= gram >> np.uint64(32)
        order = np.argsort(gram, kind="stable")
        near = (gram[order[1:]] == gram[order[:-1]]) & (np.diff(order) <= n // MIN_POWER)
        cover = np.zeros(n + 1, np.int64)
        again = np.zeros(n - GRAM + 1, bool)
        again[order[1:][near]] = again[order[:-1][near]] = True
        cover[:n - GRAM + 1] += again
        cover[GRAM:] -= again
        inside = np.diff(np.concatenate([[0], (np.cumsum(cover[:n]) > 0).view(np.int8), [0]]))
        parts = list(zip((a + np.flatnonzero(inside == 1)).tolist(), (a + np.flatnonzero(inside == -1)).tolist()))
        if parts == [(a, b)]:
            yield a, b
        else:
            todo += parts


def runs(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of numbers, by start and period."""
    found = [np.zeros((0, 3), np.int64)]
    for a, b in stretches(words):
        got = runs_within(np.unique(words[a:b], return_inverse=True)[1])
        got[:, 0] += a
        found.append(got)
    got = np.concatenate(found)
    return got[np.lexsort((got[:, 2], got[:, 0]))]


def collapsed(n: int, found: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:n]) == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RESULT = pa.struct([("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_RUN_TYPE = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
_RESULT_TYPE = StructType([StructField("runs", ArrayType(_RUN_TYPE)), StructField("collapsed", StringType())])
#: texts of a batch that are turned into results at once
SLICE = 256


@F.arrow_udf(_RESULT_TYPE)
def _searched(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        parts = []
        for at in range(0, len(batch), SLICE):
            kept, found = [], []
            for text in batch.slice(at, SLICE):
                words = text_bytes(text.as_py()).split()
                number: dict[bytes, int] = {}
                got = runs(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
                if len(got):
                    words = [words[i] for i in np.flatnonzero(collapsed(len(words), got)).tolist()]
                kept.append(b" ".join(words))
                found.append(got)
            flat = np.concatenate(found)
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN))
            parts.append(pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), rows),
                                                     pa.array(kept, pa.binary()).cast(pa.string())], fields=list(_RESULT)))
        yield pa.concat_arrays(parts) if parts else pa.array([], _RESULT)


def find_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``runs`` (array of start, length, period by start and period) and ``collapsed``, the
    words that stay when each run is cut down to one period."""
    got = df.withColumn("__runs", _searched(F.col(text)))
    return got.withColumns({"runs": F.col("__runs.runs"), "collapsed": F.col("__runs.collapsed")}).drop("__runs")


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period, the first of equals; null without runs."""
    return F.aggregate(runs, F.lit(None).cast(_RUN_TYPE),
                       lambda best, r: F.when(best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best))


def with_repeats(df: DataFrame, chosen: Column, at, period, text: str = "text") -> DataFrame:
    """``df`` where, in ``chosen`` texts with words, each word from place ``at(n)`` on is the one
    ``period(n)`` places before it, and words are joined by spaces; ``n`` is the number of words."""
    split = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = df.withColumn("__words", F.when(chosen, split))
    n = F.size("__words").cast("long")
    cut = cut.withColumns({"__n": n, "__at": F.when(n > 0, at(n)), "__period": F.when(n > 0, period(n))})
    words, first, step = F.col("__words"), F.col("__at"), F.col("__period")
    planted = F.transform(words, lambda w, i: F.when(i < first, w).otherwise(F.get(words, (first + (i - first) % step).cast("int"))))
    return (cut.withColumn(text, F.when(F.col("__n") > 0, F.array_join(planted, " ")).otherwise(F.col(text)))
            .drop("__words", "__n", "__at", "__period"))
