"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at the special strings and by the tokenizer's split pattern; each piece is a
linked list of byte symbols whose adjacent pairs wait in a heap by rank.  Popping the lowest
rank (leftmost first) merges a pair; the count is the initial symbols minus the merges.  No
identifier sequence is built.  Pieces repeat a lot, so each worker keeps their counts in a
cache of bounded size.

Null and empty texts have 0 bytes and 0 tokens.  Repeated rows are counted each; columns of
the input stay, and one of a result's name is replaced; an empty table gives an empty result; of a
very long text one piece at a time is merged, in memory that grows with the piece.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Code points that the regex module knows as letters or numbers, but which came
# to Unicode after version 16, the one that the tokenizers library knows.
LATE = (
    "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    "\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    "\U0003d000-\U0003fc3f"
)
#: pieces whose counts a worker keeps at most, in two generations, and the longest of them
CACHE, LONGEST = 600_000, 64


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return {b: chr(b if b in shown else next(spare)) for b in range(256)}


class BytePairCounter:
    """Counts the tokens of texts for one byte-level BPE vocabulary."""

    def __init__(self, spec: str):
        doc = json.loads(spec)
        model, pre = doc["model"], doc["pre_tokenizer"]
        if (model["type"], pre["type"], doc.get("normalizer")) != ("BPE", "ByteLevel", None) or pre["add_prefix_space"] \
                or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("a byte-level BPE vocabulary without prefix space, dropout or normalizer is needed")
        special = doc.get("added_tokens", [])
        if any(t[k] for t in special for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens with strip or word flags are not supported")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # Symbols have numbers of their own here: a byte its value, a merged pair 256 + its rank.
        number = {c: b for b, c in byte_alphabet().items()} | {a + b: 256 + i for i, (a, b) in enumerate(merges)}
        self.bits = max(len(number), 256).bit_length()
        if len(number) != len(merges) + 256 or not number.keys() <= model["vocab"].keys():
            raise ValueError("a vocabulary with all bytes, and with one merge for each other symbol, is needed")
        #: left << bits | right -> rank << 32
        self.rank = {number[a] << self.bits | number[b]: i << 32 for i, (a, b) in enumerate(merges)}
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in
                                              sorted(special, key=lambda t: -len(t["content"])))) if special else None
        self.split = regex.compile(SPLIT)
        self.high = re.compile(f"[{LATE[0]}-{chr(0x10FFFF)}]")
        self.late = re.compile(f"[{LATE}]")
        self.split_late = regex.compile(
            SPLIT.replace(r"[^\s\p{L}\p{N}]", r"[[^\s\p{L}\p{N}]||[late]]").replace(r" ?\p{L}", r" ?[\p{L}--[late]]")
            .replace(r" ?\p{N}", r" ?[\p{N}--[late]]").replace("late", LATE), regex.V1)
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Tokens of one piece."""
        n, get, bits = len(piece), self.rank.get, self.bits
        sym = list(piece)
        # waiting[i]: the heap's entry (rank << 32 | i) for the pair that begins at i, or -1
        waiting = [-1 if (r := get(a << bits | b)) is None else r | i for i, (a, b) in enumerate(zip(sym, piece[1:]))]
        heap = [x for x in waiting if x >= 0]
        if not heap:
            return n
        heapq.heapify(heap)
        waiting.append(-1)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        left, pop, push = n, heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i = x & 0xFFFFFFFF
            if waiting[i] != x:
                continue  # one of the two has been merged meanwhile
            a = sym[i] = 256 + (x >> 32)
            j = nxt[i]
            nxt[i] = k = nxt[j]
            waiting[j] = waiting[i] = -1
            left -= 1
            if k < n:
                prev[k] = i
                if (r := get(a << bits | sym[k])) is not None:
                    waiting[i] = x = r | i
                    push(heap, x)
            h = prev[i]
            if h >= 0:
                if (r := get(sym[h] << bits | a)) is not None:
                    waiting[h] = x = r | h
                    push(heap, x)
                else:
                    waiting[h] = -1
        return left

    def look_up(self, piece: str) -> int:
        """Tokens of a piece that is not in the young generation of the cache."""
        c = self.old.get(piece)
        if c is None:
            c = self.merged(piece.encode("utf-8"))
        if len(piece) <= LONGEST:
            if len(self.young) >= CACHE // 2:
                self.old, self.young = self.young, {}
            self.young[piece] = c
        return c

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, parts = 0, [text]
        if self.special is not None:
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            split = self.split_late if self.high.search(part) and self.late.search(part) else self.split
            for m in split.findall(part):
                c = self.young.get(m)
                total += self.look_up(m) if c is None else c
        return total


#: the counter that a Python worker keeps from task to task, with its vocabulary
_KEPT: list = []


def _counter(spec: str) -> BytePairCounter:
    if not _KEPT or _KEPT[0] != spec:
        _KEPT[:] = [spec, BytePairCounter(spec)]
    return _KEPT[1]


def count_tokens(df: DataFrame, vocab_path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of ``text``.

    The vocabulary file (a few MB, whatever the data) is read on the driver and broadcast.
    No shuffle: each text is counted where it is read.
    """
    with open(vocab_path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("long")
    def tokens(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(spec.value)
        for batch in texts:
            yield pa.array([counter.count(x.as_py()) for x in batch], pa.int64())

    return (df.withColumn("n_tokens", tokens(F.col(text)))
            .withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
            .withColumn("over_limit", F.col("n_tokens") > limit))


def brute_force(text: str | None, counter: BytePairCounter) -> int:
    """Tokens of one piece by rescanning for the lowest pair; for tests."""
    sym = list(text_bytes(text))
    while True:
        ranks = [counter.rank.get(a << counter.bits | b, 1 << 60) for a, b in zip(sym, sym[1:])]
        if not ranks or min(ranks) == 1 << 60:
            return len(sym)
        i = ranks.index(min(ranks))
        sym[i:i + 2] = [256 + (ranks[i] >> 32)]
