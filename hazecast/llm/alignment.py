"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of linked ids.

Byte offsets where a token of each vocabulary ends cut a text's tokens into groups.  A stretch of
the text, read alone, is a fragment: an open prefix (tokens up to the first such offset), closed
groups, and an open suffix (tokens after the last one); without such an offset it is open as a
whole.  Fragments compose, and the order of composing is free: a suffix and the prefix after it are
a closed group.

No token of either vocabulary crosses a space after what is no white space.  Short texts are composed,
where they are read, of the closed fragments between such places, most of which a worker has met
before.  A longer text is cut into units at some of these places; units are dealt over tasks, and each is read in chunks of ``CHUNK`` bytes.  The chunks' closed
groups are written out, the open ends of up to ``FAN`` neighbours are composed at a time, in a tree,
and the groups closed on the way are written out too; a last pass streams a text's groups in order
through one digest.

A text's distinct linked id pairs are kept with their numbers.  Pairs are counted by one aggregation;
an id's highest count is a table no longer than its vocabulary.  The ``HOT`` most frequent pairs go
to every task; the rest, of which none is frequent, is joined.

Defined cases: null and empty texts, and those that one tokenizer changes (joined token bytes differ
from a space and the text), have no tokens, zeros, and an empty digest; repeated rows count each as a
document; a word without spaces is one unit, however long; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .token_counts import byte_alphabet

#: bytes of a text that is settled where it is read; characters of a unit, at least; bytes of a chunk
LONG, UNIT, CHUNK = 1 << 16, 1 << 16, 1 << 16
#: fragments composed at once; most frequent pairs that every task gets
FAN, HOT = 64, 1 << 18
#: characters tokenized at once; pairs of a group that are listed one by one
SLICE, LISTED = 1 << 20, 4_096
#: segments that a worker remembers at most, and 16 pairs for each
KEPT = 250_000


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and the decimal ids with what may follow them."""

    def __init__(self, spec: str, proto: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=proto)
        byte = {c: b for b, c in byte_alphabet().items()}
        self.size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        text = [self.a.id_to_token(i) or "" for i in range(self.size_a)]
        self.a_bytes = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in text]
        self.b_bytes = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode()
                        for i, t in enumerate(map(self.b.id_to_piece, range(self.size_b)))]
        self.a_len, self.b_len = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        ids = [str(i).encode() for i in range(max(self.size_a, self.size_b))]
        self.memory: Memory | None = None
        self.said = [ids[i] + end for n in (self.size_a, self.size_b) for i in range(n) for end in (b",", b"|", b";")]

    def encode(self, text: str) -> tuple[list[int], list[int], int]:
        """Ids of a space and the text by both; the bytes, or 0 if one of them doesn't give these back."""
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        raw = (" " + text).encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
        return a, b, len(raw) if same else 0


#: the vocabularies that a Python worker keeps from task to task
_KEPT: list = []


def vocabularies(spec: str, proto: bytes) -> Vocabularies:
    if not _KEPT or _KEPT[0] != (spec, proto):
        _KEPT[:] = [(spec, proto), Vocabularies(spec, proto)]
    return _KEPT[1]


def counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's weights."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
    return keys[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


def group_pairs(a: np.ndarray, b: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group as ``a * size_b + b``, and their numbers."""
    (a, m), (b, n) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    return (a[:, None] * size_b + b).ravel(), (m[:, None] * n).ravel()


class Fragments:
    """Fragments of the chunks of some units, whose tokens give the units' bytes.

    Chunk by chunk: numbers of tokens, groups and links of the closed groups, codes of their text,
    their distinct pairs with numbers, and the open tokens.
    """

    def __init__(self, voc: Vocabularies, a_ids: np.ndarray, b_ids: np.ndarray, sizes: np.ndarray, chunk: int = 0):
        """``sizes``: bytes of the units, whose tokens lie one after the other."""
        self.voc = voc
        a_end, b_end = np.cumsum(voc.a_len[a_ids]), np.cumsum(voc.b_len[b_ids])
        unit_end = np.cumsum(sizes)
        unit_start = np.append(0, unit_end[:-1])
        # Chunks by their first byte; without a size each unit is one.
        parts = -(-sizes // chunk) if chunk else np.ones(len(sizes), np.int64)
        self.unit = np.repeat(np.arange(len(sizes)), parts)
        self.number = np.arange(len(self.unit)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = unit_start[self.unit] + self.number * chunk
        n = len(start)
        common = a_end[b_end[np.searchsorted(b_end, a_end)] == a_end]
        in_chunk = lambda end: np.searchsorted(start, end - 1, "right") - 1
        at = in_chunk(common)
        before = np.append(0, common[:-1])
        closed = (before > start[at]) | (before == start[at]) & (self.number[at] == 0)
        self.cut = np.zeros(n, bool)
        self.cut[at] = True
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        self.open = []
        for ids, end, group in ((a_ids, a_end, a_group), (b_ids, b_end, b_group)):
            left = np.flatnonzero(~closed[group])
            own = in_chunk(end[left])
            # Before the chunk's first common end (or without one): prefix; after its last: suffix.
            self.open.append((ids[left], own, (at[group[left]] > own) & self.cut[own]))
        number = np.cumsum(closed) - 1
        a, a_group = (x[closed[a_group]] for x in (a_ids, number[a_group]))
        b, b_group = (x[closed[b_group]] for x in (b_ids, number[b_group]))
        at = at[closed]
        m = len(at)
        na, nb = np.bincount(a_group, minlength=m), np.bincount(b_group, minlength=m)
        a_first, b_first, first = np.cumsum(na) - na, np.cumsum(nb) - nb, np.cumsum(na + nb) - na - nb
        self.codes = np.zeros(len(a) + len(b), np.int64)
        a_rank, b_rank = np.arange(len(a)) - a_first[a_group], np.arange(len(b)) - b_first[b_group]
        self.codes[first[a_group] + a_rank] = a * 3 + (a_rank == na[a_group] - 1)
        self.codes[first[b_group] + na[b_group] + b_rank] = (voc.size_a + b) * 3 + 2 * (b_rank == nb[b_group] - 1)
        total = lambda x: np.bincount(at, weights=x, minlength=n).astype(np.int64)
        self.n_a, self.n_b, self.n_groups, self.n_links = total(na), total(nb), np.bincount(at, minlength=n), total(na * nb)
        self.code_end = np.cumsum(self.n_a + self.n_b)
        # Small groups' pairs are listed, large groups' counted by distinct ids.
        few = (na * nb <= LISTED)[a_group]
        times = np.where(few, nb[a_group], 0)
        k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        keys = [np.repeat(a * voc.size_b + at[a_group] * (voc.size_a * voc.size_b), times) + b[np.repeat(b_first[a_group], times) + k]]
        weights = [np.ones(len(k), np.int64)]
        for g in np.flatnonzero(na * nb > LISTED).tolist():
            pairs, numbers = group_pairs(a[a_first[g]:a_first[g] + na[g]], b[b_first[g]:b_first[g] + nb[g]], voc.size_b)
            keys.append(pairs + at[g] * (voc.size_a * voc.size_b))
            weights.append(numbers)
        keys, self.times = counted(np.concatenate(keys), np.concatenate(weights))
        own, self.pairs = np.divmod(keys, voc.size_a * voc.size_b)
        self.pair_end = np.searchsorted(own, np.arange(n), "right")

    def texts(self) -> list[bytes]:
        """Closed groups of each chunk, a ``;`` after each group."""
        said = list(map(self.voc.said.__getitem__, self.codes.tolist()))
        ends = self.code_end.tolist()
        return [b"".join(said[i:j]) for i, j in zip([0, *ends], ends)]

    def pairs_of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.pair_end[i - 1] if i else 0, self.pair_end[i])
        return self.pairs[span], self.times[span]

    def ends(self, i: int) -> list[list[int]]:
        """Open tokens of a chunk: prefix by both vocabularies, suffix by both."""
        return [ids[(own == i) & (after == late)].tolist() for late in (False, True) for ids, own, after in self.open]


def in_slices(rows: Iterable, size, limit: int) -> Iterator[list]:
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in zip(*batch.columns):
            yield tuple(x.as_py() for x in row)


_INT, _IDS = pa.int64(), pa.list_(pa.int32())
_STATS = [("n_a", _INT), ("n_b", _INT), ("n_groups", _INT), ("n_links", _INT)]
_PAIRS = [("pairs", pa.list_(_INT)), ("times", pa.list_(_INT))]
_SHORT = pa.schema([("doc_id", _INT), *_STATS, ("groups_sha256", pa.string()), *_PAIRS])
_SHORT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
_NONE = np.zeros(0, np.int64)


_SAFE = re.compile(r"(?<=\S) (?=.)", re.S)
_UNSAFE = re.compile(r"^ |\s | $")


def segments(text: str) -> list[str]:
    """All parts of a text between safe places, without the space that each but the first begins with."""
    return _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")


class Memory:
    """Closed fragments of segments met before, in flat arrays; a text is composed of them."""

    def __init__(self, voc: Vocabularies):
        self.voc = voc
        self.number: dict[str, int] = {}
        self.text: list[bytes] = []
        #: n_a, n_b, n_groups, n_links, and 1 where the tokens don't give the segment's bytes
        self.stats = np.zeros((0, 5), np.int64)
        #: uses, and pairs, of each segment
        self.used, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs, self.times, self.pair_end = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Leave out the segments met least, half of them at least."""
        keep = self.used > max(1, int(np.quantile(self.used, 0.5)))
        held = np.repeat(keep, self.size)
        self.pairs, self.times, self.size = self.pairs[held], self.times[held], self.size[keep]
        self.stats, self.used, self.pair_end = self.stats[keep], self.used[keep] // 2, np.cumsum(self.size)
        names = [s for s, k in zip(self.number, keep.tolist()) if k]  # in the order of their numbers
        self.text = [self.text[i] for i in np.flatnonzero(keep).tolist()]
        self.number = dict(zip(names, range(len(names))))

    def _learnt(self, part: list[str]) -> None:
        """Enter segments, read as one text."""
        a, b, same = self.voc.encode(" ".join(part))
        if not same:
            if len(part) > 1:  # halves, down to the segments that a tokenizer changes
                self._learnt(part[:len(part) // 2])
                self._learnt(part[len(part) // 2:])
                return
            stats, said = np.array([[0, 0, 0, 0, 1]]), [b""]
            pairs, times, sizes = _NONE, _NONE, np.zeros(1, np.int64)
        else:
            got = Fragments(self.voc, np.array(a, np.int64), np.array(b, np.int64), np.array([len(s.encode()) + 1 for s in part]))
            stats = np.stack([got.n_a, got.n_b, got.n_groups, got.n_links, np.zeros(len(part), np.int64)], axis=1)
            said, pairs, times, sizes = got.texts(), got.pairs, got.times, np.diff(np.append(0, got.pair_end))
        self.number.update(zip(part, range(len(self.text), len(self.text) + len(part))))
        self.text += said
        self.stats, self.pairs, self.times, self.size = (
            np.concatenate(x) for x in ((self.stats, stats), (self.pairs, pairs), (self.times, times), (self.size, sizes)))

    def learn(self, new: list[str]) -> None:
        # Many segments are read as one text; what ends in white space would join the space after it.
        for part in in_slices((s for s in new if not s[-1:].isspace()), lambda x: len(x) + 1, SLICE):
            self._learnt(part)
        for last in (s for s in new if s[-1:].isspace()):
            self._learnt([last])
        self.used = np.concatenate([self.used, np.zeros(len(self.text) - len(self.used), np.int64)])
        self.pair_end = np.cumsum(self.size)

    def rows(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, digest, pairs, times) of each of some texts, none of them empty."""
        cut = [segments(t) for t in texts]
        if len(self.number) > KEPT or len(self.pairs) > KEPT * 16:
            self.forget()
        new = list(set().union(*cut).difference(self.number))
        if new:
            self.learn(new)
        of = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64)
        self.used += np.bincount(of, minlength=len(self.used))
        size = np.array([len(x) for x in cut])
        first = np.cumsum(size) - size
        stats = np.add.reduceat(self.stats[of], first, axis=0)
        bad = stats[:, 4] > 0
        doc = np.repeat(np.arange(len(cut)), size)
        many = self.size[of]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.pair_end[of] - many, many)
        whole = self.voc.size_a * self.voc.size_b
        keys, times = counted(np.repeat(doc, many) * whole + self.pairs[place], self.times[place])
        own, pairs = np.divmod(keys, whole)
        ends = np.searchsorted(own, np.arange(len(cut) + 1)).tolist()
        of, text, out = of.tolist(), self.text.__getitem__, []
        for k, (at, n) in enumerate(zip(first.tolist(), size.tolist())):
            if bad[k]:
                out.append(_EMPTY)
                continue
            said = b"".join(map(text, of[at:at + n]))
            span = slice(ends[k], ends[k + 1])
            out.append((*stats[k, :4].tolist(), hashlib.sha256(said[:-1]).hexdigest(), pairs[span], times[span]))
        return out


_EMPTY = (0, 0, 0, 0, "", _NONE, _NONE)


def _short(model):
    """Whole texts, each composed of its segments' fragments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabularies(*model.value)
        if voc.memory is None:
            voc.memory = Memory(voc)
        for rows in in_slices(_tuples(batches), lambda r: len(r[1] or ""), SLICE):
            texts = [t for _, t in rows if t]
            got = iter(voc.memory.rows(texts) if texts else ())
            yield _batch(_SHORT, [(doc_id, *(next(got) if t else _EMPTY)) for doc_id, t in rows])
    return run


_UNIT = pa.schema([("row", _INT), ("doc_id", _INT), ("unit", _INT), ("text", pa.string())])


def units(text: str, size: int) -> Iterator[str]:
    """Parts of a text, of ``size`` characters at least but for the last; the space that each but the
    first begins with is left out, as the tokenizers put one in front."""
    at = 0
    while (m := _SAFE.search(text, at + size)) is not None:
        yield text[at:m.start()]
        at = m.end()
    yield text[at:]


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, doc_id, text in _tuples(batches):
            for part in in_slices(enumerate(units(text, size)), lambda u: len(u[1]), SLICE):
                yield _batch(_UNIT, [(row, doc_id, k, u) for k, u in part])
    return run


_LEAF = pa.schema([("row", _INT), ("doc_id", _INT), ("unit", _INT), ("chunk", _INT), ("ok", pa.bool_()), *_STATS, ("said", pa.binary()),
                   *_PAIRS, ("cut", pa.bool_()), ("pa", _IDS), ("pb", _IDS), ("sa", _IDS), ("sb", _IDS)])
_LEAF_DDL = ("row long, doc_id long, unit long, chunk long, ok boolean, n_a long, n_b long, n_groups long, n_links long, said binary, "
             "pairs array<long>, times array<long>, cut boolean, pa array<int>, pb array<int>, sa array<int>, sb array<int>")


def _leaves(model, chunk: int):
    """Fragments of the chunks of units."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabularies(*model.value)
        for rows in in_slices(_tuples(batches), lambda r: len(r[3]), SLICE):
            ids = [voc.encode(r[3]) for r in rows]
            good = [i for i, x in enumerate(ids) if x[2]]
            out = [(*r[:3], 0, False, 0, 0, 0, 0, b"", _NONE, _NONE, True, [], [], [], []) for r, x in zip(rows, ids) if not x[2]]
            if good:
                a, b = (np.fromiter(chain.from_iterable(ids[i][k] for i in good), np.int64) for k in (0, 1))
                got = Fragments(voc, a, b, np.array([ids[i][2] for i in good]), chunk)
                out += [(*rows[good[u]][:3], int(got.number[k]), True, int(got.n_a[k]), int(got.n_b[k]), int(got.n_groups[k]),
                         int(got.n_links[k]), said, *got.pairs_of(k), bool(got.cut[k]), *got.ends(k))
                        for k, (u, said) in enumerate(zip(got.unit.tolist(), got.texts()))]
            yield _batch(_LEAF, out)
    return run


def compose(x: tuple, y: tuple) -> tuple[tuple, tuple | None]:
    """Two neighbouring fragments (cut, place of the first cut, prefix a, prefix b, suffix a, suffix b)
    as one, and the group that closes between them (place, a, b), if any."""
    if x[0] and y[0]:
        a, b = x[4] + y[2], x[5] + y[3]
        return (True, x[1], x[2], x[3], y[4], y[5]), (y[1], a, b) if a or b else None
    if x[0]:
        return (True, x[1], x[2], x[3], x[4] + y[2], x[5] + y[3]), None
    return (y[0], y[1], x[2] + y[2], x[3] + y[3], y[4], y[5]), None


_NODE = pa.schema([("group", pa.bool_()), ("row", _INT), ("pos", _INT), ("cut", pa.bool_()), ("at", _INT),
                   ("pa", _IDS), ("pb", _IDS), ("sa", _IDS), ("sb", _IDS)])
_NODE_DDL = "group boolean, row long, pos long, cut boolean, at long, pa array<int>, pb array<int>, sa array<int>, sb array<int>"


def _composed(fan: int):
    """Of fragments sorted by (row, pos): one of each ``fan`` neighbours, and groups closed between them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = held = None
        for row, pos, *fragment in _tuples(batches):
            out = []
            if (row, pos // fan) != key:
                if key is not None:
                    out.append((False, *key, *held))
                key, held = (row, pos // fan), tuple(fragment)
            else:
                held, group = compose(held, tuple(fragment))
                if group is not None:
                    out.append((True, row, 0, True, *group, [], []))
            if out:
                yield _batch(_NODE, out)
        if key is not None:
            yield _batch(_NODE, [(False, *key, *held)])
    return run


_GROUP = pa.schema([("row", _INT), ("pos", _INT), *_STATS, ("said", pa.binary()), *_PAIRS])
_GROUP_DDL = ("row long, pos long, n_a long, n_b long, n_groups long, n_links long, said binary, pairs array<long>, times array<long>")


def _groups(size_b: int):
    """Text and pairs of single groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, pos, a, b in _tuples(batches):
            said = ",".join(map(str, a)) + "|" + ",".join(map(str, b)) + ";"
            pairs = group_pairs(np.array(a, np.int64), np.array(b, np.int64), size_b)
            yield _batch(_GROUP, [(row, pos, len(a), len(b), 1, len(a) * len(b), said.encode(), *pairs)])
    return run


_LONG = pa.schema([("row", _INT), ("doc_id", _INT), *_STATS, ("groups_sha256", pa.string())])
_LONG_DDL = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and the digest of each text from its parts, sorted by (row, pos, part)."""
    row = None

    def result():
        if not ok:
            return _batch(_LONG, [(row, doc_id, 0, 0, 0, 0, "")])
        digest.update(held[:-1])
        return _batch(_LONG, [(row, doc_id, *sums, digest.hexdigest())])

    for r in _tuples(batches):
        if r[0] != row:
            if row is not None:
                yield result()
            row, doc_id, ok, sums, digest, held = r[0], None, True, [0] * 4, hashlib.sha256(), b""
        doc_id = r[3] if r[3] is not None else doc_id
        ok &= r[4]
        sums = [s + x for s, x in zip(sums, r[5:9])]
        if r[9]:
            digest.update(held)
            held = r[9]
    if row is not None:
        yield result()


def _long(docs: DataFrame, model, size_b: int, unit: int, chunk: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, sums, digest) and pairs (row, pair, times) of long texts."""
    cut = staged(docs.withColumn("row", -1 - F.monotonically_increasing_id()).select("row", "doc_id", "text")
                 .mapInArrow(_cut(unit), "row long, doc_id long, unit long, text string"), "align-units")
    leaves = staged(cut.repartition("row", "unit").mapInArrow(_leaves(model, chunk), _LEAF_DDL), "align-leaves")
    pos = (F.row_number().over(Window.partitionBy("row").orderBy("unit", "chunk")) - 1).cast("long")
    placed = staged(leaves.select("row", "unit", "chunk", "cut", "pa", "pb", "sa", "sb").withColumn("pos", pos), "align-places")
    ends = ["cut", "at", "pa", "pb", "sa", "sb"]
    nodes = placed.withColumn("at", F.col("pos"))
    groups, most = [], placed.agg(F.max("pos")).first()[0] or 0
    while True:
        level = staged(nodes.select("row", "pos", *ends).repartition("row", F.floor(F.col("pos") / fan)).sortWithinPartitions("row", "pos")
                       .mapInArrow(_composed(fan), _NODE_DDL), "align-tree")
        groups.append(level.where("group").select("row", F.col("at").alias("pos"), "pa", "pb"))
        nodes, most = level.where("not group"), most // fan
        if not most:
            break
    # What is still open before a text's first common end is its first group.
    groups.append(nodes.where("size(pa) + size(pb) > 0").select("row", F.col("at").alias("pos"), "pa", "pb"))
    joined = groups[0]
    for g in groups[1:]:
        joined = joined.unionByName(g)
    made = staged(joined.mapInArrow(_groups(size_b), _GROUP_DDL), "align-groups")
    stats = ["n_a", "n_b", "n_groups", "n_links", "said"]
    at = placed.select("row", "unit", "chunk", "pos")
    parts = (leaves.join(at, ["row", "unit", "chunk"]).select("row", "pos", F.lit(1).alias("part"), "doc_id", "ok", *stats)
             .unionByName(made.select("row", "pos", F.lit(0).alias("part"), F.lit(None).cast("long").alias("doc_id"), F.lit(True).alias("ok"), *stats)))
    result = staged(parts.repartition("row").sortWithinPartitions("row", "pos", "part").mapInArrow(_digests, _LONG_DDL), "align-long")
    pairs = _exploded(leaves).unionByName(_exploded(made)).join(result.where("n_a > 0").select("row"), "row", "left_semi")
    return result, pairs.groupBy("row", "pair").agg(F.sum("times").alias("times"))


def _exploded(df: DataFrame) -> DataFrame:
    return df.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), "p.times")


def pair_counts(pairs: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): documents that hold the pair, and whether n is the highest of its first id."""
    counts = staged(pairs.groupBy("pair").agg(F.count("*").alias("n")), "align-counts")
    a = F.floor(F.col("pair") / size_b).alias("a")
    top = counts.groupBy(a).agg(F.max("n").alias("top"))  # a row per id of the vocabulary at most
    return counts.withColumn("a", a).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(df: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", *, hot: int = HOT, long: int = LONG,
          unit: int = UNIT, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_path``: byte-level BPE of the tokenizers library; ``b_path``: BPE of the sentencepiece library.
    Both files are read on the driver and broadcast (a few MB, whatever the data).
    """
    spark = df.sparkSession
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        files = f.read(), g.read()
    size_b = vocabularies(*files).size_b
    model = spark.sparkContext.broadcast(files)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = staged(docs.where(size <= long).mapInArrow(_short(model), _SHORT_DDL).withColumn("row", F.monotonically_increasing_id()), "align-short")
    stats = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows, pairs = short.select(*stats), _exploded(short)
    long_docs = docs.where(size > long)
    if not long_docs.select("doc_id").isEmpty():
        long_rows, long_pairs = _long(long_docs, model, size_b, unit, chunk, fan)
        rows, pairs = rows.unionByName(long_rows), pairs.unionByName(staged(long_pairs, "align-long-pairs"))
    counts = staged(pair_counts(pairs, size_b), "align-best")
    frequent = staged(counts.orderBy(F.desc("n"), "pair").limit(hot), "align-hot")
    sums = [F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best")]
    found = pairs.join(F.broadcast(frequent), "pair").groupBy("row").agg(*sums)
    if counts.count() > hot:
        rest = counts.join(frequent.select("pair"), "pair", "left_anti")
        seldom = pairs.join(F.broadcast(frequent.select("pair")), "pair", "left_anti")
        found = (found.unionByName(seldom.join(rest.hint("merge"), "pair").groupBy("row").agg(*sums))
                 .groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best")))
    whole = rows.join(found.hint("merge"), "row", "left")
    zero = F.lit(0).cast("long")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
