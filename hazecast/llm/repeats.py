"""Repeated byte windows of a whole corpus by a depth-limited radix sort.

Every window of ``depth`` bytes (a suffix, read through ``depth`` bytes only) belongs to the group
of windows equal to it; all but a group's first one, by (id, start), cover bytes that are removed.
The groups are found by digits, the most significant first, and what is alone leaves at once:

1. The first digit of a window is its anchor: the hash of the ``GRAM`` bytes in it that hash lowest
   (leftmost of equals), so equal windows have it at the same place.  Consecutive windows with one
   anchor are one row, about one per 40 bytes; rows, not windows, are shuffled by that digit.
2. The second digit is the hash of all bytes that a row's windows cover.  Of rows equal in both, all
   windows of all but the first are repeats.  Rows alone under their first digit hold no repeat.
   A task drops what it can settle itself before the shuffle, so a passage in a third of all
   documents is a row per batch of documents.
3. First rows that share an anchor but not all their bytes fetch these, and their windows are radix
   sorted within the group of their anchor: passes over 8 bytes each down to ``depth``, each pass
   splitting the groups and leaving out those of one window.  Groups equal to the end are exactly
   the repeated windows.  An anchor with more than ``HOT`` such rows isn't sorted in one task: its
   windows are dealt out by their 128-bit hash instead.

Hashes stand for bytes in step 2: 64 bits of an anchor with 64 bits of the row.

Defined cases: null and empty texts, and those shorter than ``depth`` bytes, lose nothing; windows
never cross documents; rows without an id (or with the largest long as id) come after all others; rows of one id are ordered by their
text's hash; of rows equal in id and text the first stays as it is and others count as later ones; very
long texts are read in blocks of ``BLOCK`` windows; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_bytes

DEPTH, GRAM = 100, 24
#: windows of a text that are read at once; their places take PLACE bits
BLOCK, PLACE = 1 << 20, 21
#: bytes of texts settled at once in a task, and of rows sorted at once
SLICE, SORTED = 32 << 20, 8 << 20
#: rows of one anchor that are sorted in one task
HOT = 1 << 16
LAST = (1 << 63) - 1
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all substrings of ``size`` bytes; those of length 2 k from those of length k."""
    def joined(a, b):
        x = a * _ODD[1] + (b ^ (b >> np.uint64(29))) * _ODD[2]
        return x ^ (x >> np.uint64(32))

    power, length, whole, done = raw.astype(np.uint64) * _ODD[0], 1, None, 0
    while True:
        if size & length:
            n = len(raw) - done - length + 1
            whole = power if whole is None else joined(whole[:n], power[done:done + n])
            done += length
        if done == size:
            return whole
        power = joined(power[:-length], power[length:])
        length *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


def anchored(raw: bytes, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a text in blocks: first window, windows, anchor hash, and place of the anchor in the first."""
    data, gram = np.frombuffer(raw, np.uint8), min(GRAM, depth)
    low = np.uint64((1 << PLACE) - 1)
    for at in range(0, len(raw) - depth + 1, BLOCK):
        hashes = gram_hashes(data[at:at + BLOCK + depth - 1], gram)
        # The place in the low bits makes the leftmost of equal hashes the lowest.
        keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        place = (sliding_min(keys, depth - gram + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        yield at + first, np.diff(np.append(first, len(place))), hashes[place[first]].view(np.int64), place[first] - first


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by spans, in order."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return start[first], reach[np.append(first[1:], len(start)) - 1]


#: of an anchored row (kind 0): anchor, hash of its bytes, document, first window, windows, anchor's
#: place; of a span (kind 1) that is settled already: document, first byte, bytes
_ROW = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("u", pa.int64()), ("id", pa.int64()), ("th", pa.int64()),
                  ("x", pa.int64()), ("n", pa.int64()), ("off", pa.int32())])
_ROW_DDL = "kind int, h long, u long, id long, th long, x long, n long, off int"
_SPAN = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("x", pa.int64()), ("n", pa.int64())])
_SPAN_DDL = "id long, th long, x long, n long"


def _table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _settle(docs: list[tuple[int, int, bytes]], depth: int) -> pa.RecordBatch | None:
    """Rows of some texts; those that repeat a row before them become spans."""
    docs.sort(key=lambda d: d[:2])
    xs, ns, hs, offs, us, doc, ids, ths = [], [], [], [], [], [], [], []
    for doc_id, th, raw in docs:
        if ids and (ids[-1], ths[-1]) == (doc_id, th):
            continue  # one row of those equal in id and text speaks for all
        for x, n, h, off in anchored(raw, depth):
            xs.append(x), ns.append(n), hs.append(h), offs.append(off)
            doc.append(np.full(len(x), len(ids), np.int64))
            us.append(np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(x.tolist(), (x + n + (depth - 1)).tolist())],
                               np.uint64).view(np.int64))
        ids.append(doc_id), ths.append(th)
    if not xs:
        return None
    x, n, h, off, u, doc = (np.concatenate(c) for c in (xs, ns, hs, offs, us, doc))
    ids, ths = np.array(ids, np.int64), np.array(ths, np.int64)
    order = np.lexsort((u, h))  # stable: rows lie in the order of documents and starts
    hu, uu = h[order], u[order]
    first = np.append(True, (hu[1:] != hu[:-1]) | (uu[1:] != uu[:-1]))
    keep, again = np.sort(order[first]), np.sort(order[~first])
    sdoc, sx, sn = [], [], []
    cut = np.flatnonzero(np.append(True, doc[again][1:] != doc[again][:-1])) if len(again) else []
    for a, b in zip(cut, np.append(cut[1:], len(again)) if len(again) else []):
        start, end = merged(x[again[a:b]], x[again[a:b]] + n[again[a:b]] + (depth - 1))
        sdoc.append(np.full(len(start), doc[again[a]])), sx.append(start), sn.append(end - start)
    m = sum(map(len, sx))
    sdoc = np.concatenate([*sdoc, np.zeros(0, np.int64)])
    rest = np.zeros(m, np.int64)
    return _table(_ROW, np.repeat(np.array([0, 1], np.int32), [len(keep), m]), np.concatenate([h[keep], ths[sdoc]]),
                  np.concatenate([u[keep], rest]), ids[np.concatenate([doc[keep], sdoc])], ths[np.concatenate([doc[keep], sdoc])],
                  np.concatenate([x[keep], *sx]), np.concatenate([n[keep], *sn]), np.concatenate([off[keep], rest]).astype(np.int32))


def _rows(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc_id, th, text in zip(*[batch.column(k) for k in range(3)]):
                raw = text_bytes(text.as_py())
                if len(raw) >= depth:
                    held.append((doc_id.as_py(), th.as_py(), raw))
                    size += len(raw)
                if size >= SLICE:
                    yield from filter(None, [_settle(held, depth)])
                    held, size = [], 0
        yield from filter(None, [_settle(held, depth)])
    return run


def _second_digit(depth: int):
    """Of rows sorted by (h, u, id, th, x): repeats as spans (kind 1), and first rows of anchors that
    have several (kind 0).  Holds one row besides the batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = pending = None  # the row before; the one first row of the anchor at hand
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
            ready = [c[cols[0] == 1] for c in cols]
            kind, h, u, ids, th, x, n, off = cols = [c[cols[0] == 0] for c in cols]
            if not len(h):
                if len(ready[0]):
                    yield _table(_ROW, *ready)
                continue

            def before(c, k):
                return np.concatenate([[0 if last is None else last[k]], c[:-1]])

            new_h = h != before(h, 1)
            new_h[0] |= last is None
            first = new_h | (u != before(u, 2))
            same = ~first & (ids == before(ids, 3)) & (th == before(th, 4)) & (x == before(x, 5))
            again = ~first & ~same
            group = np.cumsum(new_h)
            firsts = np.bincount(group[first], minlength=group[-1] + 1)
            # Group 0 goes on from the batch before: one first row is pending, or there were several.
            goes_on = not new_h[0]
            if goes_on:
                firsts[0] += 1 if pending is not None else 2
            several = first & (firsts[group] > 1)
            out = [c[several] for c in cols]
            if pending is not None and goes_on and firsts[0] > 1:
                out = [np.append(c, p) for c, p in zip(out, pending)]
            if group[-1] or firsts[0] > 1:
                pending = None
            if firsts[-1] == 1 and (group[-1] or not goes_on):
                at = np.flatnonzero(first)[-1]
                pending = [c[at] for c in cols]
            last = [c[-1] for c in cols]
            spans = [c[again] for c in cols]
            spans[0], spans[6] = np.ones(len(spans[0]), np.int32), spans[6] + (depth - 1)
            yield _table(_ROW, *[np.concatenate(c) for c in zip(ready, spans, out)])
    return run


def repeated_windows(h: np.ndarray, off: np.ndarray, n: np.ndarray, texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, window in the row) of windows that equal one before them.  Rows come in the order of
    documents and starts; a row's text is that of its ``n`` windows."""
    buffer = b"".join(texts) + bytes(8)
    words = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    size = np.array([len(t) for t in texts])
    place = (np.cumsum(size) - size)[row] + at
    group = np.unique(h, return_inverse=True)[1][row] * (depth + 1) + (off[row] - at)
    live = np.arange(len(row))
    step = min(8, depth)
    mask = np.uint64((1 << 64) - (1 << (64 - 8 * step)))
    for d in [*range(0, depth - step, step), depth - step]:
        digit = words[place[live] + d].astype(np.uint64) & mask
        order = np.lexsort((digit, group))  # stable
        live, group, digit = live[order], group[order], digit[order]
        new = np.append(True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1]))[:len(live)]
        group = np.cumsum(new)
        many = (np.bincount(group) > 1)[group]
        live, group = live[many], group[many]
    again = np.sort(live[np.append(False, group[1:] == group[:-1])[:len(live)]])
    return row[again], at[again]


def _third_digits(depth: int):
    """Spans of repeated windows of rows (h, id, th, x, n, off, bytes) sorted by (h, id, th, x)."""
    def sort(rows: list[tuple]) -> pa.RecordBatch:
        rows = [r for r, before in zip(rows, [None, *rows]) if before is None or r[:4] != before[:4]]
        rows.sort(key=lambda r: r[1:4])
        h, ids, th, x, n, off = (np.array(c, np.int64) for c in list(zip(*rows))[:6])
        row, at = repeated_windows(h, off, n, [r[6] for r in rows], depth)
        lead = np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1))[:len(row)]
        start = np.flatnonzero(lead)
        size = np.diff(np.append(start, len(row))) + (depth - 1)
        row = row[start]
        return _table(_SPAN, ids[row], th[row], x[row] + at[start], size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= SORTED and r[0] != held[-1][0]:
                    yield sort(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
        if held:
            yield sort(held)
    return run


def _fetch(depth: int):
    """Bytes of the rows asked of each document."""
    schema = pa.schema([("h", pa.int64()), *[(f.name, f.type) for f in _SPAN], ("off", pa.int32()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, th, text, rows in zip(*[batch.column(k) for k in range(4)]):
                raw, rows = text_bytes(text.as_py()), rows.as_py()
                yield _table(schema, [r["h"] for r in rows], [doc_id.as_py()] * len(rows), [th.as_py()] * len(rows),
                             [r["x"] for r in rows], [r["n"] for r in rows], [r["off"] for r in rows],
                             [raw[r["x"]:r["x"] + r["n"] + depth - 1] for r in rows])
    return run


def _windows(depth: int):
    """Each window of rows with its 128-bit hash."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("x", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, doc_id, th, x, n, _, raw in zip(*[c.to_pylist() for c in batch.columns]):
                digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[i:i + depth]) for i in range(n)]), np.int64).reshape(-1, 2)
                yield _table(schema, digest[:, 0], digest[:, 1], np.full(n, doc_id), np.full(n, th), x + np.arange(n))
    return run


def _keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, th, text): id without nulls, and a hash that tells rows of one id apart."""
    own = F.col(doc_id).cast("long")
    return df.select(F.coalesce(own, F.lit(LAST)).alias("id"), F.xxhash64(F.col(text), own.isNull()).alias("th"), F.col(text).alias("text"))


def repeated_spans(df: DataFrame, depth: int = DEPTH, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Spans (id, th, x, n) of bytes of the documents of ``_keyed`` that some repeated window covers; they may overlap."""
    docs = _keyed(df, doc_id, text)
    order = ["h", "u", "id", "th", "x"]
    found = staged(docs.mapInArrow(_rows(depth), _ROW_DDL).repartition("h").sortWithinPartitions(*order)
                   .mapInArrow(_second_digit(depth), _ROW_DDL), "repeats")
    spans = found.where("kind = 1").select("id", "th", "x", "n")
    open_rows = found.where("kind = 0")
    asked = open_rows.groupBy("id", "th").agg(F.collect_list(F.struct("h", "x", "n", "off")).alias("rows"))
    fetched = (docs.join(asked.hint("merge"), ["id", "th"]).select("id", "th", "text", "rows")
               .mapInArrow(_fetch(depth), f"h long, {_SPAN_DDL}, off int, raw binary"))
    often = staged(open_rows.groupBy("h").count().where(F.col("count") > hot).select("h"), "repeats-often")
    if not often.isEmpty():
        fetched = staged(fetched, "repeats-bytes")
        each = fetched.join(often, "h", "left_semi").mapInArrow(_windows(depth), "a long, b long, id long, th long, x long").distinct()
        ref = F.struct("id", "th", "x")
        first = each.groupBy("a", "b").agg(F.min(ref).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
        spans = spans.unionByName(each.join(first.hint("merge"), ["a", "b"]).where(ref != F.col("first"))
                                  .select("id", "th", "x", F.lit(depth).cast("long").alias("n")))
        fetched = fetched.join(often, "h", "left_anti")
    inner = fetched.repartition("h").sortWithinPartitions("h", "id", "th", "x").mapInArrow(_third_digits(depth), _SPAN_DDL)
    return spans.unionByName(inner)


_KEPT = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n_bytes", pa.int64()),
                   ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _cut(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for doc_id, th, text, spans, copy in zip(*[batch.column(k) for k in range(5)]):
                raw = text_bytes(text.as_py())
                if copy.as_py() > 1 and len(raw) >= depth:
                    start, end = np.zeros(1, np.int64), np.array([len(raw)])
                elif spans.is_valid:
                    s = spans.values
                    x = s.field("x").to_numpy()
                    start, end = merged(x, x + s.field("n").to_numpy())
                else:
                    start = end = np.zeros(0, np.int64)
                a, b = start.tolist(), end.tolist()
                kept = b"".join([raw[i:j] for i, j in zip([0, *b], [*a, len(raw)])])
                out.append((doc_id.as_py(), th.as_py(), len(raw), [{"start": i, "end": j} for i, j in zip(a, b)], kept))
                size += len(kept)
                if size > SLICE // 4:
                    yield _table(_KEPT, *zip(*out))
                    out, size = [], 0
            if out:
                yield _table(_KEPT, *zip(*out))
    return run


def remove_repeats(df: DataFrame, depth: int = DEPTH, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """A row per document: doc_id, n_bytes, removed (maximal spans, as array of start and end) and the
    bytes kept, where every byte in a ``depth``-byte string that also starts earlier is removed."""
    spans = (repeated_spans(df, depth, doc_id, text, hot).groupBy("id", "th").agg(F.collect_list(F.struct("x", "n")).alias("spans")))
    joined = _keyed(df, doc_id, text).join(spans.hint("merge"), ["id", "th"], "left")
    copy = F.row_number().over(Window.partitionBy("id", "th").orderBy(F.lit(0)))
    got = (joined.withColumn("copy", copy).select("id", "th", "text", "spans", "copy")
           .mapInArrow(_cut(depth), "id long, th long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"))
    return got.select(F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), "n_bytes", "removed", "kept")
