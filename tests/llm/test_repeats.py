import hashlib
import random

import numpy as np
import pytest

from hazecast.llm import repeats
from hazecast.llm.queries import ENTRIES


def brute(rows, depth):
    """(id, text) -> kept bytes and number of spans; rows in the operator's order."""
    seen, out = set(), []
    for _, raw in rows:
        gone = bytearray(len(raw))
        for i in range(len(raw) - depth + 1):
            w = raw[i:i + depth]
            if w in seen:
                gone[i:i + depth] = b"\1" * depth
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def digest(df):
    return [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest())
            for r in df.collect()]


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(400)] + ["é", "日本"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passage, line = text(60), text(9)
    docs = [text(rng.randint(1, 120)) for _ in range(60)]
    docs += [text(20) + passage + text(20) for _ in range(15)] + [docs[3], docs[3], docs[4] + "!", "x" + docs[5]]
    docs += [(line + "\n") * 30, line * 25, "a" * 700, "ab" * 300, "a" * 99, "a" * 100, "a" * 101, "", None, " "]
    docs += [docs[7][:len(docs[7]) // 2] + "#" + docs[7][len(docs[7]) // 2 + 1:] for _ in range(5)]
    return list(enumerate(docs))


@pytest.mark.parametrize("depth,hot,sliced", [(100, repeats.HOT, False), (100, 0, True), (24, repeats.HOT, True), (5, 2, False)])
def test_equals_brute_force(spark, monkeypatch, depth, hot, sliced):
    if sliced:  # many slices, blocks and sorts; workers get the closures with these values
        from pyspark import cloudpickle
        for name, value in (("SLICE", 2_000), ("SORTED", 500), ("BLOCK", 150)):
            monkeypatch.setattr(repeats, name, value)
        cloudpickle.register_pickle_by_value(repeats)
    rows = corpus()
    rng = random.Random(1)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    try:
        got = sorted(digest(repeats.remove_repeats(df, depth, hot=hot)))
    finally:
        if sliced:
            cloudpickle.unregister_pickle_by_value(repeats)
    rows.sort(key=lambda r: r[0])
    want = brute([(i, (t or "").encode()) for i, t in rows], depth)
    assert got == [(i, *w) for (i, _), w in zip(rows, want)]


def test_radix_sort_alone():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 99, 40).astype(np.uint8)) for _ in range(30)]
    n = np.full(30, 40 - 12 + 1)
    row, at = repeats.repeated_windows(np.zeros(30, np.int64), np.full(30, 12) + n - 1, n, texts, 12)
    seen, want = set(), []  # the anchor's place is part of the group
    for r, t in enumerate(texts):
        for i in range(29):
            if (i, t[i:i + 12]) in seen:
                want.append((r, i))
            seen.add((i, t[i:i + 12]))
    assert want and list(zip(row.tolist(), at.tolist())) == want
    one = np.ones(30, np.int64)
    row, at = repeats.repeated_windows(np.zeros(30, np.int64), np.zeros(30, np.int64), one, [t[:12] for t in texts[:15]] * 2, 12)
    assert row.tolist() == list(range(15, 30)) and not at.any()


def test_odd_rows(spark, odd_docs, odd_rows):
    got = digest(repeats.remove_repeats(odd_docs))
    assert len(got) == len(odd_rows)
    # The order of rows: ids, those without last; equal ids by text (here: equal rows).
    named = sorted([r for r in odd_rows if r[0] is not None], key=lambda r: r[0])
    want = brute([(r[0], (r[1] or "").encode()) for r in named], 100)
    # Of rows equal in id and text the spans are those of the first, or the whole text.
    whole = sorted((i, *w) for (i, *_), w in zip(named, want))
    assert sorted(g for g in got if g[0] is not None) == whole
    assert len([g for g in got if g[0] is None]) == 2


def test_empty_table_and_clashing_columns(spark, no_docs):
    assert repeats.remove_repeats(no_docs).collect() == []
    df = spark.createDataFrame([(1, "q" * 150, "a", 9), (2, "q" * 150, "b", 8)], "doc_id long, text string, kept string, h int")
    assert sorted(digest(repeats.remove_repeats(df)))[1][2] == 150


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in ENTRIES["op12_suffix_array_dedup"].build(spark, sf).collect())
    assert got == [(i, *w) for (i, _), w in zip(rows, brute(rows, 100))]
