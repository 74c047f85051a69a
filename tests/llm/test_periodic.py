import hashlib
import random
import zlib

import numpy as np
import pytest

from hazecast.llm import periodic
from hazecast.llm.queries import ENTRIES


def brute(words):
    """Runs (start, length, period) by comparing all places with all periods."""
    n, out = len(words), {}
    w = np.unique(words, return_inverse=True)[1] if n else np.zeros(0)
    for q in range(1, n // 4 + 1):
        same = np.diff(np.concatenate([[0], (w[q:] == w[:-q]).view(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(same == 1).tolist(), np.flatnonzero(same == -1).tolist()):
            if b - a + q >= max(6, 4 * q):
                out.setdefault((a, b - a + q), q)  # the smallest period comes first
    return sorted((a, size, q) for (a, size), q in out.items())


def contract(doc_id, text):
    """Row of the query's contract, by brute force."""
    words = (text or "").encode().split()
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = set()
    for a, size, q in found:
        gone.update(range(a + q, a + size))
    best = (None,) * 4
    if found:
        a, size, q = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]))
        best = (a, size, q, 1000 * size // q)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *best, digest("".join(f"{a},{s},{q}\n" for a, s, q in found).encode()),
            digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def numbered(text):
    return np.unique(list(text), return_inverse=True)[1].astype(np.int64)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("seed", range(60))
def test_random_words(seed):
    rng = random.Random(seed)
    parts = []
    while sum(map(len, parts)) < rng.choice([3, 20, 150, 400]):
        unit = "".join(rng.choices("abc"[:rng.randint(1, 3)], k=rng.choice([1, 2, 3, 5, 9])))
        parts.append(rng.choice([unit * rng.randint(1, 8), unit, unit * 5 + unit[:2]]))
    text = "".join(parts)
    assert [tuple(r) for r in periodic.runs(numbered(text)).tolist()] == brute(list(text)), text


@pytest.mark.parametrize("text", ["", "a", "aaaaa", "aaaaaa", "a" * 3000, "ab" * 500 + "b" + "ab" * 500, fibonacci(2000), "abcabcabcab", "abcabcabcabc",
                                  "".join(chr(x) for x in range(300, 900)) * 5])
def test_special_words(text):
    assert [tuple(r) for r in periodic.runs(numbered(text)).tolist()] == brute(list(text))


def test_all_runs_without_cutting(monkeypatch):
    # Squares too: every run of a whole text, as in the theorem.
    monkeypatch.setattr(periodic, "MIN_LENGTH", 2)
    monkeypatch.setattr(periodic, "MIN_POWER", 2)
    rng = random.Random(5)
    for n in (2, 7, 40, 90):
        text = "".join(rng.choices("ab", k=n))
        want = set()
        for q in range(1, n // 2 + 1):
            for a in range(n):
                b = a
                while b + q < n and text[b] == text[b + q]:
                    b += 1
                if b - a >= q and (a == 0 or text[a - 1] != text[a - 1 + q]) and not any(w[:2] == (a, b + q - a) for w in want):
                    want.add((a, b + q - a, q))
        assert {tuple(r) for r in periodic.runs_within(numbered(text)).tolist()} == want


def test_extensions():
    rng = random.Random(2)
    text = "".join(rng.choices("ab", k=200))
    ext = periodic.Extensions(numbered(text))
    pairs = [(a, b) for a in range(0, 200, 7) for b in range(1, 201, 9) if a != b]
    got = ext.common(*(np.array(c) for c in zip(*pairs)))
    for (a, b), size in zip(pairs, got.tolist()):
        assert text[a:a + size] == text[b:b + size] and text[a + size:a + size + 1] != text[b + size:b + size + 1] or max(a, b) + size == 200
    assert np.argsort(ext.rank).tolist() == sorted(range(201), key=lambda i: text[i:])


def test_long_text():
    words = np.array([1, 2, 3, 4, 5] * 12_000 + [9], np.int64)
    assert periodic.runs(words).tolist() == [[0, 60_000, 5]]


def rows_of(df):
    cols = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return sorted([tuple(r[c] for c in cols) for r in df.collect()], key=repr)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_brute_force(spark, sf):
    sf = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(ENTRIES["op11_periodic_runs"].build(spark, sf)) == sorted([contract(*r) for r in docs], key=repr)


def test_odd_rows_and_lines(spark, odd_rows, tmp_path):
    rows = [(r[0], r[1], "c", 1) for r in odd_rows] + [(200 + i, "the same line\n" * i, None, None) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(ENTRIES["op11_periodic_runs"].build(spark, str(tmp_path)))
    assert got == sorted([contract(*r[:2]) for r in rows], key=repr)


def test_empty_table(spark, no_docs):
    got = periodic.find_runs(no_docs)
    assert got.collect() == [] and got.columns[-2:] == ["runs", "collapsed"]
