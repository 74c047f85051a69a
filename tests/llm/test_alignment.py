import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from hazecast.llm import alignment
from hazecast.llm.queries import ENTRIES
from hazecast.llm.token_counts import byte_alphabet

A, B = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def groups_of(libraries, text):
    """Groups (a ids, b ids) of a whole text, token by token; None without tokens."""
    a, b = libraries
    byte = {c: x for x, c in byte_alphabet().items()}
    ia = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
    ib = b.encode(text) if text else []
    ba = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
    bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    raw = (" " + text).encode() if text else b""
    if not text or b"".join(ba) != raw or b"".join(bb) != raw:
        return None
    out, x, y, ga, gb, na, nb = [], 0, 0, [], [], 0, 0
    while x < len(ia) or y < len(ib):
        if na <= nb and x < len(ia):
            ga.append(ia[x])
            na += len(ba[x])
            x += 1
        else:
            gb.append(ib[y])
            nb += len(bb[y])
            y += 1
        if na == nb:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def brute(libraries, rows):
    found = [groups_of(libraries, t) for _, t in rows]
    pairs = [Counter((x, y) for ga, gb in g or [] for x in ga for y in gb) for g in found]
    count = Counter(p for c in pairs for p in c)
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for (doc_id, _), g, c in zip(rows, found, pairs):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        out.append((doc_id, sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), sum(c.values()),
                    sum(m for p, m in c.items() if count[p] == top[p[0]]), sum(m * count[p] for p, m in c.items()),
                    hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted([tuple(r[c] for c in COLUMNS) for r in df.collect()], key=repr)


def texts():
    rng = random.Random(4)
    words = ["the", "Token", "izers", "naïve", "日本語", "x" * 40, "don't", "3.14", "\n\n", "a  b", " \n c", "\t", "é", "🙂🙂", "ﬁn", "　", "."]
    out = [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(40)]
    out += ["".join(rng.choices("日本語éab🙂", k=600)), "🙂" * 200, "abc" * 400, " ", "  ", "\n", " a", "a ", "a▁b", "<s> <|endoftext|> <unk>", "", None,
            "\u0000\u0001", "x y z", "q" * 5_000 + " tail " * 200]
    return out + out[:5]


@pytest.mark.parametrize("sizes", [{}, {"long": 0, "unit": 40, "chunk": 16, "fan": 2, "hot": 3}, {"long": 100, "unit": 1, "chunk": 7, "fan": 3, "hot": 0},
                                   {"long": 50, "unit": 100_000, "chunk": 5, "fan": 5}])
def test_equals_brute_force(spark, libraries, sizes):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(alignment.align(df, A, B, **sizes)) == brute(libraries, rows)


def test_units_join_to_the_text():
    for t in texts():
        for size in (1, 10, 1000):
            assert " ".join(alignment.units(t or "", size)) == (t or "")


def test_composition_is_associative():
    rng = random.Random(1)
    for _ in range(200):
        parts = []
        for k in range(6):
            cut = rng.random() < 0.5
            ids = lambda: [rng.randint(0, 9) for _ in range(rng.randint(0, 2))]
            parts.append((cut, k, ids(), ids(), ids() if cut else [], ids() if cut else []))

        def fold(lo, hi):
            if hi - lo == 1:
                return parts[lo], []
            mid = rng.randint(lo + 1, hi - 1)
            (x, gx), (y, gy) = fold(lo, mid), fold(mid, hi)
            z, g = alignment.compose(x, y)
            return z, sorted([*gx, *gy, *([g] if g else [])])

        results = []
        for _ in range(4):
            z, g = fold(0, 6)
            results.append((z[0], z[1] if z[0] else None, z[2:], g))
        assert all(r == results[0] for r in results)


def test_memory_forgets_and_learns_again(libraries, monkeypatch):
    with open(A) as f, open(B, "rb") as g:
        voc = alignment.vocabularies(f.read(), g.read())
    some = [t for t in texts() if t]
    want = alignment.Memory(voc).rows(some)
    monkeypatch.setattr(alignment, "KEPT", 10)
    memory = alignment.Memory(voc)
    for _ in range(3):
        got = [memory.rows([t])[0] for t in some]
        assert [(*x[:5], x[5].tolist(), x[6].tolist()) for x in got] == [(*x[:5], x[5].tolist(), x[6].tolist()) for x in want]
        assert len(memory.number) < 120


def test_odd_rows_and_large_groups(spark, libraries, odd_docs, odd_rows):
    assert rows_of(alignment.align(odd_docs, A, B)) == brute(libraries, [r[:2] for r in odd_rows])


def test_pairs_of_large_groups(monkeypatch, libraries):
    with open(A) as f, open(B, "rb") as g:
        voc = alignment.vocabularies(f.read(), g.read())
    units = ["🙂" * 50 + "日本語" * 30, "abc def"]
    ids = [voc.encode(u) for u in units]
    a, b = (np.array([i for x in ids for i in x[k]]) for k in (0, 1))
    sizes = np.array([x[2] for x in ids])
    assert sizes.tolist() == [len(u.encode()) + 1 for u in units]
    one = alignment.Fragments(voc, a, b, sizes)
    monkeypatch.setattr(alignment, "LISTED", 0)
    two = alignment.Fragments(voc, a, b, sizes)
    for k in range(2):
        assert [x.tolist() for x in one.pairs_of(k)] == [x.tolist() for x in two.pairs_of(k)]


def test_empty_table_and_clashing_columns(spark, no_docs, libraries):
    assert alignment.align(no_docs, A, B).collect() == []
    df = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, n_a int, row string")
    assert rows_of(alignment.align(df, A, B)) == brute(libraries, [(1, "a b")])


def test_query_equals_brute_force(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(ENTRIES["op13_token_alignment"].build(spark, sf)) == brute(libraries, rows)
