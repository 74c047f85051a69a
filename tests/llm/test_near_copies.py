import itertools
import random

import numpy as np
import pytest
import xxhash

from hazecast.llm import components as comp
from hazecast.llm import fingerprints, simhash_grid


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    links += links[:5] + [(3, 3)]
    rng.shuffle(links)
    got = {r.node: r.component for r in comp.components(spark.createDataFrame([*links, (None, 4)], "a long, b long"), "a", "b").collect()}
    links = [l for l in links if l[0] != l[1]]
    want = union_find({n for l in links for n in l}, links)
    assert got == want


def test_components_of_no_edges(spark):
    assert comp.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    words = lowered.split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    return sum(1 << b for b in range(64) if sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) * 2 > len(shingles))


def test_fingerprint_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(400))
    monkeypatch.setattr(simhash_grid, "CHUNK", 64)
    assert simhash_grid.fingerprint(text) == plain_fingerprint(text)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps |= {x} | {x ^ (1 << rng.randint(0, 63)) ^ (1 << rng.randint(0, 63)) ^ (rng.random() < 0.3) * (1 << rng.randint(0, 63)) for _ in range(8)}
    fps |= {0, 1, 3, 7, (1 << 64) - 1, (1 << 64) - 2}
    fps |= {1 << i for i in range(64)}  # a dense group
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    pairs = simhash_grid.linked_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {tuple(sorted(r)) for r in pairs.select("a", "b").collect()}
    want = {tuple(sorted((a, b))) for (a, x), (b, y) in itertools.combinations(zip(signed, fps), 2) if (x ^ y).bit_count() <= 2}
    assert got == want


def expected(rows):
    fp = [plain_fingerprint(t) for _, t, *_ in rows]
    nodes = range(len(rows))
    group = union_find(nodes, [(i, j) for i, j in itertools.combinations(nodes, 2) if (fp[i] ^ fp[j]).bit_count() <= 2])
    least = {}
    for n, (i, *_) in enumerate(rows):
        if i is not None:
            least[group[n]] = min(least.get(group[n], i), i)
    return [(i, f"{fp[n]:016x}", least.get(group[n])) for n, (i, *_) in enumerate(rows)]


def test_components_of_odd_rows(odd_docs, odd_rows):
    key = lambda r: tuple((x is None, x) for x in r)
    got = [tuple(r) for r in simhash_grid.simhash_components(odd_docs).collect()]
    assert sorted(got, key=key) == sorted(expected(odd_rows), key=key)


def test_one_of_each_group_stays(odd_docs, odd_rows):
    got = simhash_grid.drop_near_copies(odd_docs)
    assert got.columns == odd_docs.columns
    want = expected(odd_rows)
    # One survivor a component: its smallest id; a row without an id only where no member has one.
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i, _, c in want if i is not None and i == c})
    assert ids.count(None) == len({fp for _, fp, c in want if c is None})


def test_a_row_without_an_id_goes_where_a_named_copy_stays(spark):
    df = spark.createDataFrame([(None, "one text of several words"), (1, "one text of several words"), (None, "other words entirely, and more"),
                                (None, "other words entirely, and more")], "doc_id long, text string")
    got = simhash_grid.drop_near_copies(df).collect()
    assert sorted(((r.doc_id is None, r.doc_id, r.text) for r in got), key=str) == [(False, 1, "one text of several words"), (True, None, "other words entirely, and more")]


def test_no_documents(no_docs):
    assert simhash_grid.simhash_components(no_docs).count() == 0
    assert simhash_grid.drop_near_copies(no_docs).count() == 0
    assert fingerprints.fingerprint_table(no_docs).count() == 0


def test_fingerprints_along_the_table(spark, odd_docs, odd_rows):
    import hashlib
    got = [r.asDict() for r in fingerprints.fingerprint_table(odd_docs).collect()]
    assert len(got) == len(odd_rows)
    hashes = {(r.doc_id, r.text): r.h for r in odd_docs.selectExpr("doc_id", "text", "xxhash64(text) as h").collect()}
    rows = sorted(((i, t) for i, t, *_ in odd_rows), key=lambda r: (r[0] is None, r[0], hashes[r]))
    fps = [fingerprints.fingerprint(t) for _, t in rows]
    want = []
    for n, (i, t) in enumerate(rows):
        t, m = t or "", (n + 1) % len(rows)
        following = rows[m][1] or ""
        half = len(t) // 2
        changed = t[:len(t) - half] + following[:half]
        other = fingerprints.fingerprint(changed)
        far = lambda x: 1 - (int.from_bytes(fps[n]) ^ int.from_bytes(x)).bit_count() / 128
        near = sum((int.from_bytes(fps[n]) ^ int.from_bytes(f)).bit_count() <= 3 for f in fps) - 1
        want.append({"doc_id": i, "n_chars": len(t), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(), "fingerprint": fps[n].hex(),
                     "edited_fingerprint": other.hex(), "near_edited": far(other), "near_next": far(fps[m]), "n_near": near})
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["fingerprint"], r["edited_sha256"])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_a_single_row_follows_itself(spark):
    row = fingerprints.fingerprint_table(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert (row.near_next, row.n_near) == (1.0, 0)


def test_block_tables_equal_brute_force(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(128)
        fps.add(x)
        for k in range(1, 6):
            y = x
            for b in rng.sample(range(128), k):
                y ^= 1 << b
            fps.add(y)
    text = {f: f"{f:032x}" for f in fps}
    pairs = fingerprints.near_fingerprints(spark.createDataFrame([(t,) for t in text.values()], "fp string"), 3)
    got = [tuple(r) for r in pairs.collect()]
    want = [(*sorted((text[a], text[b])), (a ^ b).bit_count()) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3]
    assert sorted(got) == sorted(want)


def test_edited_texts_are_nearer_than_other_texts():
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(200)) for _ in range(30)]
    for a, b in zip(texts, texts[1:]):
        fa, fb, fe = map(fingerprints.fingerprint, (a, b, fingerprints.edited(a, b)))
        assert fingerprints.likeness(fa, fe) > fingerprints.likeness(fa, fb)
