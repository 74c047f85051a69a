import importlib.util
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from hazecast.llm import gru_lm, queries, simhash_grid, toxicity
from hazecast.llm.common import words_of

assert importlib.util.find_spec("hazecast.llm")
BAD = ["nastyword", "uglyterm", "vileness"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    lang = {k: [f"{k}{rng.randint(0, 99)}{s}" for s in ("on", "ed", "a", "er", "th") for _ in range(30)] for k in ("b", "qu", "z")}
    rows, labels = [], []
    for i in range(900):
        k = rng.choice(sorted(lang))
        words = rng.choices(lang[k], k=rng.randint(20, 120))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words), k, f"s{i % 4}", len(words)))
        if i % 2 == 0 or toxic and i % 4:
            labels.append((i, 1, int(toxic)))
    return rows, labels


DOCS, LABELS = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus[0], DOCS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(corpus[1], LABELS).write.parquet(f"{path}/labels.parquet")
    return path


def test_held_out_accuracy(spark, tables, corpus):
    got = {r.doc_id: r for r in queries.ENTRIES["op8_toxicity"].build(spark, tables).collect()}
    assert len(got) == 900 and all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r.predicted, int(i % 6 == 0)) for i, r in got.items() if r.held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97


def test_ngrams_equal_a_plain_set():
    mark = np.zeros(toxicity.BUCKETS, np.int32)

    def bucket(s):
        h = 0
        for k, c in enumerate(s):
            h = ord(c) if k == 0 else (h * 0x01000193 + ord(c)) % 2**32
        return ((h + len(s)) % 2**32 * 2654435761 % 2**32) >> (32 - toxicity.BITS)
    for text in ("Hi", "a", "Ünïcode \U0001f600 text", "aaaaaa"):
        t = f" {text.lower()} "
        want = {bucket(t[i:i + n]) for n in toxicity.ORDERS for i in range(len(t) - n + 1)}
        got = toxicity.distinct_ngrams(text, mark).tolist()
        assert len(got) == len(set(got)) and set(got) == want
    assert not len(toxicity.distinct_ngrams(None, mark)) and not len(toxicity.distinct_ngrams("", mark))


def test_ngrams_of_long_texts_in_chunks(monkeypatch):
    rng = random.Random(0)
    text = "".join(rng.choices("abcdef ", k=5000))
    mark = np.zeros(toxicity.BUCKETS, np.int32)
    want = set(toxicity.distinct_ngrams(text, mark).tolist())
    monkeypatch.setattr(toxicity, "CHUNK", 100)
    got = toxicity.distinct_ngrams(text, mark).tolist()
    assert len(got) == len(set(got)) and set(got) == want


def test_toxicity_on_odd_rows(spark, odd_docs, no_docs, tables):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, 0), (3, 0, None), (None, 1, 1), (7, 1, 0), (999, 1, 1)], LABELS)
    got = toxicity.held_out_scores(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(r.score is not None for r in got)
    assert len({r.score for r in got if r.doc_id in (100, 101)}) == 1
    none = spark.createDataFrame([], LABELS)
    assert {r.predicted for r in toxicity.held_out_scores(odd_docs, none).collect()} == {0}
    assert toxicity.held_out_scores(no_docs, labels).count() == 0
    kept = toxicity.drop_toxic(odd_docs, none)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def crc(i):
    return zlib.crc32(str(i).encode()) % 7


def test_scores_beat_the_base_on_held_out_texts(spark, tables, corpus):
    got = {r.doc_id: r for r in queries.ENTRIES["op5_gru_scoring"].build(spark, tables).collect()}
    counts = Counter()
    for i, text, *_ in corpus[0]:
        if crc(i) != 2:
            counts.update([*words_of(text), b"\n"])
    total, distinct = sum(counts.values()), len(counts)
    for i, text, *_ in corpus[0]:
        words, r = [*words_of(text), b"\n"], got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (crc(i) == 2, len(words), total)
        assert r.n_known == sum(w in counts for w in words)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_words_beyond_the_broadcast_table(spark, tables, monkeypatch):
    cols = ("doc_id", "n_known", "base_score", "score")
    want = {r.doc_id: r for r in gru_lm.score_documents(spark.read.parquet(f"{tables}/documents.parquet")).select(*cols).collect()}
    monkeypatch.setattr(gru_lm, "HEAD", 100)
    got = {r.doc_id: r for r in gru_lm.score_documents(spark.read.parquet(f"{tables}/documents.parquet")).select(*cols).collect()}
    for i, r in got.items():
        assert r.n_known == want[i].n_known and r.base_score == pytest.approx(want[i].base_score)


def test_gradient(monkeypatch):
    rng = np.random.default_rng(0)
    flat = np.concatenate([rng.normal(0, 0.3, math.prod(s)) for s in gru_lm.SHAPES.values()])
    docs = [rng.integers(0, gru_lm.SYMBOLS, n).astype(np.int32) for n in (3, 17, 1, 9, 30, 12)]
    monkeypatch.setattr(gru_lm, "CLIP", 1e9)
    monkeypatch.setattr(gru_lm, "WINDOW", 64)
    moved = flat.copy()
    gru_lm.Network(moved).train(docs, np.full(len(flat), 1e12), lanes=3)
    g = (flat - moved) * 1e6 / gru_lm.RATE * 3
    loss = lambda f: -gru_lm.Network(f).log_likelihoods(docs).sum()
    at = 0
    for name, shape in gru_lm.SHAPES.items():
        n = math.prod(shape)
        for i in at + np.argsort(-np.abs(g[at:at + n]))[:3]:
            a, b = flat.copy(), flat.copy()
            a[i] += 1e-4
            b[i] -= 1e-4
            assert g[i] == pytest.approx((loss(a) - loss(b)) / 2e-4, rel=1e-2, abs=1e-3), name
        at += n


def test_state_is_carried_and_probabilities_add_up(monkeypatch):
    rng = np.random.default_rng(1)
    flat = np.concatenate([rng.normal(0, 0.3, math.prod(s)) for s in gru_lm.SHAPES.values()]).astype(np.float32)
    net = gru_lm.Network(flat)
    docs = [rng.integers(0, gru_lm.SYMBOLS, n).astype(np.int32) for n in (200, 3, 77, 1)]
    whole = net.log_likelihoods(docs)
    monkeypatch.setattr(gru_lm, "WINDOW", 5)
    assert net.log_likelihoods(docs) == pytest.approx(whole, rel=1e-4)
    assert [net.log_likelihoods([d])[0] for d in docs] == pytest.approx(whole.tolist(), rel=1e-4)
    hidden = rng.normal(size=(1, gru_lm.STATE)).astype(np.float32).repeat(gru_lm.SYMBOLS, axis=0)
    score, _ = net.outputs(hidden, np.arange(gru_lm.SYMBOLS), None)
    assert np.exp(score.astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_scores_of_odd_rows(odd_docs, no_docs):
    got = gru_lm.score_documents(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (100, 101, 102)} == {1}
    assert gru_lm.score_documents(no_docs).count() == 0


def test_nothing_to_train_on(spark):
    i = next(i for i in range(1000) if crc(i) == 2)
    row = gru_lm.score_documents(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0) and math.isfinite(row.score)


def test_pipeline_equals_brute_force(spark, tables, corpus):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, tables).collect()
    model = toxicity.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    mark = np.zeros(toxicity.BUCKETS, np.int32)
    assert sorted(r.doc_id for r in clean) == [i for i, t, *_ in corpus[0] if model.score(t, mark) < 0.5]
    assert sum(i % 6 == 0 for i in (r.doc_id for r in clean)) <= 5 and len(clean) >= 745
    copies = docs.where("doc_id < 40").selectExpr("doc_id + 5000 as doc_id", "text", "lang", "source", "n_chars")
    single = corpus_pipeline.drop_near_copies(spark, docs.unionByName(copies), tables)
    ids = {r.doc_id for r in single.collect()}
    fps = {i: simhash_grid.fingerprint(t) for i, t, *_ in corpus[0]}
    assert not any(i >= 5000 for i in ids)
    assert all(i in ids or any(j < i and (fps[i] ^ fps[j]).bit_count() <= 2 for j in fps) for i in fps)
    mixed = corpus_pipeline.mix(spark, docs, tables)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) == set(range(900)) and max(times.values()) <= 2
    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    n = {i: len(sp.encode(t)) for i, t, *_ in corpus[0]}
    result = corpus_pipeline.run(spark, tables).collect()
    assert result and all(r.n_tokens == n[r.doc_id] for r in result)


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "mix_sources", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None
