import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from hazecast.llm import embeddings, gru_lm, simhash_grid, toxicity


def test_every_window_is_learnt_from(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "WARM_DOCS", 1)
    n = 24  # a lane each; a text's own word stands in its second window alone
    rows = [("a " * gru_lm.WINDOW + f"own{i} " * 20,) for i in range(n)]
    train = spark.createDataFrame(rows, "text string").selectExpr("1L as doc_id", "false as held_out", "text").coalesce(1).cache()
    vocab = gru_lm.vocabulary(gru_lm.count_words(train).cache())
    flat = gru_lm.train_network(train, vocab, n)
    moved = gru_lm.unpack(flat)["x"] - gru_lm.unpack(gru_lm.initial(vocab))["x"]
    assert all(np.abs(moved[vocab.index[b"own%d" % i]]).max() > 0 for i in range(n))


@pytest.mark.parametrize("rank", [2, 4])
def test_every_pair_of_low_rank_vectors_is_linked_once(spark, rank):
    rng = np.random.default_rng(rank)
    x = rng.normal(size=(1500, rank)) @ rng.normal(size=(rank, 64)) + rng.normal(size=(1500, 64)) * 0.02
    got = embeddings.link_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    u = embeddings.unit(x)
    want = ((u @ u.T) >= 0.95).sum(axis=1) - 1
    assert {r.vec_id: r.n_links for r in got.collect()} == dict(enumerate(want.tolist()))


def test_the_pipeline_returns_the_encoded_ids(spark):
    texts = ["a text of words", "", None, "日本 \U0001f600"]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    got = {r.doc_id: r.ids for r in corpus_pipeline.encode(spark, docs, "").collect()}
    assert got == {i: sp.encode(t or "") for i, t in enumerate(texts)}


def test_near_copies_go_by_row(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, d), (None, "x y z"), (None, "x y z"), (None, None), (None, None)]
    got = simhash_grid.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got.columns == ["doc_id", "text"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, a), (2, b), (3, c), (3, d), (None, "x y z"), (None, None)], key=str)


def test_mild_ngrams_have_weight():
    label = np.repeat([1.0, 0.0], 300)
    features = [np.array([1] + [2] * (i % 10 < 6), np.int32) for i in range(300)] + [np.array([1] + [2] * (i % 10 < 3), np.int32) for i in range(300)]
    features += [np.empty(0, np.int32)]
    got = toxicity.fit(features, np.append(label, 0.0), np.ones(601))  # a ratio of 0.5 or so
    assert got.weight[2] > 0.5
    empty = toxicity.fit([np.empty(0, np.int32)] * 2, np.array([1.0, 0.0]), np.ones(2))
    assert not empty.weight.any()
