"""Scores of the recurrent model against a plain pass token by token, and its memory on long texts."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hazecast.llm import gru_lm as G
from hazecast.llm.common import words_of


def plain_score(text, flat, vocab, counts):
    """log10 probability of a text, one token at a time, from the parameters and the corpus counts."""
    p = G.unpack(flat.astype(np.float64))
    own = {w: i for i, w in enumerate(vocab.words[:vocab.n_own])}
    tails = range(G.TAILS)
    n = [sum(c for w, c in counts.items() if w not in own and G.tail_class(w) == k) for k in tails]
    v = [sum(1 for w in counts if w not in own and G.tail_class(w) == k) for k in tails]
    symbol = lambda w: own[w] if w in own else G.CLASSES * G.WORDS + G.tail_class(w)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, before, total = np.zeros(G.STATE), symbol(G.END), 0.0
    for w in [*words_of(text), G.END]:
        x = p["x"][before]
        z = sigmoid(x[:G.STATE] + h @ p["u"][:, :G.STATE])
        r = sigmoid(x[G.STATE:2 * G.STATE] + h @ p["u"][:, G.STATE:])
        c = np.tanh(x[2 * G.STATE:] + (r * h) @ p["v"])
        h = (1 - z) * h + z * c
        s = symbol(w)
        logits = h @ p["wc"] + p["bc"]
        share = lambda y, k: math.exp(y[k] - y.max()) / np.exp(y - y.max()).sum()
        if w in own:
            k, i = divmod(s, G.WORDS)
            total += math.log10(share(logits, k)) + math.log10(share(h @ p["ww"][k] + p["bw"][k], i))
        else:
            k = s - G.CLASSES * G.WORDS
            total += math.log10(share(logits, G.CLASSES + k)) + math.log10((counts.get(w, 0) + 1) / (n[k] + v[k] + 1))
        before = s
    return total


def test_scores_equal_a_plain_pass(spark, odd_docs, odd_rows, monkeypatch):
    kept = {}

    def untrained(train, vocab, n_docs):
        kept["vocab"] = vocab
        kept["flat"] = np.random.default_rng(1).normal(0, 0.3, sum(math.prod(s) for s in G.SHAPES.values())).astype(np.float32)
        return kept["flat"]
    monkeypatch.setattr(G, "train_network", untrained)
    monkeypatch.setattr(G, "HEAD", 40)
    got = {}
    for r in G.score_documents(odd_docs).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    import zlib
    counts = {}
    for doc_id, text, *_ in odd_rows:
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2:
            for w in [*words_of(text), G.END]:
                counts[w] = counts.get(w, 0) + 1
    want = {}
    for doc_id, text, *_ in odd_rows:
        want.setdefault(doc_id, []).append(plain_score(text, kept["flat"], kept["vocab"], counts))
    assert got.keys() == want.keys()
    for k in want:
        assert sorted(got[k]) == pytest.approx(sorted(want[k]), rel=2e-4, abs=1e-3), k


def test_a_long_text_holds_its_own_tokens_only():
    docs = [np.zeros(1_000_000, np.int32)] + [np.zeros(30, np.int32) for _ in range(255)]
    s = G.Streams(docs)
    held = sum(getattr(s, n).nbytes for n in ("token", "before", "fresh", "doc"))
    assert held < 20_000_000
    seen = 0
    for token, before, fresh, doc in s.windows():
        seen += int((doc >= 0).sum())
        assert token.shape == before.shape == fresh.shape == doc.shape and token.shape[0] <= G.WINDOW
    assert seen == 1_000_000 + 255 * 30


def test_windows_give_every_document_in_order():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 90, n).astype(np.int32) for n in (70, 1, 33, 5, 5, 64, 2)]
    for lanes in (1, 3, 20):
        got, begins = {d: [] for d in range(len(docs))}, {d: [] for d in range(len(docs))}
        for token, before, fresh, doc in G.Streams(docs, lanes).windows():
            for d in range(len(docs)):
                at = doc.T == d  # a document lies in one lane
                got[d] += list(zip(token.T[at].tolist(), before.T[at].tolist()))
                begins[d] += fresh.T[at].tolist()
        for d, doc in enumerate(docs):
            assert got[d] == list(zip(doc.tolist(), [doc[-1], *doc[:-1].tolist()]))
            assert begins[d] == [True] + [False] * (len(doc) - 1)


def test_symbols_alone_are_those_of_a_full_read():
    words = [b"w%d" % i for i in range(G.CLASSES * G.WORDS + 40)]
    vocab = G.Vocabulary(words, np.arange(len(words), 0, -1), 10_000, len(words) + 9, [1_000_000] * G.TAILS, [60] * G.TAILS)
    for text in (None, "", "w1 W2 unseen w1 w1040 x é", " ".join(f"w{i} q{i % 7}" for i in range(1060))):
        assert vocab.read_symbols(text).tolist() == vocab.read(text)[0].tolist()


def test_gradients_of_the_output_layers():
    """Against finite differences, for tokens in no order, of all kinds and repeated."""
    rng = np.random.default_rng(3)
    flat = rng.normal(0, 0.4, sum(math.prod(s) for s in G.SHAPES.values()))
    net, hidden = G.Network(flat), rng.uniform(-1, 1, (60, G.STATE))
    token = rng.permutation(np.concatenate([rng.integers(0, G.SYMBOLS, 40), [3] * 10, [G.SYMBOLS - 1] * 10]))
    grads = {n: np.zeros(s) for n, s in G.SHAPES.items()}
    score, back = net.outputs(hidden, token, grads)
    loss = lambda: -net.outputs(hidden, token, None)[0].sum()
    assert abs(loss() + score.sum()) < 1e-9
    k = int(token[token < G.CLASSES * G.WORDS][0])
    for array, grad, at in ((hidden, back, (5, 2)), (net.p["wc"], grads["wc"], (1, G.CLASSES + G.TAILS - 1)), (net.p["bc"], grads["bc"], (0,)),
                            (net.p["ww"], grads["ww"], (0, 4, 3)), (net.p["bw"], grads["bw"], divmod(k, G.WORDS))):
        was = array[at]
        array[at] = was + 1e-5
        up = loss()
        array[at] = was - 1e-5
        down = loss()
        array[at] = was
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-6


ODD = [None, "", " \n\t ", "x", " X ", "the THE  the ", "É é", "\x00 a\x00", "ab\x0bc\x0cd\re\x1cf", "z\u00a0q\u2003r \U0001f600", "w1 unseen W2 unseen w1060 q " * 3]


def plain(vocab, text):
    symbols, known, rest = vocab.read(text)
    return symbols.tolist(), known.tolist(), rest


@pytest.mark.parametrize("end", [True, False])
def test_many_texts_are_read_without_a_step_a_word(end, monkeypatch):
    """As a word at a time gives them; the corpus pass took half its processor time to look up words."""
    words = [b"w%d" % i for i in range(G.CLASSES * G.WORDS + 40)] + [G.END] * end
    vocab = G.Vocabulary(words, np.arange(len(words), 0, -1), 10_000, len(words) + 9, [1_000_000] * G.TAILS, [60] * G.TAILS)
    want = [plain(vocab, t) for t in ODD]
    split = [words_of(t) for t in ODD]

    def a_word_at_a_time(*_):
        raise AssertionError("a text was read a word at a time")
    monkeypatch.setattr(G, "words_of", a_word_at_a_time)
    batch = pa.RecordBatch.from_arrays([pa.array(ODD)], ["text"])
    read = [d.tolist() for docs in G._texts(iter([batch.slice(0, 4), batch.slice(4, 0), batch.slice(4)]), vocab) for d in docs]
    assert read == [w[0] for w in want]
    symbols, at, sizes, words, places = vocab.read_texts(batch.column(0))
    assert sizes.tolist() == [len(w) + 1 for w in split] and words.to_pylist() == [w for ws in split for w in ws]
    assert G.tail_classes(words).tolist() == [G.tail_class(w) for w in words.to_pylist()]
    ends = np.cumsum(sizes)
    for i, (a, b) in enumerate(zip(ends - sizes, ends)):
        inner = places[(places >= a) & (places < b)]
        rest = Counter(w for w, p in zip(words.to_pylist(), places) if a <= p < b and at[p] < 0) + Counter({G.END: int(not end)})
        assert inner.tolist() == list(range(a, b - 1))
        assert (symbols[a:b].tolist(), [k for k in at[a:b].tolist() if k >= 0], rest) == want[i]


def test_portions_hold_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) * (i % 50) for i in range(3000)])], ["text"])
    got = list(G.portions(iter([batch.slice(0, 5), batch.slice(5, 0), batch.slice(5)]), 9_000))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch])) and len(got) > 5
    assert all(b.nbytes < 30_000 for b in got) and list(G.portions(iter([]), 9_000)) == []


def test_large_logits_are_scored(monkeypatch):
    """Weights beyond what exp holds, and rows of a softmax in parts as well as at once."""
    rng = np.random.default_rng(5)
    flat = rng.normal(0, 40, sum(math.prod(s) for s in G.SHAPES.values())).astype(np.float32)
    hidden, token = rng.uniform(-1, 1, (90, G.STATE)).astype(np.float32), rng.integers(0, G.SYMBOLS, 90)
    grads = [{n: np.zeros(s, np.float32) for n, s in G.SHAPES.items()} for _ in range(2)]
    whole = G.Network(flat).outputs(hidden, token, grads[0])
    monkeypatch.setattr(G, "ROWS", 7)
    parts = G.Network(flat).outputs(hidden, token, grads[1])
    assert np.isfinite(whole[0]).all() and (whole[0] <= 1e-4).all()
    for a, b in (*zip(whole, parts), *((grads[0][n], grads[1][n]) for n in G.SHAPES)):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-3)
