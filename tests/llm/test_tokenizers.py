import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hazecast.llm import piece_codec, token_counts

BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def counter():
    with open(BPE, encoding="utf-8") as f:
        return token_counts.BytePairCounter(f.read())


@pytest.fixture(scope="module")
def codec():
    return piece_codec.Codec(piece_codec.PieceModel(piece_codec.load_model(PIECES)))


LIBRARY, LIBRARY_PIECES = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
TEXTS = st.text(alphabet=st.characters(codec="utf-8"), max_size=80) | st.text(alphabet="ab 'lést\n▁0", max_size=200)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_equal_the_library(text):
    with open(BPE, encoding="utf-8") as f:
        counter = token_counts._counter(f.read())
    assert counter.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_pieces_equal_the_library(texts):
    codec = piece_codec._codec(MODEL)
    ids = LIBRARY_PIECES.encode(texts)
    want = [(len(x), ",".join(map(str, x)).encode(), LIBRARY_PIECES.decode(x).encode()) for x in ids]
    assert list(codec.encode(texts)) == want
    assert [codec.model.decode(x) for x in ids] == [LIBRARY_PIECES.decode(x) for x in ids]


MODEL = piece_codec.load_model(PIECES)


def test_heap_merging_equals_rescanning(counter):
    rng = random.Random(1)
    for _ in range(200):
        piece = "".join(rng.choices("aeinorst the", k=rng.randint(0, 40)))
        assert counter.merged(piece.encode()) == token_counts.brute_force(piece, counter)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000, " " * 5_000, "é" * 3_000, "0" * 4_000, "▁" * 300 + "x", "\n" * 999])
def test_long_runs(counter, codec, text):
    assert counter.count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)
    ids = LIBRARY_PIECES.encode(text)
    assert next(codec.encode([text]))[1] == ",".join(map(str, ids)).encode()


def test_caches_stay_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 20)
    monkeypatch.setattr(piece_codec, "CACHE", 20)
    with open(BPE, encoding="utf-8") as f:
        counter = token_counts.BytePairCounter(f.read())
    codec = piece_codec.Codec(piece_codec.PieceModel(MODEL))
    texts = [f"word{i} other{i % 7} {'y' * 100}{i}" for i in range(300)]
    assert [counter.count(t) for t in texts] == [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [x[1] for x in codec.encode(texts)] == [",".join(map(str, x)).encode() for x in LIBRARY_PIECES.encode(texts)]
    assert len(counter.young) + len(counter.old) <= 20
    assert all(len(s) <= piece_codec.LONGEST for s in codec.young)


def test_count_tokens_on_odd_rows(odd_docs, odd_rows):
    got = token_counts.count_tokens(odd_docs, BPE, limit=50)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_tokens", "n_bytes", "over_limit"]
    want = []
    for i, text, *_ in odd_rows:
        n = len(LIBRARY.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 50))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=key) == sorted(want, key=key)


def test_encode_on_odd_rows(odd_docs, odd_rows):
    got = piece_codec.encode_texts(odd_docs, PIECES, with_ids=True)
    back = piece_codec.decode_ids(got, PIECES)
    want = {}
    for _, text, *_ in odd_rows:
        ids = LIBRARY_PIECES.encode(text or "")
        plain = LIBRARY_PIECES.decode(ids)
        want[text] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest(), ids, plain)
    rows = back.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, r.decoded) == want[r.text]


def test_empty_tables(no_docs):
    assert token_counts.count_tokens(no_docs, BPE).count() == 0
    assert piece_codec.encode_texts(no_docs, PIECES).count() == 0
