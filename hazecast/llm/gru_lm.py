"""Language-model scoring with a gated recurrent network in numpy.

The corpus pass counts every word (and text end) of the training documents.  The network reads the
most frequent words as themselves and all others as one of ``TAILS`` tail classes, by the word's
last two bytes.  Its output softmax is factored by class: a softmax over the frequency classes of
the frequent words and the tail classes, and within a frequency class a softmax over its words;
within a tail class the corpus' smoothed word shares, (c + 1) / (N + V + 1) over the class.  Output
biases begin at the corpus' shares.

Training is truncated backpropagation over windows of ``WINDOW`` tokens with the state carried from
window to window and reset between documents.  A short warm-up on a bounded sample gives a common
start; then every partition reads all its training documents from end to end, learning from every
window, and the parameters are averaged, weighted by tokens, as Spark aggregates.  Scoring carries
the state across the windows of a document from its first token to its end, so the log-likelihood
is that of the whole text.

Words that are among the ``HEAD`` most frequent have their counts broadcast (a bound that holds by
construction); the other words of a document leave as (document, word, times) rows, meet the
corpus counts in a join on the word and are summed up per document.

Defined cases: null and empty texts are the end token alone; a null id is trained on and is not
held out; without training documents every word is unknown; repeated rows are scored (and learnt
from) each; an empty table gives an empty result; other columns are not read; a very long text is
read whole, some 60 bytes a word, and holds one lane.

Texts are split, looked up and counted in Arrow, many at a time; ``Vocabulary.read`` says the same of
one text a word at a time.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, doc_fold, hash_order, staged, words_of

#: the end token's word in the counts; no word holds white space
END = b"\n"
#: words with counts in the broadcast table at most
HEAD = 1 << 18
#: frequency classes, words in each, tail classes, size of the state
CLASSES, WORDS, TAILS, STATE = 16, 64, 48, 16
#: tokens of a window; documents that are read side by side in scoring, training and the warm-up;
#: tokens of a training or scoring block
WINDOW, LANES, TRAIN_LANES, WARM_LANES, BLOCK = 32, 256, 256, 32, 1 << 21
#: Adagrad's step and first sum of squares; largest gradient of a parameter per window
RATE, SQUARES, CLIP = 0.03, 1e-2, 1.0
#: documents of the warm-up at most, and its rounds
WARM_DOCS, WARM_ROUNDS = 1024, 2
#: rows of a softmax at a time, so that its exponentials stay in a core's cache
ROWS = 2048
#: bytes of texts that are split into words at a time, to be read and to be counted
READ, COUNT = 1 << 24, 1 << 25


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


def tail_column(word: Column) -> Column:
    return (F.crc32(F.substring(word, -2, 2)) % TAILS).cast("int")


# -- words of many texts -------------------------------------------------------------------------


def portions(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` bytes, a long row whole."""
    held, size = [], 0
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(batch.nbytes, 1))
        for a in range(0, batch.num_rows, rows):
            held.append(batch.slice(a, rows))
            size += held[-1].nbytes
            if size >= most:
                out, held, size = pa.concat_batches(held), [], 0
                yield out
    if held:
        yield pa.concat_batches(held)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts' words as ``words_of`` gives them, one text after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    words, sizes = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
    empty = sizes == 1  # a text without words has one empty part
    empty[empty] = pc.equal(pc.binary_length(words.take(pa.array((np.cumsum(sizes) - 1)[empty]))), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        sizes[empty] = 0
        words = words.filter(pc.not_equal(pc.binary_length(words), 0))
    return words.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()), sizes


@cache
def _tails() -> np.ndarray:
    """Tail classes of two bytes, then of one."""
    return np.array([tail_class(bytes(divmod(i, 256))) for i in range(1 << 16)] + [tail_class(bytes([i])) for i in range(256)], np.int32)


def tail_classes(words: pa.Array) -> np.ndarray:
    """``tail_class`` of each word."""
    if not len(words):
        return np.zeros(0, np.int32)
    _, places, data = words.buffers()
    ends = np.frombuffer(places, np.int64 if pa.types.is_large_binary(words.type) else np.int32)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)
    last, before = data[ends[1:] - 1].astype(np.int32), data[ends[1:] - 2].astype(np.int32)
    return _tails()[np.where(np.diff(ends) > 1, before << 8, 1 << 16) + last]


# -- corpus counts ------------------------------------------------------------------------------


def count_words(train: DataFrame) -> DataFrame:
    """(word, tail, c) over all training texts, an end for each."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, COUNT):
            words, _ = split_words(batch.column(0))
            counts = words.value_counts()
            del words
            yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.binary()), counts.field(1)], ["word", "c"])
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([batch.num_rows], pa.int64())], ["word", "c"])

    return (train.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
            .select("word", tail_column(F.col("word")).alias("tail"), "c"))


class Vocabulary:
    """Counts of the frequent words, and the corpus' totals."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, tail_n: list[int], tail_v: list[int]):
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.words = [words[i] for i in order]
        self.counts = counts[order].astype(np.int64)
        self.total, self.distinct = total, distinct
        own = min(CLASSES * WORDS, len(words))
        #: frequent words read as themselves come first
        self.n_own = own
        #: the end token's place among the frequent words, or -1
        self.end = self.words.index(END) if END in self.words else -1
        self.tail_of = np.array([tail_class(w) for w in self.words], np.int64)
        self.tail_n, self.tail_v = np.array(tail_n, float), np.array(tail_v, float)
        if own:  # the tail classes hold what is not read as itself
            self.tail_n = self.tail_n - np.bincount(self.tail_of[:own], self.counts[:own], TAILS)
            self.tail_v = self.tail_v - np.bincount(self.tail_of[:own], minlength=TAILS)
        self.base_scale = math.log10(total + distinct + 1)
        self.log_c = np.log10(self.counts + 1.0)
        self.tail_scale = np.log10(self.tail_n + self.tail_v + 1)
        #: network symbol of each frequent word: itself, or after those its tail class; last that of the end token
        self.symbol = np.append(np.where(np.arange(len(words)) < own, np.arange(len(words)), CLASSES * WORDS + self.tail_of),
                                self.end if 0 <= self.end < own else CLASSES * WORDS + tail_class(END)).astype(np.int32)

    @cached_property
    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    @cached_property
    def _array(self) -> pa.Array:
        return pa.array(self.words, pa.binary())

    def read_texts(self, texts: pa.Array, frequent: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Of all tokens, one text after another: network symbols and indices of the frequent words (-1 for
        others); how many each text has; the words, and their places among the tokens.  Without
        ``frequent`` only words that are read as themselves have an index, and the symbols are the same."""
        words, sizes = split_words(texts)
        sizes = sizes + 1
        inner = np.ones(int(sizes.sum()), bool)
        inner[np.cumsum(sizes) - 1] = False
        places = np.flatnonzero(inner)
        at = np.full(len(inner), self.end, np.int32)
        among = self._array if frequent else self._array[:self.n_own]
        at[places] = pc.fill_null(pc.index_in(words, value_set=among.cast(words.type)), -1).to_numpy()
        symbols = self.symbol[at]  # the last one where there is no index
        other = np.flatnonzero(at[places] < 0)
        symbols[places[other]] = CLASSES * WORDS + tail_classes(words)[other]
        return symbols, at, sizes, words, places

    def read_documents(self, texts: pa.Array) -> list[np.ndarray]:
        """The network symbols of each text."""
        symbols, _, sizes, _, _ = self.read_texts(texts, False)
        pa.default_memory_pool().release_unused()
        return np.split(symbols, np.cumsum(sizes)[:-1])

    def read_symbols(self, text: str | None) -> np.ndarray:
        return self.read_documents(pa.array([text], pa.string()))[0]

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, Counter]:
        """``read_texts`` of one text a word at a time: symbols, indices of its frequent words, its other words."""
        index, words = self.index, [*words_of(text), END]
        symbols = [self.symbol[index[w]] if w in index else CLASSES * WORDS + tail_class(w) for w in words]
        return np.array(symbols, np.int32), np.array([index[w] for w in words if w in index], np.int64), Counter(w for w in words if w not in index)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the staged counts; the words that reach the driver are HEAD at most."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tails = {r.tail: (r.n, r.v) for r in counts.groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    # Sixteen steps to each doubling of a count: the lowest step from which all words are HEAD at most.
    step = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    steps = sorted(((r.step, r.n) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    lowest, kept, part = None, 0, None
    for s, n in steps:
        if kept + n > HEAD:
            part = s
            break
        lowest, kept = s, kept + n
    taken = F.lit(False) if lowest is None else step >= lowest
    if part is not None:  # of the first step that does not fit whole: its highest counts, then words by hash
        levels = counts.where(step == part).groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c"))
        for r in levels.toLocalIterator():  # a row per count in a sixteenth of a doubling
            if kept + r.n > HEAD:
                share = 0.9 * (HEAD - kept) / r.n
                taken = taken | ((F.col("c") == r.c) & (hash_order("word") < share)) if share > 0 else taken
                break
            taken, kept = taken | (F.col("c") == r.c), kept + r.n
    head = counts.where(taken).select("word", "c").toArrow()
    words, c = head.column("word").to_pylist(), head.column("c").to_numpy().astype(np.int64)
    per_tail = [tails.get(k, (0, 0)) for k in range(TAILS)]
    return Vocabulary(words, c, int(total), int(distinct), [n for n, _ in per_tail], [v for _, v in per_tail])


# -- the network --------------------------------------------------------------------------------

SYMBOLS = CLASSES * WORDS + TAILS
#: fixed order of the parameters in the flat array that is sent and averaged
SHAPES = {"x": (SYMBOLS, 3 * STATE), "u": (STATE, 2 * STATE), "v": (STATE, STATE), "wc": (STATE, CLASSES + TAILS), "bc": (CLASSES + TAILS,),
          "ww": (CLASSES, STATE, WORDS), "bw": (CLASSES, WORDS)}


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = math.prod(shape)
        out[name] = flat[at:at + n].reshape(shape)
        at += n
    return out


def initial(vocab: Vocabulary, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flat = np.concatenate([rng.normal(0, 0.1, math.prod(s)) for s in SHAPES.values()]).astype(np.float32)
    p = unpack(flat)
    own = np.zeros(CLASSES * WORDS)
    own[:vocab.n_own] = vocab.counts[:vocab.n_own]
    own = own.reshape(CLASSES, WORDS)
    p["wc"][:] = 0  # the output layers begin as the corpus' shares alone
    p["ww"][:] = 0
    p["bc"][:] = np.log(np.concatenate([own.sum(axis=1), vocab.tail_n]) + 1)
    p["bw"][:] = np.log(own + (own > 0) + 1e-3)
    return flat


def sorted_by(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the symbols, the symbols in it, and where each one that occurs begins."""
    order = np.argsort(symbols.astype(np.int16), kind="stable")
    ordered = symbols[order]
    return order, ordered, np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1])


class Streams:
    """Documents laid end to end in lanes of about equal length, longest lane first.

    A lane is a stretch of one flat array, so memory grows with the tokens, however unequal the lanes;
    a window gathers the places of its lanes that are not at their end yet."""

    def __init__(self, docs: list[np.ndarray], lanes: int = LANES):
        lanes = max(1, min(lanes, len(docs)))
        heap = [(0, k) for k in range(lanes)]
        held: list[list[int]] = [[] for _ in range(lanes)]
        for d in sorted(range(len(docs)), key=lambda i: (-len(docs[i]), i)):
            size, k = heapq.heappop(heap)
            held[k].append(d)
            heapq.heappush(heap, (size + len(docs[d]), k))
        sizes = sorted(heap, key=lambda x: (-x[0], x[1]))
        self.length = np.array([n for n, _ in sizes])
        self.first = np.cumsum(self.length) - self.length
        order = [d for _, k in sizes for d in held[k]]
        size = np.array([len(docs[d]) for d in order], np.int64)
        begin = (np.cumsum(size) - size)[size > 0]
        self.token = np.concatenate([docs[d] for d in order]) if order else np.zeros(0, np.int32)
        self.before = np.roll(self.token, 1)
        self.before[begin] = self.token[(np.cumsum(size) - 1)[size > 0]]  # the end token stands before a document
        self.fresh = np.zeros(len(self.token), bool)
        self.fresh[begin] = True
        self.doc = np.repeat(np.array(order, np.int32), size)

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(tokens, tokens before, first of a document, document or -1 past a lane's end) by step and lane."""
        longest = int(self.length.max(initial=0))
        for t in range(0, longest, WINDOW):
            live = int((self.length > t).sum())
            step = np.arange(t, min(t + WINDOW, longest))[:, None]
            real = step < self.length[:live]
            at = np.where(real, self.first[:live] + step, 0)
            yield (np.where(real, self.token[at], 0), np.where(real, self.before[at], 0), self.fresh[at] & real,
                   np.where(real, self.doc[at], -1))


class Network:
    def __init__(self, flat: np.ndarray):
        self.flat = flat
        self.p = unpack(flat)

    def states(self, before: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool):
        """States over a window from the carried state h; with what backpropagation needs: by step and
        lane the state before, both gates, the gated state and the candidate."""
        p = self.p
        steps, lanes = before.shape
        # A gate is 1 / (1 + exp(-a)): the sign goes into the weights.
        xg = np.take(-p["x"][:, :2 * STATE], before, axis=0)
        xc = np.take(np.ascontiguousarray(p["x"][:, 2 * STATE:]), before, axis=0)
        u, v = -p["u"], p["v"]
        begins = fresh.any(axis=1).tolist()
        out = np.empty((steps, lanes, STATE), xg.dtype)
        h0, gates, gated, candidates = [np.empty((steps if keep else 1, lanes, n), xg.dtype) for n in (STATE, 2 * STATE, STATE, STATE)]
        d = np.empty((lanes, STATE), xg.dtype)
        with np.errstate(over="ignore"):  # one over infinity is the gate's 0
            for t in range(steps):
                at = t if keep else 0
                if keep or begins[t]:  # a copy: the states of the step before stay as they are
                    h0[at] = h
                    h = h0[at]
                if begins[t]:
                    h[np.flatnonzero(fresh[t])] = 0
                g = np.matmul(h, u, out=gates[at])
                g += xg[t]
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
                c = np.matmul(np.multiply(g[:, STATE:], h, out=gated[at]), v, out=candidates[at])
                c += xc[t]
                np.tanh(c, out=c)
                np.subtract(c, h, out=d)
                d *= g[:, :STATE]
                h = np.add(h, d, out=out[t])
        return out, h, (h0, gates, gated, candidates) if keep else None

    def outputs(self, hidden: np.ndarray, token: np.ndarray, grads: dict[str, np.ndarray] | None):
        """Log probability of each token (a tail class for tail words); with grads, also the
        gradient to the states of minus its sum."""
        p = self.p
        # In order of the symbols a class is a slice.
        order = np.argsort(token.astype(np.int16), kind="stable")
        token = token[order]
        n = len(token)
        own = token < CLASSES * WORDS
        target = np.where(own, token // WORDS, token - CLASSES * WORDS + CLASSES)
        h1 = np.empty((n, STATE + 1), hidden.dtype)  # a column of ones: the biases are a row of the weights
        h1[:, :STATE] = np.take(hidden, order, axis=0)
        h1[:, STATE] = 1
        wc = np.concatenate([p["wc"], p["bc"][None]])
        ww = np.concatenate([p["ww"], p["bw"][:, None]], axis=1)
        # States lie within (-1, 1), so the weights bound the logits; only beyond what exp holds is each
        # row's largest taken off.
        far = max(float(np.abs(wc).sum(axis=0).max()), float(np.abs(ww).sum(axis=1).max())) > 60
        score = np.empty(n, hidden.dtype)
        back = None if grads is None else np.empty((n, STATE), hidden.dtype)

        def layer(a: int, b: int, at: np.ndarray, weight: np.ndarray):
            """One softmax over rows a to b: the log probability of the places ``at``; with grads, the
            gradients to the states and to the weights."""
            h, width = h1[a:b], weight.shape[1]
            e = h @ weight
            flat, place = e.reshape(-1), np.arange(0, (b - a) * width, width) + at
            said = flat[place]
            if far:
                most = e.max(axis=1)
                e -= most[:, None]
                said -= most
            np.exp(e, out=e)
            total = e @ np.ones(width, e.dtype)
            said -= np.log(total)
            if grads is None:
                return said, None, None
            e *= np.reciprocal(total, out=total)[:, None]
            flat[place] -= 1
            return said, e @ weight[:STATE].T, (e.T @ h).T

        for a in range(0, n, ROWS):
            b = min(a + ROWS, n)
            score[a:b], to_h, g = layer(a, b, target[a:b], wc)
            if grads is not None:
                back[a:b] = to_h
                grads["wc"] += g[:STATE]
                grads["bc"] += g[STATE]
        ends = np.searchsorted(token, np.arange(CLASSES + 1) * WORDS).tolist()
        for k in range(CLASSES):
            for a in range(ends[k], ends[k + 1], ROWS):
                b = min(a + ROWS, ends[k + 1])
                said, to_h, g = layer(a, b, token[a:b] - k * WORDS, ww[k])
                score[a:b] += said
                if grads is not None:
                    back[a:b] += to_h
                    grads["ww"][k] += g[:STATE]
                    grads["bw"][k] += g[STATE]
        out = np.empty_like(score)
        out[order] = score
        if grads is None:
            return out, None
        unsorted = np.empty_like(back)
        unsorted[order] = back
        return out, unsorted

    def log_likelihoods(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log of each document's probability under the network."""
        out = np.zeros(len(docs))
        streams = Streams(docs)
        h = np.zeros((len(streams.length), STATE), np.float32)
        for token, before, fresh, doc in streams.windows():
            hidden, h, _ = self.states(before, fresh, h[:token.shape[1]], False)
            real = doc.ravel() >= 0
            if real.all():
                real = slice(None)
            score, _ = self.outputs(hidden.reshape(-1, STATE)[real], token.ravel()[real], None)
            out += np.bincount(doc.ravel()[real], score.astype(np.float64), len(docs))
        return out

    def train(self, docs: list[np.ndarray], squares: np.ndarray, lanes: int = TRAIN_LANES) -> None:
        """One pass over the documents; ``squares`` are Adagrad's sums, kept from call to call."""
        streams = Streams(docs, lanes)
        p, sq = self.p, unpack(squares)
        h = np.zeros((len(streams.length), STATE), np.float32)
        grads = {n: np.zeros(s, np.float32) for n, s in SHAPES.items() if n != "x"}
        for token, before, fresh, doc in streams.windows():
            steps, lanes = token.shape
            for g in grads.values():
                g[:] = 0
            hidden, h, kept = self.states(before, fresh, h[:lanes], True)
            real = doc.ravel() >= 0
            if real.all():
                real = slice(None)
            back = np.zeros((steps * lanes, STATE), np.float32)
            _, back[real] = self.outputs(hidden.reshape(-1, STATE)[real], token.ravel()[real], grads)
            back = back.reshape(steps, lanes, STATE)
            gx = np.empty((steps, lanes, 3 * STATE), np.float32)
            # Gates' and candidates' derivatives of the whole window at once; then back step by step.
            h0, gates, rh, c = kept
            z, r = gates[:, :, :STATE], gates[:, :, STATE:]
            carry = 1 - z
            to_z = np.subtract(c, h0)
            to_z *= z
            to_z *= carry
            to_c = np.square(c, out=c)
            np.subtract(1, to_c, out=to_c)
            to_c *= z
            to_r = 1 - r
            to_r *= rh
            begins = fresh.any(axis=1).tolist()
            dh = np.zeros((lanes, STATE), np.float32)
            ut, vt = p["u"].T.copy(), p["v"].T.copy()
            for t in range(steps - 1, -1, -1):
                dh += back[t]
                own = gx[t]
                np.multiply(dh, to_z[t], out=own[:, :STATE])
                dc = np.multiply(dh, to_c[t], out=own[:, 2 * STATE:])
                drh = dc @ vt
                np.multiply(drh, to_r[t], out=own[:, STATE:2 * STATE])
                dh *= carry[t]
                drh *= r[t]
                dh += drh
                dh += own[:, :2 * STATE] @ ut
                if begins[t]:
                    dh[fresh[t]] = 0
            flat_gx = gx.reshape(-1, 3 * STATE)
            grads["u"] += h0.reshape(-1, STATE).T @ flat_gx[:, :2 * STATE]
            grads["v"] += rh.reshape(-1, STATE).T @ flat_gx[:, 2 * STATE:]
            scale = np.float32(1 / lanes)
            for n, g in grads.items():
                g *= scale
                np.clip(g, -CLIP, CLIP, out=g)
                sq[n] += g * g
                p[n] -= RATE * g / (np.sqrt(sq[n]) + 1e-6)
            # input rows: sums by symbol, for the symbols that occur
            order, flat, first = sorted_by(before.ravel()[real])
            own = flat[first]
            # two columns are added as the parts of one complex number, in half the steps
            g = np.add.reduceat(np.take(flat_gx[real], order, axis=0).view(np.complex64), first, axis=0).view(np.float32)
            g = np.clip(g * scale, -CLIP, CLIP)
            sq["x"][own] += g * g
            p["x"][own] -= RATE * g / (np.sqrt(sq["x"][own]) + 1e-6)


def _texts(batches: Iterator[pa.RecordBatch], vocab: Vocabulary) -> Iterator[list[np.ndarray]]:
    """Lists of the texts' network symbols of about BLOCK tokens."""
    docs, tokens = [], 0
    for batch in portions(batches, READ):
        for doc in vocab.read_documents(batch.column("text")):
            docs.append(doc)
            tokens += len(doc)
            if tokens >= BLOCK:
                yield docs
                docs, tokens = [], 0
    if docs:
        yield docs


def train_network(train: DataFrame, vocab: Vocabulary, n_docs: int) -> np.ndarray:
    """Parameters after a warm-up in one task and one averaged pass over all training documents."""
    spark = train.sparkSession
    if not vocab.n_own:
        return initial(vocab)
    sent_vocab = spark.sparkContext.broadcast(vocab)

    def passes(start: np.ndarray | None, rounds: int, lanes: int):
        sent = spark.sparkContext.broadcast(start)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab = sent_vocab.value
            flat = initial(vocab) if sent.value is None else sent.value.copy()
            net, squares, tokens = Network(flat), np.full(len(flat), SQUARES, np.float32), 0
            for docs in _texts(batches, vocab):
                for _ in range(rounds):
                    net.train(docs, squares, lanes)
                tokens += sum(map(len, docs))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([flat.tolist()], pa.list_(pa.float32()))],
                                                 ["tokens", "params"])
        return run

    few = bounded_sample(train, WARM_DOCS, n_docs, hash_order("doc_id", "text"), "doc_id")
    warm = few.coalesce(1).mapInArrow(passes(None, WARM_ROUNDS, WARM_LANES), "tokens long, params array<float>").first()
    start = np.array(warm.params, np.float32)
    # Averages of each parameter over the partitions, weighted by their tokens, summed up in Spark.
    got = (train.mapInArrow(passes(start, 1, TRAIN_LANES), "tokens long, params array<float>")
           .select("tokens", F.posexplode("params").alias("at", "x")).groupBy("at")
           .agg((F.sum(F.col("tokens") * F.col("x").cast("double")) / F.sum("tokens")).alias("x")).toArrow())
    out = np.empty(len(start), np.float32)
    out[got.column("at").to_numpy()] = got.column("x").to_numpy()
    return out


# -- scoring ------------------------------------------------------------------------------------

_ROWS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                   ("base_score", pa.float64()), ("score", pa.float64()), ("word", pa.binary()), ("times", pa.int64())])
_ROWS_DDL = ("key long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
             "word binary, times long")


def rows_of(n: int, **given) -> pa.RecordBatch:
    """``n`` rows of the scoring's output; numbers that are not given are 0, other columns null."""
    none = {"n_tokens": np.zeros(n, np.int64), "n_known": np.zeros(n, np.int64), "base_score": np.zeros(n), "score": np.zeros(n), "times": np.zeros(n, np.int64)}
    columns = none | given
    arrays = [columns.get(f.name) for f in _ROWS]
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
                                       for c, f in zip(arrays, _ROWS)], schema=_ROWS)


def score_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row."""
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(doc_fold(F.col(doc_id), folds) == held, F.lit(False)).alias("held_out"),
                     F.col(text).alias("text"))
    train = docs.where("not held_out")
    counts = staged(count_words(train), "lm-counts")
    vocab = vocabulary(counts)
    n_docs = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]  # an end each
    flat = train_network(train, vocab, n_docs)
    sent, sent_vocab = spark.sparkContext.broadcast(flat), spark.sparkContext.broadcast(vocab)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, net = sent_vocab.value, Network(sent.value)
        first = TaskContext.get().partitionId() << 33
        for batch in portions(batches, READ):
            symbols, at, sizes, words, places = vocab.read_texts(batch.column("text"))
            n = len(sizes)
            key, text = np.arange(first, first + n), np.repeat(np.arange(n, dtype=np.int32), sizes)
            first += n
            known = np.flatnonzero(at >= 0)
            known, of = at[known], text[known]
            n_known = np.bincount(of, minlength=n)
            base = np.bincount(of, vocab.log_c[known], n) - vocab.base_scale * n_known
            # frequent words that the network reads as tail classes: their share in the class
            tail = known >= vocab.n_own
            share = np.bincount(of[tail], vocab.log_c[known[tail]] - vocab.tail_scale[vocab.tail_of[known[tail]]], n)
            # other words, once for each text that holds them
            rest = np.flatnonzero(at[places] < 0)
            coded = words.take(pa.array(rest)).dictionary_encode()
            distinct = max(len(coded.dictionary), 1)
            pairs, times = np.unique(text[places[rest]].astype(np.int64) * distinct + coded.indices.to_numpy(), return_counts=True)
            others = coded.dictionary
            batch = batch.select(["doc_id", "held_out"])
            del at, words, places, text, known, of, tail, rest, coded  # not held beside the network
            pa.default_memory_pool().release_unused()
            score = net.log_likelihoods(np.split(symbols, np.cumsum(sizes)[:-1])) / math.log(10) + share
            # a word of its own for each text, so that these rows spread over the join's partitions
            yield rows_of(n, key=key, doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), n_tokens=sizes, n_known=n_known,
                          base_score=base, score=score, word=[END + k.to_bytes(8) for k in key.tolist()])
            if vocab.end < 0:
                yield rows_of(n, key=key, word=[END] * n, times=np.ones(n, np.int64))
            for a in range(0, len(pairs), 20_000):
                of, word = np.divmod(pairs[a:a + 20_000], distinct)
                yield rows_of(len(of), key=key[of], word=others.take(pa.array(word)), times=times[a:a + 20_000])

    rows = docs.mapInArrow(scored, _ROWS_DDL)
    scale = F.element_at(F.array(*[F.lit(float(x)) for x in vocab.tail_scale]), tail_column(F.col("word")) + 1)
    log_c = F.log10(F.coalesce(F.col("c"), F.lit(0)).cast("double") + 1)
    real = F.col("times") > 0
    joined = rows.join(counts.select("word", "c"), "word", "left").select(
        "key", "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
        (F.col("base_score") + F.when(real, F.col("times") * (log_c - F.lit(vocab.base_scale))).otherwise(0.0)).alias("base_score"),
        (F.col("score") + F.when(real, F.col("times") * (log_c - scale)).otherwise(0.0)).alias("score"))
    return joined.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
                                     F.sum("n_known").alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
                                     F.sum("base_score").alias("base_score"), F.sum("score").alias("score")).drop("key")
