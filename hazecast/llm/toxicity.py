"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of the lower-cased text, hashed to ``BUCKETS``.  Each
is scaled by its log-count ratio r = log((p + a) / P) - log((q + a) / Q), where p and q count the
toxic and other training texts with the n-gram, and P and Q are the sums of p + a and q + a; a
logistic regression is fitted on the scaled features.  Scores see the text alone.

The classifier is fitted on at most ``fit_rows`` labelled texts (half of each class where there
are enough, by the hash of the id; their weights restore the classes' shares).  That bound holds
the fit in one task; the class shares are counted over all labels.  Scoring covers every whole
text where it is read, without a shuffle; the weights (1 MB, whatever the data) are broadcast.

Defined cases: null and empty texts have no features and score the classifier's intercept;
labels that are null are no labels; a document labelled twice is toxic if one label says so; of
repeated rows of a document one is learnt from and all are scored; without training labels of both
classes every score is the share of toxic labels (0 without any); columns of the input stay, and
one of a result's name is replaced; an empty table gives an empty result; a very long text is read
whole, some 30 bytes a character while its n-grams are hashed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, doc_fold, hash_order, staged

BITS = 18
BUCKETS = 1 << BITS
ORDERS = (3, 4, 5)
#: labelled texts that the classifier is fitted on at most
FIT_ROWS = 6_144
#: smoothing of the counts; penalty of the regression; its steps
ALPHA, PENALTY, STEPS = 1.0, 1e-4, 300
#: n-grams of rows that are summed up at once in the fit
ENTRIES = 1 << 20
#: characters that are hashed at once
CHUNK = 1 << 16


def distinct_ngrams(text: str | None, mark: np.ndarray) -> np.ndarray:
    """Buckets of the text's distinct n-grams; ``mark`` is a scratch array of BUCKETS numbers."""
    if not text:
        return np.empty(0, np.int64)
    found = []
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    reach = max(ORDERS) - 1
    for at in range(0, len(chars), CHUNK):
        part = chars[at:at + CHUNK + reach]
        grown, hashes = part.copy(), []
        for n in range(2, max(ORDERS) + 1):
            if len(part) < n:
                break
            grown = grown[:len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1:]
            if n in ORDERS:
                own = grown[:CHUNK] + np.uint32(n)
                hashes.append((own * np.uint32(2654435761)) >> np.uint32(32 - BITS))
        if hashes:
            h = np.concatenate(hashes)
            order = np.arange(len(h), dtype=np.int32)
            mark[h] = order  # the last to write a bucket stays
            found.append(h[mark[h] == order])
    if not found:
        return np.empty(0, np.int64)
    if len(found) == 1:
        return found[0].astype(np.int64)
    return np.unique(np.concatenate(found)).astype(np.int64)


@dataclass
class Classifier:
    weight: np.ndarray
    intercept: float

    def score(self, text: str | None, mark: np.ndarray) -> float:
        z = self.intercept + float(self.weight[distinct_ngrams(text, mark)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(features: list[np.ndarray], label: np.ndarray, weight: np.ndarray) -> Classifier:
    """Weighted logistic regression on ratio-scaled n-grams, by Nesterov steps over all rows."""
    sizes = np.array([len(f) for f in features])
    flat = np.concatenate(features) if len(features) else np.empty(0, np.int32)
    # Runs of whole rows, (first row, last, first n-gram, last): what is made of n-grams stays small.
    ends = np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.unique([0, *np.searchsorted(ends, np.arange(0, ends[-1], ENTRIES)), len(features)])
    runs = [(i, j, ends[i], ends[j]) for i, j in zip(cuts, cuts[1:])]

    def by_row(value: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(np.repeat(np.arange(j - i), sizes[i:j]), value[flat[a:b]], j - i) for i, j, a, b in runs])

    def by_bucket(value: np.ndarray) -> np.ndarray:
        out = np.zeros(BUCKETS)
        for i, j, a, b in runs:
            out += np.bincount(flat[a:b], np.repeat(value[i:j], sizes[i:j]), BUCKETS)
        return out

    p, q = by_bucket((label == 1).astype(float)) + ALPHA, by_bucket((label != 1).astype(float)) + ALPHA
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    total = weight.sum()
    # The loss curves by a quarter of the mean squared length of the rows at most.
    norm = max(1.0, float(weight @ by_row(ratio * ratio) / total))
    rate = 4.0 / norm
    w, b = np.zeros(BUCKETS), float(np.log((weight @ label + 0.5) / (weight @ (1 - label) + 0.5)))
    w0, b0 = w, b
    for k in range(STEPS):
        m = k / (k + 3)
        v, c = w + m * (w - w0), b + m * (b - b0)
        z = by_row(v * ratio) + c
        g = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label) / total
        w0, b0 = w, b
        w = v - rate * (ratio * by_bucket(g) + PENALTY * v)
        b = c - rate * norm / 8 * g.sum()
    return Classifier((w * ratio).astype(np.float32), b)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          train_rows=None, fit_rows: int = FIT_ROWS) -> Classifier:
    """Fit on the labelled documents for which ``train_rows`` (a column over the labels' id; all
    if None) holds."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    if train_rows is not None:
        known = known.where(train_rows)
    known = known.groupBy(F.col(doc_id).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__label"))
    known = staged(known, "toxic-labels")
    shares = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    if not n0 or not n1:
        return Classifier(np.zeros(BUCKETS, np.float32), 40.0 if n1 else -40.0)
    half = fit_rows // 2
    by_hash = lambda c, n, of: bounded_sample(known.where(F.col("__label") == c), n, of, hash_order("__id"), "__id")
    picked = by_hash(1, max(half, fit_rows - n0), n1).unionByName(by_hash(0, max(half, fit_rows - n1), n0))
    picked = staged(picked, "toxic-picked")  # at most fit_rows small rows
    rows = (docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(picked), "__id")
            .groupBy("__id").agg(F.min("__text").alias("__text"), F.first("__label").alias("__label")))

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark, feats, label = np.zeros(BUCKETS, np.int32), [], []
        for f in frames:
            feats += [distinct_ngrams(t, mark).astype(np.int32) for t in f["__text"]]
            label += f["__label"].tolist()
        y = np.array(label, float)
        if len(set(label)) < 2:
            got = Classifier(np.zeros(BUCKETS, np.float32), float(np.log((n1 + 0.5) / (n0 + 0.5))))
        else:
            order = np.lexsort((np.array([f.sum(dtype=np.int64) for f in feats]), y))  # the same sums whatever the rows' order
            share = np.where(y == 1, n1 / y.sum(), n0 / (1 - y).sum())
            got = fit([feats[i] for i in order], y[order], share[order])
        yield pd.DataFrame({"weight": [got.weight.tobytes()], "intercept": [got.intercept]})

    row = rows.repartition(1).mapInPandas(learn, "weight binary, intercept double").first()
    return Classifier(np.frombuffer(row.weight, np.float32), row.intercept)


def score_texts(df: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 if score >= 0.5)."""
    sent = df.sparkSession.sparkContext.broadcast((model.weight.tobytes(), model.intercept))

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, mark = Classifier(np.frombuffer(sent.value[0], np.float32), sent.value[1]), np.zeros(BUCKETS, np.int32)
        for batch in texts:
            yield pa.array([own.score(x.as_py(), mark) for x in batch], pa.float64())

    return df.withColumn("score", scored(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out_scores(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents; rows of fold 0 are never learnt from.
    A null id is not held out (and has no label)."""
    model = train(docs, labels, train_rows=doc_fold(F.col("doc_id"), folds) != 0)
    got = score_texts(docs.select("doc_id", "text"), model)
    return got.select("doc_id", F.coalesce(doc_fold(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose score is under 0.5, learning from all labels."""
    names = docs.columns
    model = train(docs, labels)
    got = score_texts(docs.select(F.struct(*names).alias("__row"), F.col("text").alias("__text")), model, "__text")
    return got.where("predicted = 0").select("__row.*")
