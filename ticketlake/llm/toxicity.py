"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams (5 and 6 bytes of the lower-cased text with
single blanks) hashed into 2**20 buckets.  The training sample gives each bucket the ratio
``r = log((1 + positive texts) / positives) - log((1 + negative texts) / negatives)``, and
a logistic regression is fitted on the features times r.  Scoring needs only their product
with the weights, one float per bucket (4 MB, whatever the data), which is broadcast.

The sample is bounded (MAX_ROWS rows, MAX_CHARS characters, both labels alike); the
intercept is shifted from the sample's share of label 1 to that of all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.kernels import Words, pieces
from ticketlake.llm.linear_text import Distinct, char_ngrams, held_out, training_sample
from ticketlake.llm.spark import bounded_batches

LENGTHS, BITS = (5, 6), 20
MAX_ROWS, MAX_CHARS = 2000, 6_000_000
ROUNDS, RATE, DECAY = 60, 0.05, 2e-3


def features(texts: list[str | None], distinct: Distinct) -> list[np.ndarray]:
    """Distinct bucket ids of each text."""
    words = Words(texts)
    parts = [char_ngrams(words, n, BITS) for n in LENGTHS]
    return [distinct(np.concatenate([ids[at[d]:at[d + 1]] for ids, at in parts])) for d in range(len(texts))]


def fit(texts: list[str], y: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """(weight per bucket, intercept).  Without a row of each label: the prior alone."""
    size = 1 << BITS
    clipped = min(max(prior, 1e-6), 1 - 1e-6)
    if not len(y) or y.min() == y.max():
        return np.zeros(size, np.float32), float(np.log(clipped / (1 - clipped)))
    distinct = Distinct(BITS)
    chunks = []  # ids of a few texts at a time bound the temporaries
    for lo in range(0, len(texts), 200):
        own = features(texts[lo:lo + 200], distinct)
        chunks.append((np.concatenate(own), np.array([len(x) for x in own]), y[lo:lo + 200].astype(float)))
    seen = np.zeros((2, size))
    for ids, n, label in chunks:
        weight = np.repeat(label, n)
        seen[1] += np.bincount(ids, weight, size)
        seen[0] += np.bincount(ids, 1 - weight, size)
    ratio = np.log((1 + seen[1]) / y.sum()) - np.log((1 + seen[0]) / (1 - y).sum())
    used = (seen[0] + seen[1]) > 0
    ratio[~used] = 0
    w, b = np.zeros(size), 0.0
    mean, square = np.zeros(size), np.zeros(size)
    for step in range(1, ROUNDS + 1):
        v, grad, slope = w * ratio, np.zeros(size), 0.0
        for ids, n, label in chunks:
            z = np.bincount(np.repeat(np.arange(len(n)), n), v[ids], len(n)) + b
            miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / len(y)
            grad += np.bincount(ids, np.repeat(miss, n), size)
            slope += miss.sum()
        grad = grad * ratio + DECAY * w
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad * grad - square)
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        b -= RATE * float(np.sign(slope)) * min(abs(slope) * 10, 1.0)
    share = y.mean()
    shift = np.log(clipped / (1 - clipped)) - np.log(share / (1 - share))
    return (w * ratio).astype(np.float32), float(b + shift)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = model.value
        distinct = Distinct(BITS)
        for batch in pieces(batches, "text"):
            z = np.array([weight[f].sum(dtype=np.float64) for f in features(batch.column(1).to_pylist(), distinct)]) + bias
            score = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["id", "score"])

    return run


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text"):
    """The model, broadcast: weights of fixed size and the intercept."""
    model = fit(*training_sample(docs, labels, label, id_col, text_col, MAX_ROWS, MAX_CHARS))
    return docs.sparkSession.sparkContext.broadcast(model)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, held_out, score (0 to 1), predicted (score >= 0.5).

    Only labelled rows outside the held-out fold are learnt from; the score sees nothing
    but the text.  Null and empty texts have no features and get the intercept's score; a
    null label is no label; with one label only (or none) every score is the share of
    label 1.  A row without id is scored, is not held out and is not learnt from; repeated
    rows are scored alike and learnt from once.  Other columns are ignored."""
    bounded_batches(docs.sparkSession)
    model = learn(docs, labels, label, id_col, text_col)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = plain.mapInArrow(_score(model), "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores 0.5 or more; all columns are kept."""
    bounded_batches(docs.sparkSession)
    model = learn(docs, labels, label, id_col, text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = model.value
        distinct = Distinct(BITS)
        for batch in pieces(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            z = np.array([weight[f].sum(dtype=np.float64) for f in features(texts, distinct)]) + bias
            yield batch.filter(pa.array(z < 0))

    return docs.mapInArrow(keep, docs.schema)
