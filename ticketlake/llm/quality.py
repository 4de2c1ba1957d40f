"""Quality: supervised subword embeddings.

Words and character n-grams (3 and 4 bytes, case kept) are hashed into 2**18 buckets with
a learnt vector each; a word that repeats the one before it counts as a repetition.  A document is the mean of its vectors, a linear layer with softmax
gives the label; vectors and layer are trained by stochastic gradient descent in numpy on
a bounded sample (MAX_ROWS rows, MAX_CHARS characters, both labels alike).  The layer is
linear in the mean, so for scoring each vector folds into one number, the difference of
its two logits: a table of 1 MB is broadcast, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.kernels import Words, pieces
from ticketlake.llm.linear_text import char_ngrams, held_out, training_sample, word_ids
from ticketlake.llm.spark import bounded_batches

LENGTHS, BITS, DIM = (3, 4), 18, 8
MAX_ROWS, MAX_CHARS = 2000, 6_000_000
EPOCHS, RATE = 8, 0.2
THRESHOLD = 0.3


def _features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, offsets per text) of the words and of each n-gram length."""
    words = Words(texts, lower=False)
    return [word_ids(words, BITS), *(char_ngrams(words, n, BITS) for n in LENGTHS)]


def fit(texts: list[str], y: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """(logit difference per bucket, intercept).  With one label only: the prior."""
    size = 1 << BITS
    clipped = min(max(prior, 1e-6), 1 - 1e-6)
    if not len(y) or y.min() == y.max():
        return np.zeros(size, np.float32), float(np.log(clipped / (1 - clipped)))
    rng = np.random.default_rng(7)
    samples = []
    for lo in range(0, len(texts), 200):
        part = _features(texts[lo:lo + 200])
        for d in range(len(texts[lo:lo + 200])):
            ids, count = np.unique(np.concatenate([f[at[d]:at[d + 1]] for f, at in part]), return_counts=True)
            samples.append((ids, (count / max(1, count.sum())).astype(np.float32)))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, total = 0, EPOCHS * len(samples)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(samples)):
            ids, share = samples[k]
            rate = RATE * (1 - steps / total)
            steps += 1
            own = vectors[ids]
            mean = share @ own
            logits = mean @ layer + bias
            miss = np.exp(logits - logits.max())
            miss /= miss.sum()
            miss[y[k]] -= 1
            back = layer @ miss
            layer -= rate * np.outer(mean, miss)
            bias -= rate * miss
            # the gradient of a mean is tiny for a long text: scaled up to that of a sum
            # over its distinct features, as when every feature moves by itself
            vectors[ids] = own - rate * np.outer(np.minimum(share * len(ids), 4.0), back)
    share1 = y.mean()
    shift = np.log(clipped / (1 - clipped)) - np.log(share1 / (1 - share1))
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0] + shift)


def logits(texts: list[str | None], weight: np.ndarray, bias: float) -> np.ndarray:
    """Logit difference of each text: the mean of its features' numbers plus the bias."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for ids, at in _features(texts):
        run = np.concatenate(([0.0], np.cumsum(weight[ids], dtype=np.float64)))
        total += run[at[1:]] - run[at[:-1]]
        count += np.diff(at)
    return total / np.maximum(count, 1) + bias


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = model.value
        for batch in pieces(batches, "text"):
            z = logits(batch.column(1).to_pylist(), weight, bias)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], names=["id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: id, held_out, score (0 to 1), predicted (score >= threshold).

    Only labelled rows outside the held-out fold are learnt from; the score sees nothing
    but the text.  Null and empty texts have no features and get the intercept's score; a
    null label is no label; with one label only (or none) every score is the share of
    label 1.  A row without id is scored, is not held out and is not learnt from; repeated
    rows are scored alike and learnt from once.  Other columns are ignored."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(
        fit(*training_sample(docs, labels, label, id_col, text_col, MAX_ROWS, MAX_CHARS)))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = plain.mapInArrow(_score(model), "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
