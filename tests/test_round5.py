"""Round 3's findings on trainers and similarity joins, on rows of their own."""

import random

import numpy as np
from pyspark.ml.linalg import Vectors

from ticketlake.operators import ml, softmax
from ticketlake.operators import text as tx


def gaps(rows, w, b, reg):
    """Gradient of the mean log loss + reg / 2 * squares, from dense arrays."""
    x = np.array([v.toArray() for v, _, _ in rows])
    y, weight = np.array([int(r[1]) for r in rows]), np.array([r[2] for r in rows])
    m = x @ w.T + b
    p = np.exp(m - m.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p *= (weight / weight.sum())[:, None]
    return p.T @ x + reg * w, p.sum(axis=0)


def test_softmax_ends_at_the_minimum_in_few_evaluations(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for k in range(300):  # a few frequent terms, many that one or two rows have
        terms = {rng.randrange(4): rng.random(), 4 + rng.randrange(400): rng.random() / 9, 4 + rng.randrange(400): rng.random() / 9}
        rows.append((Vectors.sparse(404, terms) if k % 7 else Vectors.dense(Vectors.sparse(404, terms).toArray()), float(rng.randrange(3)), rng.choice([0.5, 1.0, 3.0])))
    df = spark.createDataFrame(rows, ["features", "label_idx", "weight"])
    monkeypatch.setattr(softmax, "RANGE", 100)
    monkeypatch.setattr(softmax, "BLOCK_ENTRIES", 90)
    calls, found = [0], softmax.minimise
    monkeypatch.setattr(softmax, "minimise", lambda f, x, tol, n: found(lambda v: (calls.__setitem__(0, calls[0] + 1), f(v))[1], x, tol, n))
    reg = 1.0 / 300
    model = softmax.fit(df.repartition(3), 404, 3, reg=reg, tol=1e-6, max_iter=1000, weight_col="weight")
    g, g0 = gaps(rows, model.coefficientMatrix.toArray(), model.interceptVector.toArray(), reg)
    assert np.abs(g).max() < 1e-6 and np.abs(g0).max() < 1e-6 and calls[0] < 100


def test_text_classifier_is_saved_and_spread(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(6)) + (" left" if k % 3 else " right") + f" own{k}", "x" if k % 3 else "y") for k in range(90)]
    df = spark.createDataFrame(rows, "id long, text string, label string").coalesce(1)
    model = ml.train_text_classifier(df, "label")
    ml.save_model(model, str(tmp_path / "m"))
    for m in (model, ml.load_model(str(tmp_path / "m"))):
        assert m.transform(df).filter("prediction_label = label").count() == 90
    assert ml.spread(df).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_text_classifier_of_one_class(spark):
    df = spark.createDataFrame([("aa bb", "x"), ("bb cc", "x"), ("", "x")], "text string, label string")
    assert {r.prediction_label for r in ml.train_text_classifier(df, "label").transform(df).collect()} == {"x"}


def test_clusters_of_more_terms_than_a_pipeline_holds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tx, "PIPELINE_TERMS", 3)
    rows = [(k % 5, " ".join(["left lefts", "right rights", "up ups"][k % 3] for _ in range(4)) + f" own{k}") for k in range(60)]
    df = spark.createDataFrame([*rows, (None, "left"), (7, None)], "id long, text string")  # ids repeat
    paths, splits = ml.train_and_save(df, "id", str(tmp_path))
    assert set(paths) == {"kmeans"} and not splits
    found = ml.TextClusters.load(spark, paths["kmeans"]).transform(df.filter("text is not null")).collect()
    kinds = {}
    for r in found:
        kinds.setdefault(r.text.split()[0], set()).add(r.cluster)
    assert len(found) == 61 and sorted(len(c) for c in kinds.values()) == [1, 1, 1] and len(set.union(*kinds.values())) == 3


def test_terms_are_sent_as_one_text(spark):
    model = tx.pipeline(tx.term_table(spark.createDataFrame([("aa bb Étion", ), ("x_1 bb", )], "text string"), ngrams=2))
    counter = next(s for s in model.stages if hasattr(s, "vocabulary"))
    assert set(counter.vocabulary) == {"aa", "bb", "étion", "x_1", "aa bb", "bb étion", "x_1 bb"} and counter.getOrDefault("vocabSize") == 7
