"""ML1 as a dictionary table, and the settings the trainers must pass on."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlake.operators import evaluation as ev
from ticketlake.operators import ml
from ticketlake.operators import text as tx

TEXTS = ["Étion alpha beta beta", "beta gamma", None, "", "a b c", "delta delta alpha", "Ünïcode_1 x2 x2", "beta, BETA; beta!"]


@pytest.mark.parametrize("ngrams", [1, 2])
@pytest.mark.parametrize("bounds", [{}, {"max_features": 4}, {"min_df": 2}])
def test_vectors_equal_relational_weights_and_pipeline(spark, ngrams, bounds):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    table = tx.term_table(docs, "text", ngrams=ngrams, **bounds)
    index = {r.term: r.idx for r in table.terms.collect()}
    assert sorted(index.values()) == list(range(table.n_terms)) and table.n_docs == len(TEXTS)
    assert table.n_terms == 4 if "max_features" in bounds else table.n_terms > 1
    wanted = {d: np.zeros(table.n_terms) for d in range(len(TEXTS))}
    for r in tx.tfidf(docs, "doc_id", "text", ngrams=ngrams, **bounds).collect():
        wanted[r.doc_id][index[r.term]] = r.weight
    got = {r.doc_id: r.features.toArray() for r in tx.vectors(docs, "doc_id", "text", table).collect()}
    assert set(got) == set(wanted) and all(np.allclose(got[d], wanted[d], atol=1e-15) for d in wanted)
    fitted = tx.pipeline(table).transform(docs.where("text is not null")).select("doc_id", "features").collect()
    assert all(np.allclose(r.features.toArray(), wanted[r.doc_id], atol=1e-15) for r in fitted)


def test_dictionary_is_saved_and_bounded(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    table = tx.term_table(docs)
    table.save(str(tmp_path))
    again = tx.TermTable.load(spark, str(tmp_path))
    assert (again.n_terms, again.n_docs, again.ngrams) == (table.n_terms, table.n_docs, table.ngrams)
    same = [{r.doc_id: r.features for r in tx.vectors(docs, "doc_id", "text", t).collect()} for t in (table, again)]
    assert same[0] == same[1]
    monkeypatch.setattr(tx, "PIPELINE_TERMS", 3)  # no pipeline of more terms than the driver may hold
    with pytest.raises(ValueError, match="max_features"):
        tx.fit_tfidf(docs)
    assert len(tx.fit_tfidf(docs, max_features=3).stages[1].vocabulary) == 3
    assert tx.vectors(docs, "doc_id", "text", table).count() == len(TEXTS)  # the table has no such bound
    empty = tx.term_table(docs.limit(0))
    assert empty.n_terms == 0 and tx.vectors(docs.limit(0), "doc_id", "text", empty).count() == 0


def skewed(rng, n):
    """Nine of ten rows are of one class; the words hardly tell the classes apart."""
    rows = []
    for k in range(n):
        rare = k % 10 == 0
        words = [rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(12)] + [rng.choice(["left", "left", "right"] if rare else ["right", "right", "left"])]
        rows.append((k, " ".join(words), "rare" if rare else "common"))
    return rows


def test_trainers_pass_balanced_weights(spark):
    rows = skewed(random.Random(1), 600)
    df = spark.createDataFrame(rows, "id long, text string, label string")
    plain = ml.train_text_classifier(df, "label", kind="ovr").transform(df)
    assert plain.where("label = 'rare' and prediction_label = 'rare'").count() == 0  # without weights the rare class is never said
    found = ml.baseline_classifier(df, "label").transform(df)
    assert found.where("label = 'rare' and prediction_label = 'rare'").count() > 30
    forest = ml.priority_classifier(df.withColumnRenamed("label", "priority")).transform(df)
    assert forest.where("label = 'rare' and prediction_label = 'rare'").count() > 30
    vec = tx.fit_tfidf(df).transform(df).select("id", "label", "features")
    plain, weighted = (ml.evaluate_classification(vec, "id", "label", balanced=b).first() for b in (False, True))
    assert plain.accuracy == pytest.approx(0.9) and plain.macro_f1 == pytest.approx(0.9 * 2 / 1.9 / 2)  # all is said to be common
    assert weighted.accuracy < 0.85 and weighted.macro_f1 > plain.macro_f1  # the rare class is found, at a cost


def test_weights_are_those_of_the_classes(spark):
    df = spark.createDataFrame([(k, "a" if k < 9 else "b") for k in range(10)], "id long, label string")
    assert {r.label: r.weight for r in ev.with_class_weights(df, "label").collect()} == {"a": pytest.approx(10 / 18), "b": 5.0}


def test_baseline_vocabulary(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("lang").alias("label"))
    fitted = ml.baseline_classifier(docs.limit(200), "label")
    vocabulary = fitted.stages[1].vocabulary
    df = {r.term: r.df for r in tx.vocabulary(tx.doc_terms(docs.limit(200), "doc_id", "text"), "doc_id").collect()}
    assert 100 < len(vocabulary) <= tx.BASELINE_MAX_FEATURES and min(df[t] for t in vocabulary) >= tx.BASELINE_MIN_DF
    forest = [s for s in ml.priority_classifier(docs.limit(100).withColumnRenamed("label", "priority")).stages if hasattr(s, "vocabulary")]
    assert len(forest[0].vocabulary) == tx.PRIORITY_MAX_FEATURES and any(" " in t for t in forest[0].vocabulary)
