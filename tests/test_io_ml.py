"""Sources, sinks and ML helpers on small inline fixtures."""

import json
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from ticketlake.operators import ml, prep
from ticketlake.sources import files


def _tmp():
    return tempfile.mkdtemp(prefix="ticketlake-test-")


def test_question_lines_blank_and_commas(spark):
    """Blank lines dropped, trailing commas stripped, a lone ',' dropped."""
    d = _tmp()
    with open(os.path.join(d, "q.txt"), "w") as f:
        f.write("How do I reset?\n\n   \n,\nMy order,\n  late delivery  \n")
    got = [r.question for r in files.question_lines(None or spark, d).orderBy("line_id").collect()]
    assert got == ["How do I reset?", "My order", "late delivery"]


def test_json_object_or_array(spark):
    """One object or an array of objects."""
    d1, d2 = _tmp(), _tmp()
    with open(os.path.join(d1, "a.json"), "w") as f:
        json.dump({"question": "q1", "answer": "a1"}, f)
    with open(os.path.join(d2, "b.json"), "w") as f:
        json.dump([{"question": "q2", "answer": "a2"}, {"question": "q3", "answer": ""}], f)
    assert files.read_json_records(spark, d1).count() == 1
    b = files.read_json_records(spark, d2)
    good, bad = prep.required_pair(b, "question", "answer")
    assert good.count() == 1 and bad.first().reject_reason.startswith("question and answer")


def test_service_log_parse(spark):
    d = _tmp()
    with open(os.path.join(d, "log.txt"), "w") as f:
        f.write("2024-05-01 10:11:12,345 - INFO - user_id=u1 | intent=greet | priority=low | sentiment=positive | "
                "thumbs_up=True | thumbs_down=None | fallback=False | response_time=0.250s\nQ: hi\nA: hello\nmodel_version=v1\n")
    r = files.read_service_log(spark, d).first()
    assert (r.user_id, r.intent_tag, r.is_fallback, r.response_time) == ("u1", "greet", False, 0.25)


def test_numeric_schema_check(spark):
    """P17."""
    df = spark.createDataFrame([(1.0, True, "x")], "a double, b boolean, c string")
    assert prep.is_numeric_or_bool(df, "a") and prep.is_numeric_or_bool(df, "b")
    assert not prep.is_numeric_or_bool(df, "c")


def test_sentiment_defaults(spark):
    """empty text -> neutral; no model -> unknown."""
    df = spark.createDataFrame([(1, ""), (2, "  "), (3, "broken again")], "id int, text string")
    got = {r.id: r.sentiment for r in ml.predict_sentiment(df, "text", None).collect()}
    assert got == {1: "neutral", 2: "neutral", 3: "unknown"}


def test_priority_rules_before_model(spark):
    """F8: rules decide first; without a model the rest gets the failure default."""
    df = spark.createDataFrame([(1, "URGENT: down"), (2, "how to reset"), (3, ""), (4, "printer jam")],
                               "id int, text string")
    got = {r.id: r.priority for r in ml.predict_priority(df, "text", None).collect()}
    assert got == {1: "high", 2: "low", 3: "low", 4: "Low"}


def test_encoder_plugin_null_on_failure(spark):
    """ML11 / B14: a failing encoder gives null vectors, never zero vectors."""
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string").coalesce(1)

    def good_factory():
        return lambda texts: np.ones((len(texts), 3))

    def bad_factory():
        def enc(texts):
            raise RuntimeError("quota")
        return enc

    ok = ml.encode_in_pandas(df, "text", good_factory).collect()
    assert all(list(r.embedding) == [1.0, 1.0, 1.0] for r in ok)
    bad = ml.encode_in_pandas(df, "text", bad_factory).collect()
    assert all(r.embedding is None for r in bad)


def test_smoothed_idf_pipeline_matches_relational(spark):
    """ML1 / T16: the pyspark.ml pipeline (IDF + 1, L2) equals the relational weights."""
    from ticketlake.operators import text as tx

    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, "Étion alpha ré")],
                                 "doc_id long, text string")
    model = tx.fit_tfidf(docs, "text", "features", max_features=None, min_df=1.0)
    vocab = model.stages[1].vocabulary
    vecs = {r.doc_id: r.features.toArray() for r in model.transform(docs).collect()}
    rel = tx.tfidf(docs, "doc_id", "text").collect()
    for r in rel:
        assert abs(vecs[r.doc_id][vocab.index(r.term)] - r.weight) < 1e-12
    assert "étion" in vocab  # T17: Unicode-aware tokens


def test_pca_centred_variance(spark):
    rnd = np.random.default_rng(0)
    X = rnd.normal(size=(50, 5)) * np.array([5, 1, 1, 0.1, 0.1]) + 100
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(50)], "id long, v array<double>")
    proj, var = ml.pca_centered(ml.to_vector(df, "v"), 2)
    ev = np.sort(np.linalg.eigvalsh(np.cov(X.T)))[::-1]
    assert abs(var[0] - ev[0] / ev.sum()) < 1e-9
    p = np.array([r.pca.toArray() for r in proj.orderBy("id").collect()])
    assert abs(p[:, 0].mean()) < 1e-9  # centred projection (T19)


def test_smote_exact_counts(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, "a" if i < 20 else "b", rnd.normal(size=3).tolist()) for i in range(27)]
    df = spark.createDataFrame(rows, "id long, lab string, v array<double>")
    out = ml.smote(df, "id", "lab", "v", k=3)
    got = {r.lab: r.n for r in out.groupBy("lab").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 20, "b": 20}
