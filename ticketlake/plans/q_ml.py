"""Driver queries: model training and evaluation (step 8).  ML numbers are engine
specific (SURVEY §7.4): these have no SQL oracle; tests check floors and counts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ticketlake.functions.scalar import l2_normalise
from ticketlake.operators import evaluation as ev
from ticketlake.operators import kpi, ml
from ticketlake.plans.q_prep import ticket_prep
from ticketlake.plans.registry import query
from ticketlake.session import checkpoint_dir, materialize
from ticketlake.sources.tables import table


def _emb_vec(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return ml.to_vector(e, "embedding").withColumn("label", F.col("label").cast("string"))


@query("lr_embeddings")
def lr_embeddings(spark, sf_dir):
    """ML3 / ML12: multinomial logistic regression (C = 1) on the vectors, exact 80/20
    stratified split, weighted scores on the test split."""
    return ml.evaluate_classification(_emb_vec(spark, sf_dir), "vec_id", "label", "features")


@query("lr_balanced")
def lr_balanced(spark, sf_dir):
    """ML3 + A18: the same with balanced class weights and 2,000 iterations at most."""
    return ml.evaluate_classification(_emb_vec(spark, sf_dir), "vec_id", "label", "features", balanced=True, max_iter=ml.BALANCED_MAX_ITER)


@query("model_prediction_sample")
def model_prediction_sample(spark, sf_dir):
    """The first 200 test rows with text, true and predicted label of the baseline
    classifier, trained on the other rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    s = ev.stratified_split(d, "doc_id", "label")
    p = ml.baseline_classifier(s.filter("split = 'train'"), "label").transform(s.filter("split = 'test'"))
    first = kpi.up_to_nth(p, "doc_id", ml.PREDICTION_SAMPLE)  # texts of many tasks' first rows don't meet
    return kpi.first_n(first.select("doc_id", "text", F.col("label").alias("true_label"), F.col("prediction_label").alias("pred_label")),
                       "doc_id", ml.PREDICTION_SAMPLE)


@query("ovr_tfidf")
def ovr_tfidf(spark, sf_dir):
    """ML1 + ML4: TF-IDF (20,000 terms, min_df 2) + balanced one-vs-rest linear model
    predicting a document's language; scores on the test split."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    s = materialize(ev.stratified_split(d, "doc_id", "label"))
    train, test = s.filter("split = 'train'"), s.filter("split = 'test'")
    p = ml.baseline_classifier(train, "label").transform(test).select(F.col("label").alias("y_true"), F.col("prediction_label").alias("y_pred"))
    return ev.summary_scores(p)


@query("rf_priority")
def rf_priority(spark, sf_dir):
    """ML5 + F8: prepared tickets, TF-IDF uni+bigrams (5,000 terms) + balanced random
    forest (100 trees); keyword rules decide first, the forest scores the rest."""
    t = ticket_prep(spark, sf_dir).select("ticket_id", F.col("description").alias("text"), "priority")
    s = materialize(ev.stratified_split(materialize(t), "ticket_id", "priority"))
    train, test = s.filter("split = 'train'"), s.filter("split = 'test'")
    model = ml.priority_classifier(train)
    p = ml.predict_priority(test.withColumnRenamed("priority", "y_true"), "text", model)
    return ev.summary_scores(p.select(F.lower("y_true").alias("y_true"), F.col("priority").alias("y_pred")))


@query("kmeans_scores")
def kmeans_scores(spark, sf_dir):
    """ML7 + ML13: K-Means k = 3 on the vectors, exact silhouette and Davies-Bouldin."""
    return ml.evaluate_clustering(_emb_vec(spark, sf_dir), "vec_id", "features", "embedding", 3)


@query("pca")
def pca(spark, sf_dir):
    """ML8: centred PCA to 2 components; each vector's projection with the explained
    variance ratios."""
    proj, var = ml.pca_centered(_emb_vec(spark, sf_dir), 2)
    arr = ml.to_array(proj, "pca", "_p")
    return arr.select("vec_id", F.col("_p")[0].alias("pc1"), F.col("_p")[1].alias("pc2"),
                      F.lit(var[0]).alias("var1"), F.lit(var[1]).alias("var2"))


@query("smote_counts", sql="""
SELECT CAST(label AS VARCHAR) AS label, (SELECT max(c) FROM (SELECT count(*) AS c FROM embeddings GROUP BY label))::BIGINT AS n,
       count(*)::BIGINT AS n_original
FROM embeddings GROUP BY label""")
def smote_counts(spark, sf_dir):
    """ML9: class sizes after SMOTE (every class at the majority size)."""
    e = table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("string"))
    s = ml.smote(e, "vec_id", "label", "embedding")
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                  F.count_if(~F.col("synthetic")).alias("n_original"))


@query("full_evaluation")
def full_evaluation(spark, sf_dir):
    """ML14: two encoders (raw vectors, L2-normalised vectors) x 2 repeats -> mean and
    population std of every score."""
    e = table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("string"))
    encoders = {
        "raw": lambda d: ml.to_vector(d, "embedding"),
        "l2": lambda d: ml.to_vector(d.withColumn("_n", l2_normalise("embedding")), "_n"),
    }
    return ml.full_evaluation(e, "vec_id", "label", encoders, repeats=2)


@query("train_models")
def train_models(spark, sf_dir):
    """ML15 / ML16: priority and sentiment models and K-Means trained from the prepared
    tickets and saved; both classifiers are loaded again for train and test accuracy."""
    folder = f"{checkpoint_dir(spark)}/models/{uuid.uuid4().hex[:12]}"
    paths, splits = ml.train_and_save(ticket_prep(spark, sf_dir), "ticket_id", folder)
    scores = [ml.train_and_test_accuracy(ml.load_model(paths[label]), s.filter("split = 'train'"), s.filter("split = 'test'"), label)
              .select(F.lit(label).alias("model"), "*") for label, s in splits.items()]
    return scores[0].unionByName(scores[1])


@query("ticket_clusters", sql="""
SELECT 3::BIGINT AS n_clusters, count(*)::BIGINT AS n_texts FROM documents WHERE text IS NOT NULL""")
def ticket_clusters(spark, sf_dir):
    """ML16: K-Means on the TF-IDF vectors of all texts, saved, loaded and applied."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    paths, _ = ml.train_and_save(d, "doc_id", f"{checkpoint_dir(spark)}/models/{uuid.uuid4().hex[:12]}")
    c = ml.TextClusters.load(spark, paths["kmeans"]).transform(d.filter(F.col("text").isNotNull()))
    return c.agg(F.count_distinct("cluster").alias("n_clusters"), F.count(F.lit(1)).alias("n_texts"))


@query("model_roundtrip", sql="SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS n_same FROM embeddings")
def model_roundtrip(spark, sf_dir):
    """A fitted pipeline (label indexer + logistic regression + label decoder) is
    saved to the shared folder, loaded back, and must predict exactly as before."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IndexToString, StringIndexer

    e = _emb_vec(spark, sf_dir)
    idx = StringIndexer(inputCol="label", outputCol="label_idx", stringOrderType="alphabetAsc").fit(e)
    pipe = Pipeline(stages=[idx, ml.logistic_regression(e.count(), max_iter=100),
                            IndexToString(inputCol="prediction", outputCol="prediction_label", labels=idx.labels)])
    model = pipe.fit(e)
    path = os.path.join(checkpoint_dir(spark), "models", f"lr-{uuid.uuid4().hex[:12]}")
    ml.save_model(model, path)
    again = ml.load_model(path)
    a = model.transform(e).select("vec_id", F.col("prediction_label").alias("p1"))
    b = again.transform(e).select("vec_id", F.col("prediction_label").alias("p2"))
    return a.join(b, "vec_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p1") == F.col("p2")).alias("n_same"))


@query("standardised", sql="""
WITH l AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
s AS (SELECT pos, avg(x) AS m, stddev_samp(x) AS sd FROM l GROUP BY pos)
SELECT vec_id, pos, (x - m) / sd AS x FROM l JOIN s USING (pos)""")
def standardised(spark, sf_dir):
    """ML10: every component shifted and scaled to mean 0 and sample deviation 1."""
    out = ml.to_array(ml.standardize(_emb_vec(spark, sf_dir)), "scaled", "_a")
    return out.select("vec_id", F.posexplode("_a").alias("pos", "x"))


def _letter_counts():
    """An encoder that a test can recompute: counts of a few characters."""
    import numpy as np

    def encode(texts):
        return np.array([[len(t), t.count(" "), t.count("e"), t.count("a")] for t in texts], dtype=float).reshape(len(texts), 4)

    return encode


@query("encoded_texts", sql="""
SELECT conv_id, turn, [length(t)::DOUBLE, (length(t) - length(replace(t, ' ', '')))::DOUBLE,
                       (length(t) - length(replace(t, 'e', '')))::DOUBLE, (length(t) - length(replace(t, 'a', '')))::DOUBLE] AS embedding
FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)""")
def encoded_texts(spark, sf_dir):
    """ML11: texts encoded by a caller's function, built once per Python worker."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return ml.encode_in_pandas(c, "text", _letter_counts).select("conv_id", "turn", "embedding")


@query("evaluate_text_encoder")
def evaluate_text_encoder(spark, sf_dir):
    """ML11 + ML12: the built-in hashing encoder, fitted on all texts, and a one-vs-rest
    classifier of a document's language."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("label"))
    encoder = ml.hashing_encoder().fit(d)
    return ml.evaluate_classification(d, "doc_id", "label", encoder=encoder.transform, estimator=lambda n: ml.linear_ovr())


@query("predicted_defaults", sql="""
SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text) = '' THEN 'neutral' ELSE 'unknown' END AS sentiment,
  CASE WHEN text IS NULL OR text = '' THEN 'low'
       WHEN contains(lower(text), 'urgent') OR contains(lower(text), 'asap') OR contains(lower(text), 'critical') THEN 'high'
       WHEN contains(lower(text), 'how to') OR contains(lower(text), 'can you explain') THEN 'low' ELSE 'Low' END AS priority
FROM conversations""")
def predicted_defaults(spark, sf_dir):
    """what a turn is given when no model can be loaded."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return ml.predict_priority(ml.predict_sentiment(c, "text", None), "text", None).drop("text")


@query("prediction_sample", sql="""
SELECT doc_id AS id, lang AS y_true, CASE WHEN text IS NULL OR text = '' THEN 'low'
  WHEN contains(lower(text), 'urgent') OR contains(lower(text), 'asap') OR contains(lower(text), 'critical') THEN 'high'
  WHEN contains(lower(text), 'how to') OR contains(lower(text), 'can you explain') THEN 'low' ELSE 'Low' END AS y_pred
FROM documents ORDER BY doc_id LIMIT 200""")
def prediction_sample(spark, sf_dir):
    """The first 200 rows with their label and prediction (J10 by key)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    p = ml.predict_priority(d, "text", None)
    return kpi.first_n(ev.join_truth(d, p, "id", "lang", "priority"), "id", 200)
