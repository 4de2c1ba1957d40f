"""Driver queries: text features and evaluation tables (step 7)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ticketlake.operators import evaluation as ev
from ticketlake.operators import text as tx
from ticketlake.plans.registry import query
from ticketlake.sources.files import labelled_dataset
from ticketlake.sources.tables import table

# Unicode word runs of 2+ characters: the DuckDB twin of Spark's (?U)\b\w\w+\b.
_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}')"

_DOC_TERMS = f"""
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) t
  GROUP BY doc_id, term"""

_DOC_TERMS_BI = f"""
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])))
           AS term
    FROM (SELECT doc_id, {_TOK} AS t FROM documents)) x
  GROUP BY doc_id, term"""

_YY = "SELECT doc_id, CAST(quality AS VARCHAR) AS y_true, CAST(toxic AS VARCHAR) AS y_pred FROM labels"


def _yy(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return ev.join_truth(lab, lab, "doc_id", "quality", "toxic")


@query("tfidf_top_terms", sql=f"""
SELECT term, sum(tf)::BIGINT AS n, count(*)::BIGINT AS df FROM ({_DOC_TERMS}) d
GROUP BY term HAVING count(*) >= 2 ORDER BY n DESC, term LIMIT 20000""")
def tfidf_top_terms(spark, sf_dir):
    """The 20,000 most frequent terms with document frequency >= 2."""
    terms = tx.doc_terms(table(spark, sf_dir, "documents"), "doc_id", "text")
    return tx.vocabulary(terms, "doc_id", max_features=tx.BASELINE_MAX_FEATURES, min_df=tx.BASELINE_MIN_DF)


@query("tfidf_top_bigrams", sql=f"""
SELECT term, sum(tf)::BIGINT AS n, count(*)::BIGINT AS df FROM ({_DOC_TERMS_BI}) d
GROUP BY term ORDER BY n DESC, term LIMIT 5000""")
def tfidf_top_bigrams(spark, sf_dir):
    """O6 with uni- and bigrams, 5,000 terms (the priority model's setting)."""
    terms = tx.doc_terms(table(spark, sf_dir, "documents"), "doc_id", "text", ngrams=2)
    return tx.vocabulary(terms, "doc_id", max_features=tx.PRIORITY_MAX_FEATURES)


@query("tfidf_weights", sql=f"""
WITH dt AS ({_DOC_TERMS}),
voc AS (SELECT term, count(*) AS df, sum(tf) AS n FROM dt GROUP BY term HAVING count(*) >= 2
        ORDER BY n DESC, term LIMIT 20000),
nd AS (SELECT count(*)::DOUBLE AS n FROM documents),
w AS (SELECT dt.doc_id, dt.term, dt.tf * (ln((1 + nd.n) / (1 + voc.df)) + 1) AS w
      FROM dt JOIN voc USING (term), nd),
nr AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY doc_id)
SELECT doc_id, term, w / nrm AS weight FROM w JOIN nr USING (doc_id)""")
def tfidf_weights(spark, sf_dir):
    """ML1: smooth-IDF TF-IDF weights, L2-normalised per document."""
    return tx.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text",
                    max_features=tx.BASELINE_MAX_FEATURES, min_df=tx.BASELINE_MIN_DF)


@query("term_dictionary", sql=f"""
WITH dt AS ({_DOC_TERMS})
SELECT term, (row_number() OVER (ORDER BY n DESC, term) - 1)::INT AS idx, n::BIGINT AS n, df::BIGINT AS df,
       ln((1 + (SELECT count(*) FROM documents)::DOUBLE) / (1 + df)) + 1 AS idf
FROM (SELECT term, count(*) AS df, sum(tf) AS n FROM dt GROUP BY term)""")
def term_dictionary(spark, sf_dir):
    """ML1: the whole vocabulary as a table, no term left out, numbered over sorted ranges."""
    return tx.term_table(table(spark, sf_dir, "documents"), "text").terms


@query("tfidf_vectors", sql=f"""
WITH dt AS ({_DOC_TERMS}),
voc AS (SELECT term, df, row_number() OVER (ORDER BY n DESC, term) - 1 AS idx
        FROM (SELECT term, count(*) AS df, sum(tf) AS n FROM dt GROUP BY term HAVING count(*) >= 2)),
nd AS (SELECT count(*)::DOUBLE AS n FROM documents),
w AS (SELECT doc_id, idx, tf * (ln((1 + nd.n) / (1 + df)) + 1) AS w FROM dt JOIN voc USING (term), nd WHERE idx < 300),
nr AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY doc_id)
SELECT doc_id, idx::INT AS idx, w / nrm AS weight FROM w JOIN nr USING (doc_id)""")
def tfidf_vectors(spark, sf_dir):
    """ML1: sparse vectors of the 300 most frequent terms in two documents or more,
    assembled by joins with the dictionary; here entry by entry."""
    d = table(spark, sf_dir, "documents")
    fitted = tx.term_table(d, "text", max_features=300, min_df=tx.BASELINE_MIN_DF)
    v = tx.vectors(d, "doc_id", "text", fitted)
    return v.select("doc_id", F.posexplode(vector_to_array("features")).alias("idx", "weight")).where("weight <> 0")


@query("confusion_matrix", sql=f"""
WITH yy AS ({_YY}),
l AS (SELECT y_true AS label FROM yy UNION SELECT y_pred FROM yy),
c AS (SELECT y_true, y_pred, count(*) AS n FROM yy GROUP BY ALL)
SELECT a.label AS y_true, b.label AS y_pred, coalesce(c.n, 0)::BIGINT AS n
FROM l a CROSS JOIN l b LEFT JOIN c ON c.y_true = a.label AND c.y_pred = b.label""")
def confusion_matrix(spark, sf_dir):
    """Quality (truth) vs toxic (prediction) on the labels table."""
    return ev.confusion_matrix(_yy(spark, sf_dir))


_REPORT_SQL = f"""
WITH yy AS ({_YY}),
l AS (SELECT y_true AS label FROM yy UNION SELECT y_pred FROM yy),
pc AS (SELECT l.label,
          (SELECT count(*) FROM yy WHERE y_true = l.label AND y_pred = l.label) AS tp,
          (SELECT count(*) FROM yy WHERE y_true = l.label) AS support,
          (SELECT count(*) FROM yy WHERE y_pred = l.label) AS predicted FROM l),
cls AS (SELECT label, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS precision,
               coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall, support::BIGINT AS support FROM pc),
cls2 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM cls),
tot AS (SELECT sum(support) AS n, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
               coalesce(sum(precision * support) / nullif(sum(support), 0), 0) AS wp,
               coalesce(sum(recall * support) / nullif(sum(support), 0), 0) AS wr,
               coalesce(sum(f1 * support) / nullif(sum(support), 0), 0) AS wf FROM cls2),
acc AS (SELECT coalesce(sum(tp)::DOUBLE / nullif(sum(support), 0), 0) AS acc FROM pc),
report AS (
  SELECT label, precision, recall, f1, support FROM cls2
  UNION ALL SELECT 'accuracy', NULL, NULL, acc, n::BIGINT FROM tot, acc
  UNION ALL SELECT 'macro avg', mp, mr, mf, n::BIGINT FROM tot
  UNION ALL SELECT 'weighted avg', wp, wr, wf, n::BIGINT FROM tot)"""


@query("classification_report", sql=_REPORT_SQL + " SELECT * FROM report")
def classification_report(spark, sf_dir):
    """Per-class and averaged precision / recall / F1 / support."""
    return ev.classification_report(_yy(spark, sf_dir))


@query("summary_scores", sql=_REPORT_SQL + """
SELECT max(CASE WHEN label = 'accuracy' THEN f1 END) AS accuracy,
       max(CASE WHEN label = 'weighted avg' THEN precision END) AS precision,
       max(CASE WHEN label = 'weighted avg' THEN recall END) AS recall,
       max(CASE WHEN label = 'weighted avg' THEN f1 END) AS f1_score,
       max(CASE WHEN label = 'macro avg' THEN f1 END) AS macro_f1 FROM report""")
def summary_scores(spark, sf_dir):
    """Accuracy and weighted scores in one row."""
    return ev.summary_scores(_yy(spark, sf_dir))


@query("class_weights", sql="""
SELECT label, count(*)::BIGINT AS n_c,
       (SELECT count(*) FROM embeddings)::DOUBLE / ((SELECT count(DISTINCT label) FROM embeddings) * count(*))
         AS weight
FROM embeddings GROUP BY label""")
def class_weights(spark, sf_dir):
    """Balanced class weights of the embedding labels."""
    return ev.class_weights(table(spark, sf_dir, "embeddings"), "label")


_METRICS_SQL = """
  SELECT CAST(ts AS DATE) AS run, event_type AS model, 'latency' AS task, 'mean_value' AS metric,
         avg(value) AS value FROM events GROUP BY 1, 2
  UNION ALL
  SELECT CAST(ts AS DATE), event_type, 'latency', 'max_value', max(value) FROM events GROUP BY 1, 2"""


def _metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.to_date("ts").alias("run"), F.col("event_type").alias("model"))
    a = g.agg(F.avg("value").alias("value")).withColumns({"task": F.lit("latency"), "metric": F.lit("mean_value")})
    b = g.agg(F.max("value").alias("value")).withColumns({"task": F.lit("latency"), "metric": F.lit("max_value")})
    return a.unionByName(b)


@query("metric_mean_std", sql=f"""
SELECT model, task, metric, avg(value) AS mean, stddev_pop(value) AS std, count(*)::BIGINT AS n_runs
FROM ({_METRICS_SQL}) m GROUP BY model, task, metric""")
def metric_mean_std(spark, sf_dir):
    """Daily runs as repeats: mean and population std of each metric per model."""
    return ev.metric_mean_std(_metrics(spark, sf_dir))


@query("metrics_wide", sql=f"""
SELECT model, avg(value) FILTER (WHERE metric = 'mean_value') AS mean_value,
       avg(value) FILTER (WHERE metric = 'max_value') AS max_value FROM ({_METRICS_SQL}) m GROUP BY model""")
def metrics_wide(spark, sf_dir):
    """The mean / std table pivoted to one row per model."""
    return ev.metrics_wide(ev.metric_mean_std(_metrics(spark, sf_dir)), ["mean_value", "max_value"])


@query("stratified_split", sql="""
SELECT doc_id, lang, CASE WHEN rn <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT doc_id, lang,
         row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) AS rn,
         count(*) OVER (PARTITION BY lang) AS n
  FROM documents)""")
def stratified_split(spark, sf_dir):
    """ML2 / W5: exact 80/20 split of the documents stratified by language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return ev.stratified_split(d, "doc_id", "lang", 0.2, 42)


# Class names for the embedding labels 0-7 (8 and 9 stay as their index string).
_CLASS_NAMES = [f"class_{i}" for i in range(8)]


@query("label_decode", sql=f"""
SELECT vec_id, CASE WHEN label >= 0 AND label < 8 THEN 'class_' || label ELSE CAST(label AS VARCHAR) END AS label
FROM embeddings""")
def label_decode(spark, sf_dir):
    """Class index -> class name when in range, else the index as text."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return labelled_dataset(e, "label", _CLASS_NAMES)
