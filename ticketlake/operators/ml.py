"""Machine-learning operators on ``pyspark.ml`` (ML1-ML16, F10, F18, S15).

Training is distributed by ``pyspark.ml`` itself (treeAggregate / L-BFGS); this
module only wires estimators to the reference's settings and to the evaluation
tables.  Loops over configurations (encoders x repeats) run on the driver at plan
level only: each iteration is its own set of Spark jobs, no data passes the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import (
    HashingTF, IDF, IndexToString, Normalizer, PCA, RegexTokenizer, StandardScaler, StringIndexer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlake.functions.scalar import keyword_priority, strip
from ticketlake.functions.text import TOKEN_PATTERN
from ticketlake.operators import evaluation as ev
from ticketlake.operators import softmax
from ticketlake.operators import vectors as vx
from ticketlake.operators.prep import label_filter
from ticketlake.operators.text import (
    BASELINE_MAX_FEATURES, BASELINE_MIN_DF, PRIORITY_MAX_FEATURES, PRIORITY_NGRAMS, TermTable, fit_tfidf, term_table, vectors,
)
from ticketlake.session import materialize

# ---- fixed values (must equal the reference's for right results) --------------------
SEED = 42
TEST_SIZE = 0.2
LR_C = 1.0
LR_TOL = 1e-4
LR_MAX_ITER = 1000
RF_TREES = 100
RF_DEPTH = 30  # Spark's own limit
SMOTE_NEIGHBOURS = 5
KMEANS_K = 3
FULL_EVALUATION_K = 8
BALANCED_MAX_ITER = 2000
PREDICTION_SAMPLE = 200
EMPTY_TEXT_SENTIMENT = "neutral"
FAILED_SENTIMENT, FAILED_PRIORITY = "unknown", "Low"
# ---------------------------------------------------------------------------------------

OVR_PARALLELISM = 4  # classes fitted at the same time; each is a job of its own
ROWS_PER_TASK = 200_000  # of vectors that a trainer reads again and again


def to_vector(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    """array<float|double> -> ml Vector (and ``vector_to_array`` for the way back)."""
    return df.withColumn(out, array_to_vector(F.col(array_col)))


def to_array(df: DataFrame, vec_col: str, out: str) -> DataFrame:
    return df.withColumn(out, vector_to_array(F.col(vec_col)))


def spread(df: DataFrame) -> DataFrame:
    """Rows that a trainer reads in every job, written once and dealt evenly over all cores:
    texts come in a few large partitions, and each would be one task of every job."""
    written = materialize(df)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-written.count() // ROWS_PER_TASK))
    return materialize(written.repartition(tasks))


def logistic_regression(n_train: int, *, C: float = LR_C, max_iter: int = LR_MAX_ITER, weight_col: str | None = None,
                        features: str = "features", label: str = "label_idx") -> LogisticRegression:
    """ML3 with T20: the reference's penalty C on unscaled features equals Spark's
    regParam = 1 / (C * n) with standardization off and a pure L2 penalty."""
    lr = LogisticRegression(featuresCol=features, labelCol=label, family="multinomial", maxIter=max_iter,
                            tol=LR_TOL,
                            regParam=1.0 / (C * max(n_train, 1)), elasticNetParam=0.0, standardization=False)
    if weight_col:
        lr.setWeightCol(weight_col)
    return lr


def linear_ovr(*, features: str = "features", label: str = "label_idx", weight_col: str | None = None) -> OneVsRest:
    """ML4: one-vs-rest linear classifiers with log loss (SGD in the reference; same
    objective, another optimiser)."""
    base = LogisticRegression(featuresCol=features, labelCol=label, regParam=1e-4, maxIter=1000)
    ovr = OneVsRest(classifier=base, featuresCol=features, labelCol=label, parallelism=OVR_PARALLELISM)
    if weight_col:
        ovr.setWeightCol(weight_col)
    return ovr


def random_forest(*, features: str = "features", label: str = "label_idx", weight_col: str | None = None,
                  trees: int = RF_TREES, max_depth: int = RF_DEPTH) -> RandomForestClassifier:
    """ML5: random forest, balanced weights through ``weightCol``, seed 42; trees as deep
    as Spark lets them grow (the reference sets no limit)."""
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, maxDepth=max_depth,
                                featureSubsetStrategy="sqrt", seed=SEED)
    if weight_col:
        rf.setWeightCol(weight_col)
    return rf


def fit_predict(train: DataFrame, test: DataFrame, estimator_factory: Callable[[int], object], *,
                label_col: str = "label", features: str = "features", balanced: bool = False) -> DataFrame:
    """Index labels, fit on ``train`` (with class weights if ``balanced``), predict ``test``;
    returns test rows with ``y_true`` and ``y_pred`` as strings (ML6 / IndexToString)."""
    indexer = StringIndexer(inputCol=label_col, outputCol="label_idx", handleInvalid="keep",
                            stringOrderType="alphabetAsc").fit(train)
    tr = indexer.transform(train)
    estimator = estimator_factory(tr.count())
    if balanced:
        tr = ev.with_class_weights(tr, label_col, "weight")
        estimator.setWeightCol("weight")
    model = estimator.fit(tr)
    pred = model.transform(indexer.transform(test))
    back = IndexToString(inputCol="prediction", outputCol="y_pred", labels=indexer.labels)
    return back.transform(pred).withColumn("y_true", F.col(label_col).cast("string"))


# ======================================================================================
# Clustering, projection, scaling
# ======================================================================================

def kmeans(df: DataFrame, k: int, *, features: str = "features", seed: int = SEED) -> DataFrame:
    """ML7: K-Means (k-means||), adds ``cluster``."""
    return KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df).transform(df)


def pca_centered(df: DataFrame, k: int, *, features: str = "features", out: str = "pca") -> tuple[DataFrame, list]:
    """ML8 / T19: PCA on centred vectors (Spark's PCA does not centre the projection).
    Returns the projected frame and the explained-variance ratios (k numbers)."""
    centred = StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="_centred").fit(df)
    c = centred.transform(df)
    model = PCA(k=k, inputCol="_centred", outputCol=out).fit(c)
    return model.transform(c).drop("_centred"), list(model.explainedVariance.toArray())


def standardize(df: DataFrame, *, features: str = "features", out: str = "scaled",
                with_mean: bool = True, with_std: bool = True) -> DataFrame:
    """ML10: Spark scales by the sample std; the reference by the population std —
    the two differ by the constant factor sqrt(n / (n - 1))."""
    return StandardScaler(withMean=with_mean, withStd=with_std, inputCol=features, outputCol=out).fit(df).transform(df)


# ======================================================================================
# SMOTE (ML9)
# ======================================================================================

def smote(df: DataFrame, id_col: str, label_col: str, vec: str, *, k: int = SMOTE_NEIGHBOURS,
          seed: int = SEED) -> DataFrame:
    """ML9: raise every class to the majority size with synthetic points a + u (b - a),
    b one of a's k nearest same-class neighbours.  Originals are kept; synthetic rows
    get ``synthetic = true``.  Neighbour choice and u come from hashes of (id, copy,
    seed), so the output is deterministic and identical on re-runs.

    Copies are spread over a class: n_needed // n_c copies each plus one more for the
    first n_needed % n_c points by hash rank (exact class sizes, no class-wide window)."""
    counts = materialize(df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nc")))
    alone = [r[0] for r in counts.filter("_nc = 1").select(label_col).limit(5).collect()]
    if alone and not counts.filter("_nc > 1").isEmpty():
        raise ValueError(f"a class of one row has no neighbour to interpolate with: {alone}")
    n_max = counts.agg(F.max("_nc")).scalar()
    nb = vx.knn_same_class(df, id_col, label_col, vec, k)
    nbv = df.select(F.col(id_col).alias("nb_id"), F.col(vec).alias("_nbv"))
    nb = nb.join(nbv, "nb_id").select(id_col, "nb_rank", "_nbv")
    n_nb = nb.groupBy(id_col).agg(F.count(F.lit(1)).alias("_nnb"))
    # the first (need % n_c) points of each class (by hash rank, skew-safe) get one
    # copy more than the others
    extra = ev.first_k_per_class(df.join(counts, label_col), id_col, F.col(label_col),
                                 lambda n: F.pmod(n_max - n, n),
                                 seed, flag="_extra")
    base = (extra.join(n_nb, id_col)
            .withColumn("_need", n_max - F.col("_nc"))
            .withColumn("_copies", F.floor(F.col("_need") / F.col("_nc"))
                        + F.when(F.col("_extra"), 1).otherwise(0)))
    rep = base.filter(F.col("_copies") > 0).select(
        id_col, label_col, vec, "_nnb", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_j"))
    rep = rep.withColumn("nb_rank", (F.pmod(F.xxhash64(id_col, "_j", F.lit(seed)), F.col("_nnb")) + 1).cast("int"))
    rep = rep.withColumn("_u", F.pmod(F.xxhash64(id_col, "_j", F.lit(seed + 1)), F.lit(1_000_000)) / 1_000_000.0)
    syn = rep.join(nb, [id_col, "nb_rank"]).select(
        F.concat(F.col(id_col).cast("string"), F.lit("#"), F.col("_j").cast("string")).alias("sample_id"),
        label_col,
        F.zip_with(vec, "_nbv", lambda a, b: a.cast("double") + F.col("_u") * (b.cast("double") - a.cast("double")))
        .alias(vec),
        F.lit(True).alias("synthetic"))
    orig = df.select(F.col(id_col).cast("string").alias("sample_id"), label_col,
                     F.transform(vec, lambda x: x.cast("double")).alias(vec), F.lit(False).alias("synthetic"))
    return orig.unionByName(syn)


# ======================================================================================
# Encoders (ML11) and priority / sentiment prediction (F8, F10, ML6)
# ======================================================================================

def hashing_encoder(text_col: str = "text", out: str = "features", dim: int = 1 << 12) -> Pipeline:
    """The built-in deterministic encoder: tokens -> HashingTF -> IDF -> L2."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=TOKEN_PATTERN, gaps=False),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(p=2.0, inputCol="_idf", outputCol=out),
    ])


def encode_in_pandas(df: DataFrame, text_col: str, factory: Callable[[], Callable[[list[str]], np.ndarray]],
                     out: str = "embedding") -> DataFrame:
    """ML11 plug-in: ``factory()`` builds an encoder once per Python worker; it maps a
    list of texts to a 2-D array.  Runs in Arrow batches via ``mapInPandas``; a failing
    batch gives null vectors (B14), never zero vectors."""
    out_schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = factory()
        for pdf in batches:
            try:
                mat = np.asarray(enc(pdf[text_col].fillna("").tolist()), dtype=np.float64)
                pdf[out] = list(mat)
            except Exception:  # encoder failure -> null vector, counted downstream
                pdf[out] = None
            yield pdf

    return df.mapInPandas(run, out_schema)


def predict_priority(df: DataFrame, text_col: str, model: PipelineModel | None, *,
                     pred_col: str = "prediction_label") -> DataFrame:
    """F8 + ML6: keyword rules first; the model only scores the rows no rule decided
    (lower-cased prediction); no model -> 'Low' (F10 failure default)."""
    ruled = df.withColumn("_rule", keyword_priority(text_col))
    rest = ruled.filter(F.col("_rule").isNull())
    done = ruled.filter(F.col("_rule").isNotNull()).withColumn("priority", F.col("_rule"))
    if model is None:
        rest = rest.withColumn("priority", F.lit(FAILED_PRIORITY))
    else:
        scored = model.transform(rest.withColumnRenamed(text_col, "text") if text_col != "text" else rest)
        if text_col != "text":
            scored = scored.withColumnRenamed("text", text_col)
        rest = scored.withColumn("priority", F.lower(F.coalesce(F.col(pred_col), F.lit(FAILED_PRIORITY))))
        rest = rest.select(*ruled.columns, "priority")
    return done.unionByName(rest).drop("_rule")


def predict_sentiment(df: DataFrame, text_col: str, model: PipelineModel | None, *,
                      pred_col: str = "prediction_label") -> DataFrame:
    """empty text -> 'neutral'; model failure / no model -> 'unknown'."""
    empty = strip(F.coalesce(F.col(text_col), F.lit(""))) == ""
    e = df.filter(empty).withColumn("sentiment", F.lit(EMPTY_TEXT_SENTIMENT))
    rest = df.filter(~empty)
    if model is None:
        rest = rest.withColumn("sentiment", F.lit(FAILED_SENTIMENT))
    else:
        rest = model.transform(rest).withColumn("sentiment", F.coalesce(F.col(pred_col), F.lit(FAILED_SENTIMENT)))
        rest = rest.select(*df.columns, "sentiment")
    return e.unionByName(rest)


def train_text_classifier(df: DataFrame, label_col: str, *, text_col: str = "text", kind: str = "lr",
                          max_features: int | None = None, min_df: float = 1.0, ngrams: int = 1,
                          balanced: bool = False) -> PipelineModel:
    """ML16 building block: TF-IDF (smooth IDF) + classifier + label decoding as one
    PipelineModel (saved / loaded with ``save_model`` / ``load_model``, S15)."""
    feats = fit_tfidf(df, text_col, "features", max_features=max_features, min_df=min_df, ngrams=ngrams)
    indexer = StringIndexer(inputCol=label_col, outputCol="label_idx", stringOrderType="alphabetAsc").fit(df)
    x = indexer.transform(feats.transform(df))
    w = "weight" if balanced else None
    if balanced:
        x = ev.with_class_weights(x, label_col, w)
    x = x.select("features", "label_idx", *([w] if balanced else []))
    # a forest's task holds the counts of all nodes of a job, so more tasks cost more than they save
    x = materialize(x) if kind == "rf" else spread(x)
    if kind == "lr":
        size = x.first()["features"].size
        clf = softmax.fit(x, size, len(indexer.labels), reg=1.0 / (LR_C * max(x.count(), 1)), tol=LR_TOL, max_iter=LR_MAX_ITER, weight_col=w)
    else:
        clf = {"ovr": linear_ovr, "rf": random_forest}[kind](weight_col=w).fit(x)
    back = IndexToString(inputCol="prediction", outputCol="prediction_label", labels=indexer.labels)
    return PipelineModel(stages=list(feats.stages) + [clf, back])


def baseline_classifier(df: DataFrame, label_col: str, *, text_col: str = "text") -> PipelineModel:
    """ML4 with the reference's settings: TF-IDF of at most 20,000 terms that two documents
    have, balanced one-vs-rest linear classifiers."""
    return train_text_classifier(df, label_col, text_col=text_col, kind="ovr", max_features=BASELINE_MAX_FEATURES,
                                 min_df=BASELINE_MIN_DF, balanced=True)


def priority_classifier(df: DataFrame, label_col: str = "priority", *, text_col: str = "text") -> PipelineModel:
    """ML5 with the reference's settings: TF-IDF of 5,000 uni- and bigrams, balanced forest."""
    return train_text_classifier(df, label_col, text_col=text_col, kind="rf", max_features=PRIORITY_MAX_FEATURES,
                                 ngrams=PRIORITY_NGRAMS, balanced=True)


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline (overwrite)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ======================================================================================
# Evaluation pipelines (ML12-ML15)
# ======================================================================================

Encoder = Callable[[DataFrame], DataFrame]


def _encoded(df: DataFrame, encoder: Encoder | None, keep: Sequence[str], features: str) -> tuple[DataFrame, float]:
    """``df`` with its ``features``, written once, and the seconds that took.  Without an
    encoder the vectors are there already."""
    if encoder is None:
        return df, 0.0
    begin = time.perf_counter()
    out = spread(encoder(df).select(*keep, features))
    return out, time.perf_counter() - begin


def evaluate_classification(df: DataFrame, id_col: str, label_col: str, features: str = "features", *,
                            encoder: Encoder | None = None, estimator: Callable[[int], object] | None = None,
                            test_size: float = TEST_SIZE, seed: int = SEED, C: float = LR_C,
                            max_iter: int = 1000, balanced: bool = False) -> DataFrame:
    """ML12: stratified exact split, blank and unknown labels dropped from both sides (P6),
    both encoded by ``encoder`` (a frame to the same frame with ``features``), a classifier
    fitted and the test side scored (A12).

    ``estimator`` maps the number of training rows to the classifier; logistic regression
    otherwise.  With ``balanced`` either is given the class weights (A18).  One row: accuracy, precision, recall, f1_score, macro_f1 and the seconds
    that encoding either side took."""
    labelled = label_filter(df.withColumn(label_col, strip(F.col(label_col).cast("string"))), label_col)
    s = ev.stratified_split(labelled, id_col, label_col, test_size, seed)
    train, train_sec = _encoded(s.filter("split = 'train'"), encoder, [id_col, label_col], features)
    test, test_sec = _encoded(s.filter("split = 'test'"), encoder, [id_col, label_col], features)
    factory = estimator or (lambda n: logistic_regression(n, C=C, max_iter=max_iter, features=features))
    pred = fit_predict(train, test, factory, label_col=label_col, features=features, balanced=balanced)
    return ev.summary_scores(pred.select("y_true", "y_pred")).withColumns({
        "embedding_train_time_sec": F.lit(train_sec), "embedding_test_time_sec": F.lit(test_sec)})


def evaluate_clustering(df: DataFrame, id_col: str, features_vec: str, array_col: str | None, k: int, *,
                        encoder: Encoder | None = None, seed: int = SEED, standardize_first: bool = False) -> DataFrame:
    """ML13: K-Means -> exact silhouette + Davies-Bouldin of the vectors that were
    clustered (the scaled ones with ``standardize_first``); one row, with the seconds that
    encoding took.  Without ``array_col`` the arrays are taken from the vectors."""
    df, seconds = _encoded(df, encoder, [id_col], features_vec)
    x = standardize(df, features=features_vec, out="_km_in") if standardize_first else \
        df.withColumn("_km_in", F.col(features_vec))
    clustered = kmeans(x, k, features="_km_in", seed=seed)
    own = F.col(array_col) if array_col and not standardize_first else vector_to_array(F.col("_km_in"))
    c = materialize(clustered.select(id_col, "cluster", own.alias("_km_vec")))  # both scores read it
    sil = vx.silhouette(c, id_col, "cluster", "_km_vec")
    db = vx.davies_bouldin(c, id_col, "cluster", "_km_vec")
    return sil.join(db.drop("n_clusters"), how="inner").withColumn("embedding_time_sec", F.lit(seconds))


CLASSIFICATION_METRICS = ["accuracy", "precision", "recall", "f1_score", "embedding_train_time_sec", "embedding_test_time_sec"]
CLUSTERING_METRICS = ["silhouette", "embedding_time_sec"]


def full_evaluation(df: DataFrame, id_col: str, label_col: str, encoders: dict[str, Encoder],
                    repeats: int = 2, seeds: Sequence[int] | None = None, k: int = FULL_EVALUATION_K,
                    estimator: Callable[[int], object] | None = None) -> DataFrame:
    """ML14: every encoder x repeat -> classification and clustering scores with their
    encoding times as one long metric table -> mean and population std per (model, task,
    metric).  ``encoders`` map a frame to the same frame with a ``features`` vector."""
    seeds = list(seeds or [SEED + r for r in range(repeats)])

    def rows(scores: DataFrame, model: str, run: int, task: str, metrics: Sequence[str]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return materialize(scores.select(F.lit(model).alias("model"), F.lit(run).alias("run"), F.lit(task).alias("task"), F.inline(each)))

    parts = []
    for name, encode in encoders.items():
        for r, sd in enumerate(seeds):
            cls = evaluate_classification(df, id_col, label_col, encoder=encode, estimator=estimator, seed=sd)
            parts.append(rows(cls, name, r, "classification", CLASSIFICATION_METRICS))
            clu = evaluate_clustering(df, id_col, "features", None, k, encoder=encode, seed=sd)
            parts.append(rows(clu, name, r, "clustering", CLUSTERING_METRICS))
    return ev.metric_mean_std(reduce(DataFrame.unionByName, parts))


class TextClusters:
    """ML16: K-Means on TF-IDF vectors over a dictionary of any size: terms and their weights
    stay a table (``term_table``), only the centres pass the driver."""

    def __init__(self, terms: TermTable, model: KMeansModel) -> None:
        self.terms, self.model = terms, model

    @staticmethod
    def _vectors(df: DataFrame, text_col: str, terms: TermTable) -> tuple[DataFrame, DataFrame]:
        """The rows, written with an own key as theirs may repeat, and their vectors."""
        keyed = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
        return keyed, vectors(keyed, "_row", text_col, terms)

    @staticmethod
    def fit(df: DataFrame, text_col: str = "text", *, k: int = KMEANS_K, seed: int = SEED) -> TextClusters:
        terms = term_table(df, text_col)
        x = spread(TextClusters._vectors(df.select(text_col), text_col, terms)[1].select("features"))
        return TextClusters(terms, KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(x))

    def transform(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """``df`` with the ``cluster`` of each row's text."""
        keyed, x = self._vectors(df, text_col, self.terms)
        return keyed.join(self.model.transform(x).select("_row", "cluster"), "_row").drop("_row")

    def save(self, path: str) -> None:
        self.terms.save(f"{path}/dictionary")
        self.model.write().overwrite().save(f"{path}/clusters")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextClusters:
        return TextClusters(TermTable.load(spark, f"{path}/dictionary"), KMeansModel.load(f"{path}/clusters"))


def train_and_save(df: DataFrame, id_col: str, folder: str, *, labels: Sequence[str] = ("priority", "sentiment"),
                   k: int = KMEANS_K, seed: int = SEED) -> tuple[dict[str, str], dict[str, DataFrame]]:
    """ML16: a text model for each of ``labels`` that the table has, and K-Means on the
    TF-IDF vectors of all its texts; each is saved under ``folder``, the last as ``TextClusters``.

    The models are trained on a plain 80 / 20 split (no strata, all terms, no weights).
    Returns the paths by model name, and for each label its rows with their split."""
    if "text" not in df.columns and "description" not in df.columns:
        raise ValueError(f"no text or description among {df.columns}")
    if "text" not in df.columns:
        df = df.withColumnRenamed("description", "text")
    df = materialize(df)
    paths, splits = {}, {}
    for label in labels:
        if label in df.columns:
            known = df.filter(F.col("text").isNotNull() & F.col(label).isNotNull())
            splits[label] = materialize(ev.stratified_split(known, id_col, label, TEST_SIZE, seed, stratify=False))
            model = train_text_classifier(splits[label].filter("split = 'train'"), label, kind="lr")
            paths[label] = f"{folder}/{label}"
            save_model(model, paths[label])
    paths["kmeans"] = f"{folder}/kmeans"
    TextClusters.fit(df.filter(F.col("text").isNotNull()), k=k, seed=seed).save(paths["kmeans"])
    return paths, splits


def train_and_test_accuracy(model: PipelineModel, train: DataFrame, test: DataFrame, label_col: str) -> DataFrame:
    """ML15: accuracy on both splits, one row."""
    def acc(d: DataFrame, name: str) -> DataFrame:
        p = model.transform(d)
        return p.agg(F.avg((F.col("prediction_label") == F.col(label_col).cast("string")).cast("double")).alias(name))

    return acc(train, "train_accuracy").join(acc(test, "test_accuracy"), how="inner")
