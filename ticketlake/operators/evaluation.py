"""Evaluation tables.

Truth and prediction are joined by key (J10), never zipped by position.  Everything
after the first ``groupBy(true, pred)`` is a table with at most k x k rows (k =
number of classes), kept as a DataFrame: no MulticlassMetrics RDD, no collect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.session import materialize

# ---- fixed values (must equal the reference's for right results) --------------------
ACCURACY_ROW, MACRO_ROW, WEIGHTED_ROW = "accuracy", "macro avg", "weighted avg"
# ---------------------------------------------------------------------------------------


def join_truth(truth: DataFrame, pred: DataFrame, key: str, true_col: str, pred_col: str) -> DataFrame:
    """(key, y_true, y_pred) by an equi join; both labels as strings."""
    t = truth.select(key, F.col(true_col).cast("string").alias("y_true"))
    p = pred.select(key, F.col(pred_col).cast("string").alias("y_pred"))
    return t.join(p, key)


def confusion_counts(yy: DataFrame) -> DataFrame:
    """(y_true, y_pred, n) for the pairs that occur: at most k x k rows, written once, so
    that every score below starts from them and the predictions are computed once.  A row
    without a true or a predicted label is in no score."""
    pairs = yy.filter("y_true is not null and y_pred is not null")
    return materialize(pairs.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n")))


def per_class(cc: DataFrame) -> DataFrame:
    """(label, tp, support, predicted) for every true or predicted label."""
    side = F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("tp"))))
    return cc.select(side.alias("s")).groupBy("s.label").agg(
        F.sum("s.tp").alias("tp"), F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"))


def classification_report(yy: DataFrame) -> DataFrame:
    """Rows per class (precision, recall, f1, support) plus the accuracy,
    macro-average and weighted-average rows, zero_division = 0 (T21)."""
    pc = per_class(confusion_counts(yy))

    def z(num, den):
        return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))

    cls = pc.select(
        "label",
        z(F.col("tp"), F.col("predicted")).alias("precision"),
        z(F.col("tp"), F.col("support")).alias("recall"),
        F.col("support").cast("bigint").alias("support"),
    ).withColumn("f1", z(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    tot = cls.agg(
        F.sum("support").alias("n"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        z(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
        z(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
        z(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"),
    )
    acc = pc.agg(z(F.sum("tp"), F.sum("support")).alias("acc"))
    summary = tot.join(acc, how="inner").select(F.inline(F.array(
        F.struct(F.lit(ACCURACY_ROW).alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"),
                 F.col("n").cast("bigint").alias("support")),
        F.struct(F.lit(MACRO_ROW).alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").cast("bigint").alias("support")),
        F.struct(F.lit(WEIGHTED_ROW).alias("label"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("n").cast("bigint").alias("support")),
    )))
    return cls.select("label", "precision", "recall", "f1", "support").unionByName(summary)


def summary_scores(yy: DataFrame) -> DataFrame:
    """One row: accuracy, weighted precision / recall / F1, macro F1."""
    r = classification_report(yy)
    return r.agg(
        F.max(F.when(F.col("label") == ACCURACY_ROW, F.col("f1"))).alias("accuracy"),
        F.max(F.when(F.col("label") == WEIGHTED_ROW, F.col("precision"))).alias("precision"),
        F.max(F.when(F.col("label") == WEIGHTED_ROW, F.col("recall"))).alias("recall"),
        F.max(F.when(F.col("label") == WEIGHTED_ROW, F.col("f1"))).alias("f1_score"),
        F.max(F.when(F.col("label") == MACRO_ROW, F.col("f1"))).alias("macro_f1"),
    )


def confusion_matrix(yy: DataFrame) -> DataFrame:
    """Every (true, predicted) pair of the label union, zeros filled, in long form:
    the k labels, each with the sorted array of all k, joined with the counts."""
    cc = confusion_counts(yy)
    labels = per_class(cc).select("label")
    every = labels.agg(F.sort_array(F.collect_set("label"))).scalar()
    grid = labels.select(F.col("label").alias("y_true"), F.explode(every).alias("y_pred"))
    return grid.join(cc, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """Balanced weights n / (k * n_c) per class."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    # n and k from the k-row class table, one scalar subquery referenced once
    st = c.agg(F.struct(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k")).alias("s")).scalar()
    return (c.withColumn("_st", st)
            .withColumn("weight", F.col("_st.n") / (F.col("_st.k") * F.col("n_c"))).drop("_st"))


def with_class_weights(df: DataFrame, label_col: str, weight_col: str = "weight") -> DataFrame:
    """A18 joined back as a ``weightCol`` (the class table has k rows)."""
    w = class_weights(df, label_col).select(label_col, F.col("weight").alias(weight_col))
    return df.join(w, label_col)


def metric_mean_std(metrics: DataFrame, keys: Sequence[str] = ("model", "task", "metric")) -> DataFrame:
    """Mean and population std (T15) of every metric over repeats."""
    return metrics.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                      F.count(F.lit(1)).alias("n_runs"))


def metrics_wide(metrics: DataFrame, names: Sequence[str], key: str = "model", name_col: str = "metric",
                 value_col: str = "mean") -> DataFrame:
    """Long metric table -> one row per model, one column per metric of ``names``."""
    return metrics.groupBy(key).pivot(name_col, list(names)).agg(F.first(value_col))


def first_k_per_class(df: DataFrame, id_col: str, class_col: Column, k_of_n, seed: int = 42,
                      n_buckets_hex: int = 3, flag: str = "_in") -> DataFrame:
    """Flag the k(n_c) rows of every class with the smallest md5(id:seed) (ties: id),
    where ``k_of_n`` maps the class size column to the wanted count.

    Skew-safe (a class may hold a third of all rows): rows are counted per (class,
    hash bucket) — 16^3 buckets by the leading hex digits — and a prefix sum over that
    small table finds, per class, the buckets wholly in, wholly out, and the one
    boundary bucket; only rows of the boundary bucket are ranked by a window, and that
    window's partition is ~n_c / 4096 rows."""
    h = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    rows = df.withColumns({"_cls": class_col, "_h": h,
                           "_b": F.conv(F.substring(h, 1, n_buckets_hex), 16, 10).cast("int")})
    counts = rows.groupBy("_cls", "_b").agg(F.count(F.lit(1)).alias("_n"))
    wc = Window.partitionBy("_cls").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = (counts.withColumn("_cum", F.sum("_n").over(wc))
              .withColumn("_nc", F.sum("_n").over(Window.partitionBy("_cls"))))
    counts = counts.select("_cls", "_b", (F.col("_cum") - F.col("_n")).alias("_before"),
                           k_of_n(F.col("_nc")).alias("_target"), "_cum")
    j = rows.join(counts, ["_cls", "_b"])
    boundary = (F.col("_before") < F.col("_target")) & (F.col("_cum") > F.col("_target"))
    rank = F.row_number().over(Window.partitionBy("_cls", "_b").orderBy("_h", id_col))
    inner = j.filter(boundary).withColumn(flag, (F.col("_before") + rank) <= F.col("_target"))
    outer = j.filter(~boundary).withColumn(flag, F.col("_cum") <= F.col("_target"))
    return inner.unionByName(outer).drop("_cls", "_h", "_b", "_before", "_target", "_cum")


def stratified_split(df: DataFrame, id_col: str, label_col: str, test_size: float = 0.2, seed: int = 42,
                     stratify: bool = True, n_buckets_hex: int = 3) -> DataFrame:
    """ML2 / W5: exact split: the ceil(test_size * n_c) rows of each class with the
    smallest md5(id:seed) (ties: id) go to 'test', the rest to 'train' (skew-safe, see
    ``first_k_per_class``; ``stratify=False`` uses one stratum)."""
    cls = F.col(label_col) if stratify else F.lit(0)
    out = first_k_per_class(df, id_col, cls, lambda n: F.ceil(n * test_size), seed, n_buckets_hex)
    return out.withColumn("split", F.when(F.col("_in"), F.lit("test")).otherwise(F.lit("train"))).drop("_in")
