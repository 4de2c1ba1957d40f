"""KPI, log and distribution operators.

All of them are one declarative aggregate: Spark computes partial aggregates in each
map task (HashAggregate partial -> Exchange -> HashAggregate final), so the shuffle
carries one row per group per task, whatever the input size.  Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.functions.scalar import safe_ratio
from ticketlake.operators.quantiles import exact_quantiles


def _flag(c: str) -> Column:
    # A null / missing flag counts as false.
    return F.coalesce(F.col(c).cast("boolean"), F.lit(False))


def unique_users(user_col: str = "user_id", null_is_user: bool = True) -> Column:
    """``$addToSet`` + ``len`` counts an explicit null as one more user."""
    n = F.count_distinct(F.col(user_col))
    if null_is_user:
        n = n + F.max(F.col(user_col).isNull().cast("int")).cast("bigint")
    return n.cast("bigint")


def conversation_kpis(
    df: DataFrame,
    keys: Sequence[str | Column] = (),
    *,
    tag_col: str = "intent_tag",
    count_null_tag: bool = True,
    null_is_user: bool = True,
    with_errors: bool = True,
) -> DataFrame:
    """A3 / A4: responses, unique users, mean response time, fallback and thumbs counts,
    fallback rate, satisfaction (up - down) / (up + down) (0 without feedback).

    ``count_null_tag`` (T4): the reference's ``$exists`` counts a message whose tag is
    null; with False only non-null tags count.  ``response_time`` is seconds (B5).
    """
    if not count_null_tag:
        df = df.filter(F.col(tag_col).isNotNull())
    up = F.count_if(_flag("thumbs_up"))
    down = F.count_if(_flag("thumbs_down"))
    fb = F.count_if(_flag("is_fallback"))
    aggs = [
        F.count(F.lit(1)).alias("total_responses"),
        unique_users("user_id", null_is_user).alias("unique_users"),
        F.coalesce(F.avg("response_time"), F.lit(0.0)).alias("avg_response_time"),
        fb.alias("fallback_count"),
        up.alias("thumbs_up"),
        down.alias("thumbs_down"),
    ]
    if with_errors:
        aggs.append(F.count_if(F.col("error_type").isNotNull()).alias("error_count"))
    g = df.groupBy(*keys) if keys else df.groupBy()
    out = g.agg(*aggs)
    return out.withColumns({
        "fallback_rate": safe_ratio("fallback_count", "total_responses"),
        "satisfaction": safe_ratio(F.col("thumbs_up") - F.col("thumbs_down"),
                                   F.col("thumbs_up") + F.col("thumbs_down")),
    })


def monitoring_report(interactions: DataFrame) -> DataFrame:
    """A4 as a one-row table with a rendered text report; 'No interactions logged yet.'
    when there is no response row (the aggregate without keys always yields one row)."""
    k = conversation_kpis(interactions, with_errors=True)
    text = F.when(
        F.col("total_responses") == 0, F.lit("No interactions logged yet.")
    ).otherwise(F.format_string(
        "Total Responses: %d | Unique Users: %d | Avg. AI Response Time: %.3f seconds | "
        "Fallback Rate: %.2f%% | Satisfaction Score: %.2f | Total Errors: %d",
        "total_responses", "unique_users", "avg_response_time",
        F.col("fallback_rate") * 100, "satisfaction", "error_count"))
    return k.withColumn("report", text)


def table_totals(named: dict[str, DataFrame]) -> DataFrame:
    """A1: one row per table with its row count (a union of global counts)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
             for name, df in named.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distribution(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """A2: value counts of one column, missing values left out (``$exists``)."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))


def exec_stats(df: DataFrame, model_col: str = "model") -> DataFrame:
    """Mean execution time and accuracy (mean of the bool) per model."""
    return df.groupBy(model_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("execution_time").alias("avg_execution_time"),
        F.avg(F.col("correct").cast("int")).alias("accuracy"),
    )


def boxplot_stats(df: DataFrame, value_col: str, group_col: str) -> DataFrame:
    """q1, median, q3 (linear interpolation, exact), whiskers at the furthest points
    inside 1.5 IQR, and the outlier count, per group.

    Exact quantiles by bucket selection (``operators.quantiles``: no group is gathered
    in one task), then a join back to the rows for whiskers and outliers.  The per-group table holds one row per group,
    so the join is a broadcast hash join when AQE measures it small.
    """
    q = exact_quantiles(df, value_col, [group_col], [0.25, 0.5, 0.75]).select(
        group_col, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"),
    ).withColumn("iqr", F.col("q3") - F.col("q1"))
    lo = F.col("q1") - 1.5 * F.col("iqr")
    hi = F.col("q3") + 1.5 * F.col("iqr")
    v = F.col(value_col).cast("double")
    j = df.select(group_col, value_col).join(q, group_col)
    return j.groupBy(group_col, "q1", "median", "q3", "iqr").agg(
        F.min(F.when(v >= lo, v)).alias("whisker_low"),
        F.max(F.when(v <= hi, v)).alias("whisker_high"),
        F.count_if((v < lo) | (v > hi)).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"),
    )


KLL_K = 200  # size of a quantile sketch: normalised rank error about 1.65 % (Spark's default)


def quantile_sketches(df: DataFrame, value_col: str, keys: Sequence[str], k: int = KLL_K) -> DataFrame:
    """A7 at scale, by the caller's choice: one mergeable KLL sketch per key (model and day, say),
    with the number of values.  Null and NaN are in no sketch.  Stored as a table, the
    sketches answer for any range of keys without the rows (``sketched_quantiles``)."""
    v = F.col(value_col).cast("double")
    rows = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, keys: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(keys..., n, q0, q1, ... in the order of ``probs``) of the merged sketches of each key."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_s"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias(f"q{i}") for i, p in enumerate(probs)])


def histogram(df: DataFrame, value_col: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram over [min, max] (last bin closed) plus the median.

    min, max and median come from one scalar subquery (``DataFrame.scalar()``),
    referenced once in a projection, so Spark runs it once (one extra pass) and the bin
    expression stays inside codegen with no join.  Then one group-by on the bin.  A
    value equal to max falls in the last bin, as numpy does.  Null and NaN are in no bin
    and not in the median.
    """
    v = F.col(value_col).cast("double")
    df = df.filter(v.isNotNull() & ~F.isnan(v))
    med = exact_quantiles(df, value_col, [], [0.5]).select("q0")
    st = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).crossJoin(med) \
        .select(F.struct(F.col("lo"), F.col("hi"), F.col("q0").alias("med")).alias("s")).scalar()
    x = df.select(v.alias("_v"), st.alias("_st"))
    lo, hi = F.col("_st.lo"), F.col("_st.hi")
    width = hi - lo
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - lo) * bins / width), F.lit(bins - 1))).cast("int")
    h = x.select(b.alias("bin"), "_st").groupBy("bin", "_st").agg(F.count(F.lit(1)).alias("n"))
    w = F.col("_st.hi") - F.col("_st.lo")
    return h.select(
        "bin", "n", F.col("_st.med").alias("median"),
        (F.col("_st.lo") + F.col("bin") * w / bins).alias("bin_low"),
        (F.col("_st.lo") + (F.col("bin") + 1) * w / bins).alias("bin_high"),
    )


def log_filter(
    df: DataFrame,
    *,
    user_regex: str | None = None,
    user_col: str = "user_id",
    model: str | None = None,
    model_col: str = "model",
    day_from: str | None = None,
    day_to: str | None = None,
    ts_col: str = "timestamp",
) -> DataFrame:
    """P10: case-insensitive user pattern, exact model, inclusive day range.

    The day range is the half-open [day_from 00:00, day_to + 1 day) so the predicate
    is a plain comparison Parquet can push down (F14).
    """
    out = df
    if user_regex:
        out = out.filter(F.col(user_col).cast("string").rlike("(?i)" + user_regex))
    if model:
        out = out.filter(F.col(model_col) == model)
    if day_from:
        out = out.filter(F.col(ts_col) >= F.to_timestamp_ntz(F.lit(day_from)))
    if day_to:
        out = out.filter(F.col(ts_col) < F.to_timestamp_ntz(F.date_add(F.to_date(F.lit(day_to)), 1)))
    return out


def most_recent(df: DataFrame, sort_col: str, tie_col: str, n: int) -> DataFrame:
    """Newest n rows (nulls last, T9); a unique tie column keeps it exact.
    Planned as TakeOrderedAndProject: each task keeps its own top n, the driver merges
    n x tasks rows, never the table."""
    return df.orderBy(F.col(sort_col).desc_nulls_last(), F.col(tie_col).asc()).limit(n)


def first_n(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """First n in natural (seq) order."""
    return df.orderBy(F.col(order_col).asc()).limit(n)


def up_to_nth(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """The rows among which the first n are: those up to the n-th value of ``order_col`` (null
    first).  Only values meet in one task, so rows of any width can be cut down before they
    are sorted."""
    last = df.select(F.col(order_col).alias("_o")).orderBy("_o").limit(n).agg(F.max("_o")).scalar()
    return df.filter(F.col(order_col).isNull() | (F.col(order_col) <= last))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of one column (sorted on output)."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


def feedback_counts(kpis: DataFrame) -> DataFrame:
    """Thumbs up / down as two rows (an unpivot of the KPI row)."""
    return kpis.select(
        F.inline(F.array(
            F.struct(F.lit("Thumbs Up").alias("feedback"), F.col("thumbs_up").alias("n")),
            F.struct(F.lit("Thumbs Down").alias("feedback"), F.col("thumbs_down").alias("n")),
        ))
    )


def key_present(df: DataFrame, json_col: str, key: str) -> Column:
    """P12 / T4 on a JSON document: true when the key is present, even with a null value."""
    return F.coalesce(F.array_contains(F.json_object_keys(F.col(json_col)), F.lit(key)), F.lit(False))
