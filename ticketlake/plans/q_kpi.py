"""Driver queries: KPIs, logs, distributions, top-n."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ticketlake.operators import kpi
from ticketlake.plans.registry import query
from ticketlake.session import checkpoint_dir
from ticketlake.sources.tables import interactions, table, test_results

# Interaction view over events, as SQL, shared by the oracles below.
_INTERACTIONS = """
  SELECT event_id, user_id, event_type AS intent_tag,
         event_type = 'purchase' AS thumbs_up, event_type = 'error' AS thumbs_down,
         event_type = 'signup' AS is_fallback, value AS response_time,
         CASE WHEN event_type = 'error' THEN 'error' END AS error_type, ts AS "timestamp"
  FROM events"""

_TEST_RESULTS = """
  SELECT event_id, user_id, event_type AS model, value AS execution_time,
         (CAST(json_extract_string(props, '$.k') AS BIGINT) % 2) = 0 AS correct, ts AS "timestamp"
  FROM events"""

_KPI_SELECT = """
  count(*)::BIGINT AS total_responses,
  (count(DISTINCT user_id) + max(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END))::BIGINT AS unique_users,
  coalesce(avg(response_time), 0)::DOUBLE AS avg_response_time,
  count(*) FILTER (WHERE coalesce(is_fallback, false))::BIGINT AS fallback_count,
  count(*) FILTER (WHERE coalesce(thumbs_up, false))::BIGINT AS thumbs_up,
  count(*) FILTER (WHERE coalesce(thumbs_down, false))::BIGINT AS thumbs_down,
  count(*) FILTER (WHERE error_type IS NOT NULL)::BIGINT AS error_count"""

_KPI_RATIOS = """
  *, coalesce(fallback_count::DOUBLE / nullif(total_responses, 0), 0) AS fallback_rate,
  coalesce((thumbs_up - thumbs_down)::DOUBLE / nullif(thumbs_up + thumbs_down, 0), 0) AS satisfaction"""


@query("kpi_overall", sql=f"""
SELECT {_KPI_RATIOS} FROM (SELECT {_KPI_SELECT} FROM ({_INTERACTIONS}) i) k""")
def kpi_overall(spark, sf_dir):
    return kpi.conversation_kpis(interactions(spark, sf_dir))


@query("kpi_by_day", sql=f"""
SELECT {_KPI_RATIOS} FROM (
  SELECT CAST("timestamp" AS DATE) AS day, {_KPI_SELECT} FROM ({_INTERACTIONS}) i GROUP BY 1) k""")
def kpi_by_day(spark, sf_dir):
    i = interactions(spark, sf_dir)
    return kpi.conversation_kpis(i, [F.to_date("timestamp").alias("day")])


@query("kpi_by_user_tag", sql=f"""
SELECT {_KPI_RATIOS} FROM (
  SELECT user_id AS group_user, intent_tag, {_KPI_SELECT} FROM ({_INTERACTIONS}) i GROUP BY 1, 2) k""")
def kpi_by_user_tag(spark, sf_dir):
    i = interactions(spark, sf_dir)
    return kpi.conversation_kpis(i, [F.col("user_id").alias("group_user"), "intent_tag"])


@query("monitoring_report", sql=f"""
SELECT *, CASE WHEN total_responses = 0 THEN 'No interactions logged yet.' ELSE
  printf('Total Responses: %d | Unique Users: %d | Avg. AI Response Time: %.3f seconds | '
         || 'Fallback Rate: %.2f%% | Satisfaction Score: %.2f | Total Errors: %d',
         total_responses, unique_users, avg_response_time, fallback_rate * 100, satisfaction,
         error_count) END AS report
FROM (SELECT {_KPI_RATIOS} FROM (SELECT {_KPI_SELECT} FROM ({_INTERACTIONS}) i) k) r""")
def monitoring_report(spark, sf_dir):
    return kpi.monitoring_report(interactions(spark, sf_dir))


@query("table_totals", sql="""
SELECT 'events' AS table_name, count(*)::BIGINT AS n FROM events
UNION ALL SELECT 'errors', count(*) FILTER (WHERE event_type = 'error')::BIGINT FROM events
UNION ALL SELECT 'conversations', count(*)::BIGINT FROM conversations
UNION ALL SELECT 'documents', count(*)::BIGINT FROM documents
UNION ALL SELECT 'benchmark', count(*)::BIGINT FROM benchmark
UNION ALL SELECT 'pages', count(*)::BIGINT FROM pages""")
def table_totals(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return kpi.table_totals({
        "events": ev,
        "errors": ev.filter(F.col("event_type") == "error"),
        "conversations": table(spark, sf_dir, "conversations"),
        "documents": table(spark, sf_dir, "documents"),
        "benchmark": table(spark, sf_dir, "benchmark"),
        "pages": table(spark, sf_dir, "pages"),
    })


@query("event_distribution", sql="""
SELECT event_type, count(*)::BIGINT AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1""")
def event_distribution(spark, sf_dir):
    return kpi.distribution(table(spark, sf_dir, "events"), "event_type")


@query("feedback_counts", sql=f"""
SELECT 'Thumbs Up' AS feedback, thumbs_up AS n FROM (SELECT {_KPI_SELECT} FROM ({_INTERACTIONS}) i) k
UNION ALL
SELECT 'Thumbs Down', thumbs_down FROM (SELECT {_KPI_SELECT} FROM ({_INTERACTIONS}) i) k""")
def feedback_counts(spark, sf_dir):
    return kpi.feedback_counts(kpi.conversation_kpis(interactions(spark, sf_dir)))


@query("log_filter", sql=f"""
SELECT * FROM ({_TEST_RESULTS}) t
WHERE regexp_matches(CAST(user_id AS VARCHAR), '(?i)^1')
  AND model = 'click'
  AND "timestamp" >= TIMESTAMP '2024-01-05 00:00:00'
  AND "timestamp" < TIMESTAMP '2024-01-11 00:00:00'""")
def log_filter(spark, sf_dir):
    return kpi.log_filter(test_results(spark, sf_dir), user_regex="^1", model="click",
                          day_from="2024-01-05", day_to="2024-01-10")


@query("recent_events", sql="""
SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_type = 'error'
ORDER BY ts DESC NULLS LAST, event_id LIMIT 50""")
def recent_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return kpi.most_recent(ev.select("event_id", "ts", "user_id", "event_type", "value"),
                           "ts", "event_id", 50)


@query("first_events", sql="""
SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 10""")
def first_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return kpi.first_n(ev, "event_id", 10)


@query("exec_stats_by_type", sql=f"""
SELECT model, count(*)::BIGINT AS n, avg(execution_time) AS avg_execution_time,
       avg(CAST(correct AS INTEGER))::DOUBLE AS accuracy
FROM ({_TEST_RESULTS}) t GROUP BY model""")
def exec_stats_by_type(spark, sf_dir):
    return kpi.exec_stats(test_results(spark, sf_dir))


@query("boxplot_by_type", sql=f"""
WITH t AS ({_TEST_RESULTS}),
q AS (SELECT model, quantile_cont(execution_time, 0.25::DOUBLE) AS q1,
             quantile_cont(execution_time, 0.5::DOUBLE) AS median,
             quantile_cont(execution_time, 0.75::DOUBLE) AS q3 FROM t GROUP BY model),
q2 AS (SELECT *, q3 - q1 AS iqr FROM q)
SELECT t.model, q1, median, q3, iqr,
  min(CASE WHEN execution_time >= q1 - 1.5 * iqr THEN execution_time END) AS whisker_low,
  max(CASE WHEN execution_time <= q3 + 1.5 * iqr THEN execution_time END) AS whisker_high,
  count(*) FILTER (WHERE execution_time < q1 - 1.5 * iqr OR execution_time > q3 + 1.5 * iqr)::BIGINT AS n_outliers,
  count(*)::BIGINT AS n
FROM t JOIN q2 USING (model) GROUP BY t.model, q1, median, q3, iqr""")
def boxplot_by_type(spark, sf_dir):
    return kpi.boxplot_stats(test_results(spark, sf_dir), "execution_time", "model")


@query("boxplot_lineitem", sql="""
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25::DOUBLE) AS q1,
             quantile_cont(l_extendedprice, 0.5::DOUBLE) AS median,
             quantile_cont(l_extendedprice, 0.75::DOUBLE) AS q3 FROM lineitem GROUP BY 1),
q2 AS (SELECT *, q3 - q1 AS iqr FROM q)
SELECT l.l_returnflag, q1, median, q3, iqr,
  min(CASE WHEN l_extendedprice >= q1 - 1.5 * iqr THEN l_extendedprice END) AS whisker_low,
  max(CASE WHEN l_extendedprice <= q3 + 1.5 * iqr THEN l_extendedprice END) AS whisker_high,
  count(*) FILTER (WHERE l_extendedprice < q1 - 1.5 * iqr OR l_extendedprice > q3 + 1.5 * iqr)::BIGINT AS n_outliers,
  count(*)::BIGINT AS n
FROM lineitem l JOIN q2 USING (l_returnflag) GROUP BY l.l_returnflag, q1, median, q3, iqr""")
def boxplot_lineitem(spark, sf_dir):
    return kpi.boxplot_stats(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag")


@query("latency_histogram", sql="""
WITH s AS (SELECT min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.5::DOUBLE) AS median FROM events),
b AS (SELECT CAST(CASE WHEN hi - lo = 0 THEN 0
              ELSE least(floor((value - lo) * 20 / (hi - lo)), 19) END AS INTEGER) AS bin
      FROM events, s)
SELECT bin, count(*)::BIGINT AS n, median,
       lo + bin * (hi - lo) / 20 AS bin_low, lo + (bin + 1) * (hi - lo) / 20 AS bin_high
FROM b, s GROUP BY bin, lo, hi, median""")
def latency_histogram(spark, sf_dir):
    return kpi.histogram(table(spark, sf_dir, "events"), "value", 20)


@query("distinct_models", sql=f"""
SELECT DISTINCT model FROM ({_TEST_RESULTS}) t WHERE execution_time > 100 AND model IS NOT NULL""")
def distinct_models(spark, sf_dir):
    t = test_results(spark, sf_dir).filter(F.col("execution_time") > 100)
    return kpi.distinct_sorted(t, "model")


@query("key_present", sql="""
SELECT event_type,
  count(*) FILTER (WHERE coalesce(list_contains(json_keys(props), 'k'), false))::BIGINT AS has_k,
  count(*) FILTER (WHERE coalesce(list_contains(json_keys(props), 'x'), false))::BIGINT AS has_x,
  count(*)::BIGINT AS n
FROM events GROUP BY event_type""")
def key_present(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.groupBy("event_type").agg(
        F.count_if(kpi.key_present(ev, "props", "k")).alias("has_k"),
        F.count_if(kpi.key_present(ev, "props", "x")).alias("has_x"),
        F.count(F.lit(1)).alias("n"),
    )


@query("equality_filters", sql=f"""
SELECT model, count(*)::BIGINT AS n, sum(execution_time) AS total_time
FROM ({_TEST_RESULTS}) t WHERE model IN ('signup', 'error') AND correct GROUP BY model""")
def equality_filters(spark, sf_dir):
    """Equality filters (event kind, model) before an aggregate; pushed to the scan."""
    t = test_results(spark, sf_dir)
    t = t.filter(F.col("model").isin("signup", "error") & F.col("correct"))
    return t.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("execution_time").alias("total_time"))


@query("log_view", sql="""
SELECT event_id, user_id, event_type, ts FROM events
WHERE regexp_matches(CAST(user_id AS VARCHAR), '(?i)1') AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'
ORDER BY ts DESC NULLS LAST, event_id LIMIT 400""")
def log_view(spark, sf_dir):
    """O2: the filtered log's newest 5,000 rows, and of those the 400 that are shown."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    found = kpi.log_filter(e, user_regex="1", day_from="2024-01-01", day_to="2024-01-31", ts_col="ts")
    return kpi.most_recent(kpi.most_recent(found, "ts", "event_id", 5000), "ts", "event_id", 400)


@query("model_results_newest_first", sql=f"""
SELECT event_id, model, execution_time, timestamp FROM ({_TEST_RESULTS}) t WHERE model = 'click'
ORDER BY timestamp DESC NULLS LAST, event_id""")
def model_results_newest_first(spark, sf_dir):
    """One model's test results, newest first (a range-partitioned global sort)."""
    t = kpi.log_filter(test_results(spark, sf_dir), model="click").select("event_id", "model", "execution_time", "timestamp")
    return t.orderBy(F.col("timestamp").desc_nulls_last(), "event_id")


@query("boxplot_sketches", sql="""
SELECT event_type, count(value)::BIGINT AS n, true AS q1_close, true AS median_close, true AS q3_close FROM events GROUP BY event_type""")
def boxplot_sketches(spark, sf_dir):
    """A7 by sketches: one per kind and day, stored, read back and merged per kind.  The rank
    of each answer, counted in the rows, lies within 2 percent of the one asked for."""
    e = table(spark, sf_dir, "events")
    path = f"{checkpoint_dir(spark)}/io/sketches-{uuid.uuid4().hex[:12]}"
    kpi.quantile_sketches(e.withColumn("day", F.to_date("ts")), "value", ["event_type", "day"]).write.parquet(path)
    q = kpi.sketched_quantiles(spark.read.parquet(path), ["event_type"])
    ranks = e.join(q, "event_type").groupBy("event_type", "n").agg(*[
        F.avg((F.col("value") <= F.col(c)).cast("double")).alias(f"_{c}") for c in ("q0", "q1", "q2")])
    return ranks.select("event_type", "n", *[
        (F.abs(F.col(f"_{c}") - p) <= 0.02).alias(name) for c, p, name in (("q0", 0.25, "q1_close"), ("q1", 0.5, "median_close"), ("q2", 0.75, "q3_close"))])
