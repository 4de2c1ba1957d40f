"""Benchmark: headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS].  Each query runs once to warm up, then $BENCH_REPEATS times; the
median wall time is reported.  Execution is forced with the ``noop`` sink, so the
whole plan runs and nothing is collected.  Prints ONE JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # KPI and log queries (events, lineitem)
    "kpi_overall", "kpi_by_day", "monitoring_report", "boxplot_lineitem", "latency_histogram",
    "recent_events", "log_filter",
    # preparation and text (documents)
    "ticket_prep", "hygiene_dedup", "tfidf_top_terms", "tfidf_weights", "overlength",
    # conversations
    "qa_pairs", "session_topic", "apply_answers", "apply_changes",
    # vectors
    "nearest_vector", "silhouette", "davies_bouldin",
    # retrieval joins (benchmark x documents, pages x pages)
    "faq_contains", "kb_two_field", "title_contains", "fuzzy_match", "intent_match",
    # models
    "kmeans_scores",
    # streaming
    "live_kpi",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from ticketlake.plans.registry import queries
    from ticketlake.session import get_session

    spark = get_session(f"local[{cpus}]", app="ticketlake-bench", conf={
        "spark.sql.shuffle.partitions": str(max(8, 2 * int(cpus))),
        "spark.driver.memory": "16g",
    })
    q = queries()
    names = only or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        def run():
            t0 = time.perf_counter()
            q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0
        first = run()  # warm-up
        # a query of over 20 s is timed once: its spread is small against its length
        times[name] = round(statistics.median(run() for _ in range(repeats if first < 20 else 1)), 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "sum of median wall time over headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
