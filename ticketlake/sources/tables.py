"""Scans of the given Parquet tables and the canonical views derived from them.

Every view is a lazy projection over ``spark.read.parquet``: Catalyst prunes the
columns a query does not use and pushes its filters into the Parquet scan
(``PushedFilters`` / ``ReadSchema`` in the plan).  Timestamps stay TIMESTAMP_NTZ
in batch work (no time-zone dependence); the streaming twins cast them (T25).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one table; callers' ``select`` / ``filter`` become the scan's
    ReadSchema and PushedFilters (the reference's find(filter, projection))."""
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# --------------------------------------------------------------------------------------
# Field mapping of the driver queries (FIXTURES.md §2):
#   interactions.user_id / response_time / timestamp  <- events.user_id / value / ts
#   thumbs_up, thumbs_down, is_fallback               <- event_type = purchase / error / signup
#   errors                                            <- event_type = error
#   test_results.model / execution_time / correct     <- event_type / value / props.k % 2 = 0
# --------------------------------------------------------------------------------------

def props_k() -> Column:
    """The integer ``k`` of the ``props`` JSON document, null when absent or not a number."""
    return F.get_json_object("props", "$.k").try_cast("bigint")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interaction log (services' monitoring schema) over ``events``."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id"),
        F.col("user_id"),
        F.col("event_type").alias("intent_tag"),
        (F.col("event_type") == "purchase").alias("thumbs_up"),
        (F.col("event_type") == "error").alias("thumbs_down"),
        (F.col("event_type") == "signup").alias("is_fallback"),
        F.col("value").alias("response_time"),
        F.when(F.col("event_type") == "error", F.lit("error")).alias("error_type"),
        F.col("ts").alias("timestamp"),
    )


def test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution log (model, execution_time, correct) over ``events``."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id"),
        F.col("user_id"),
        F.col("event_type").alias("model"),
        F.col("value").alias("execution_time"),
        (F.pmod(props_k(), F.lit(2)) == 0).alias("correct"),
        F.col("ts").alias("timestamp"),
    )


def next_row(df: DataFrame, key: str, order_col: str, cols: list[str], block: int = 1024) -> DataFrame:
    """``lead`` of ``cols`` over ``key`` ordered by ``order_col`` (an integer), without
    one window partition per key: rows are windowed per (key, order // block), and the
    last row of a block takes the first row of the key's next non-empty block, found by
    a window over the per-block heads (block-count rows per key).  A key holding a
    third of all rows is spread over tasks."""
    from pyspark.sql import Window

    d = df.withColumn("_blk", F.floor(F.col(order_col) / block))
    w = Window.partitionBy(key, "_blk").orderBy(order_col)
    inner = d.select("*", *[F.lead(c).over(w).alias(f"_next_{c}") for c in [order_col] + cols])
    heads = d.groupBy(key, "_blk").agg(F.min_by(F.struct(order_col, *cols), F.col(order_col)).alias("_h"))
    wb = Window.partitionBy(key).orderBy("_blk")
    nxt = heads.select(key, "_blk", F.lead("_h").over(wb).alias("_nh"))
    j = inner.join(nxt, [key, "_blk"], "left")
    out = j.select(*df.columns, *[
        F.when(F.col(f"_next_{order_col}").isNotNull(), F.col(f"_next_{c}")).otherwise(F.col("_nh")[c])
        .alias(f"next_{c}") for c in [order_col] + cols])
    return out


def qa_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older role-row conversations turned into question/answer messages (P9 adapter).

    A user turn is a question; its answer is the next turn when that turn's role is
    ``assistant`` (else null = still pending).  System turns are dropped.  The next
    turn comes from ``next_row`` (a blocked lead), so one long conversation never
    becomes a single task's window partition.
    """
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") != "system")
    n = next_row(conv.select("conv_id", "turn", "role", "text"), "conv_id", "turn", ["role", "text"])
    return (
        n.filter(F.col("role") == "user")
        .select(
            F.col("conv_id").alias("session_id"),
            F.col("turn").alias("msg_pos"),
            F.col("text").alias("question"),
            F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("answer"),
            F.when(F.col("next_role") == "assistant", F.col("next_turn")).alias("answer_turn"),
        )
    )
