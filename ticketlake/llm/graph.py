"""Connected components of an edge table, entirely as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node reachable.

    Contraction: each node hooks onto its smallest neighbour, chains are shortened by one
    jump, edges are relabelled and those inside a group vanish; at least every node that
    isn't a local minimum goes, so the rounds are logarithmic.  Each round is cut with a
    reliable checkpoint.  The minimum is combined on the map side and the joins are plain
    equi joins, so a hub with a third of all edges is split by the skew-join rule.
    Self loops and null ends are ignored; an empty table has no components."""
    e = materialize(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    label = None
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up"))
                           .select(F.col("a").alias("node"), "up"))
        up = hook.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        jump = materialize(hook.join(up, "up").select("node", F.col("upper").alias("up")))
        if label is None:
            label = jump.select("node", F.col("up").alias("root"))
        else:
            step = jump.select(F.col("node").alias("root"), "up")
            label = label.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        label = materialize(label)
        left = jump.select(F.col("node").alias("a"), F.col("up").alias("x"))
        right = jump.select(F.col("node").alias("b"), F.col("up").alias("y"))
        e = materialize(
            e.join(left, "a").join(right, "b").where("x <> y")
            .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    if label is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return label
