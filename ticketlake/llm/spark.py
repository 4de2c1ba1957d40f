"""Session settings the operators of this package rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_ROWS = 512


def bounded_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows per Arrow batch: the rows here are whole documents, and
    the default of 10,000 of them would make batches of hundreds of MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def bounded_bytes(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Arrow batches of at most ``limit`` bytes, whatever their rows: few documents, or many
    rows of numbers (at 512 of these a batch the batches themselves would be the work)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def fresh(name: str, columns: list[str]) -> str:
    """``name``, or a longer one that none of ``columns`` has (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
