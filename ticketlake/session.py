"""Session construction and cluster-facing settings.

On a cluster the session comes from the launcher; ``get_session`` only fills in what
is unset, so a cluster's own settings (shuffle partitions, checkpoint dir) win.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Settings every job of the library relies on.  AQE re-plans joins at run time
# (broadcast conversion from *measured* sizes, skew-join splitting, partition
# coalescing); ANSI stays on, so every cast in the library is a try_* form.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # files of a checkpoint go when no plan refers to it any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "ticketlake", conf: dict | None = None) -> SparkSession:
    """Return the active session, creating a local one (tests, bench) when none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = dict(DEFAULTS)
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (set by the cluster).  Only a local session may
    leave it unset: it gets a folder of this machine; on a cluster that is an error, as
    executors and driver would not see each other's files.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master}")
        base = os.environ.get("TICKETLAKE_LOCAL_CHECKPOINT", "/tmp/ticketlake-checkpoints")
        d = os.path.join(base, spark.sparkContext.applicationId)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


BROADCAST_ROWS = 100_000
# Spark's setting that removes a query's shuffle files when the query ends
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def measured(df, max_rows: int = BROADCAST_ROWS):
    """Write a result of short rows and, only if it has at most ``max_rows`` of them, hint
    that it be broadcast; beyond that the join shuffles as usual."""
    out = materialize(df)
    return F.broadcast(out) if out.count() <= max_rows else out


def materialize(df):
    """Cut the lineage of an intermediate result that later steps read more than once.

    A reliable ``checkpoint`` into the shared checkpoint folder: it survives executor
    loss (unlike a local checkpoint) and keeps the next plan small.  The shuffle files it
    took go as soon as it is written, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        own = df.select("*")  # a plan of its own: it is planned with the setting, ``df`` isn't
    finally:
        spark.conf.set(CLEANUP, before)
    return own.checkpoint(eager=True)


def release(*frames) -> None:
    """Delete the files of results of ``materialize`` that no later step reads, and collect the
    driver's garbage: plans that are gone hold further files."""
    for df in frames:
        spark = df.sparkSession
        where = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if where.isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(where.get())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if frames:
        frames[0].sparkSession._jvm.System.gc()
