"""Session helpers: time zone, checkpoint folder, salted joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR_KEY = "spark.checkpoint.dir"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every operator relies on: UTC clock and adaptive execution.

    Build the session with ``spark.python.sql.dataFrameDebugging.enabled`` set
    to false: recording the Python line of every column expression costs
    several driver round trips each, and cannot be switched off later.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Long texts make Arrow batches of a fixed number of rows unbounded.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local folder would lose the data with the machine.
    """
    context = spark.sparkContext
    configured = context.getConf().get(SHARED_DIR_KEY) or context.getCheckpointDir()
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {SHARED_DIR_KEY} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
