"""Session settings and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every job relies on for its results; they do not size the cluster.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

#: Settings that only affect speed.
SPEED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small but costly partitions (wide windows) keep their tasks; large ones are not affected.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: A table up to this size may be dealt out to all cores before work on its texts.
SPREAD_BYTES = 64 << 20


def build_session(app: str = "airframe", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session carrying the settings above."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RESULT_CONF, **SPEED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the result-relevant settings to a session somebody else created."""
    for key, value in RESULT_CONF.items():
        spark.conf.set(key, value)
    return spark


def one_process(master: str) -> bool:
    """Whether driver and executors are one process, so that a local folder is shared by all of them."""
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """Folder visible to every executor: ``spark.checkpoint.dir`` when the cluster names one.

    Only a session whose executors are threads of this process (``local[...]``: tests, a laptop) may
    go without one; it gets a local folder. Any other master raises, so that a cluster never writes
    intermediate tables to a machine-local path.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not one_process(context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="airframe-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def spread(df: DataFrame) -> DataFrame:
    """Let row-wise heavy work use all cores when the input is one small file with few splits.

    Only inputs of at most ``SPREAD_BYTES`` are dealt out anew, whatever the number of cores; any larger one is left
    as it is.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if size > SPREAD_BYTES or df.rdd.getNumPartitions() >= cores else df.repartition(cores)
