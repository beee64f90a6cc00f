"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Parts of a shuffle before AQE joins the small ones: with few, a task's share grows with the table.
LEAST_PARTS = 200
# A join on a hot case is split by AQE even when the next operator would have
# reused its partitioning: the extra shuffle then carries partial aggregates.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # What one task sorts, joins and aggregates is some twenty times its shuffled bytes.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.session.timeZone": "UTC",
    # Medians and value sets over millions of groups leave the hash map after 128 groups
    # anyway; sorting from the start is faster.
    "spark.sql.execution.useObjectHashAggregateExec": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings the plans rely on to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < LEAST_PARTS:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", LEAST_PARTS)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may go without it; there a temporary folder is shared
    by construction.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="strataform-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder.

    Cuts the lineage of frames that are read many times: later passes scan the files,
    also after executors are lost.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
