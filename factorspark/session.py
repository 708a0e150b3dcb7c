"""Session settings and the shared folder used for durable intermediate data."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "factorspark", master: str | None = None, **settings: str) -> SparkSession:
    """Session with adaptive execution on, UTC time and any extra settings.

    Partition counts are left to adaptive execution: set
    ``spark.sql.shuffle.partitions`` high on a cluster and small partitions are
    merged at run time; skewed join partitions are split at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in {**base, **settings}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset (a
    local test session) is a local temporary folder made and registered.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        current = tempfile.mkdtemp(prefix="spark-factorspark-", dir="/tmp")
        context.setCheckpointDir(current)
        return current
    return current


def durable(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an intermediate table to the shared folder once and read it back.

    Used where a reduced table feeds several branches: the costly part runs once,
    survives lost executors, and the files' sizes let the optimizer choose joins.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/factorspark/{name}-{uuid.uuid4().hex}"
