"""Folders for what a job has to write on its way."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the cluster (spark.checkpoint.dir); on this machine only where none is set and all runs in this process."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    return f"{base.rstrip('/')}/evalgrain-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a new folder there and read back, so that what follows neither repeats nor depends on the work before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
