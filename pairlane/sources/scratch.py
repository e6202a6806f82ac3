"""Folders for intermediate tables, all inside the shared folder that spark.checkpoint.dir names."""
from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=1)
def _one_process_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Unset, it is an error, except in local mode, where driver and executors are
    one process and a temporary folder is as shared as any."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return _one_process_folder()
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/pairlane-{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back, which ends its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
