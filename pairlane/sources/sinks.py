"""Writers.  Existing output is never replaced: each write goes to its own version folder."""
from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F


def write_by_clip(df: DataFrame, path: str, key: str = "clip", fmt: str = "parquet", buckets: int = 0) -> str:
    """Partitioned by a bucket of the clip rather than by the clip itself when clips are many."""
    if buckets:
        df = df.withColumn("clip_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        key = "clip_bucket"
    df.write.mode("errorifexists").partitionBy(key).format(fmt).save(path)
    return path


def write_version(df: DataFrame, root: str, fmt: str = "parquet") -> str:
    """Next version next to the older ones: root/v=<time>."""
    path = f"{root}/v={time.time_ns()}"
    df.write.mode("errorifexists").format(fmt).save(path)
    return path


def summary_json(df: DataFrame, keys: list[str], out: str = "json") -> DataFrame:
    """One JSON document per key with the remaining columns nested under `values`."""
    vals = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*keys, F.struct(*vals).alias("values"))).alias(out))
