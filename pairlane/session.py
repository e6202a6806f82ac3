"""Session defaults used by the bench, the tests and the check script."""
from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def get_spark(app: str = "pairlane", cpus: str | int = 8, partitions: int = 8, master: str | None = None, shared: str | None = None) -> SparkSession:
    """A session of the given master; without one, of as many local threads as `cpus`, with its own shared folder."""
    if master is None:
        master, shared = f"local[{cpus}]", shared or tempfile.mkdtemp(prefix="spark-")
    builder = SparkSession.builder.master(master).appName(app)
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = (builder
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
