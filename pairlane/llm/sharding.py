"""Extendible hashing: rows to shards by hash prefix, splitting only buckets above a byte limit."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stage

BITS = 60
STEP = 10


def _keyed(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """Adds _h, 60 bits of an md5 over the key columns and the text, and _bytes, the UTF-8 length (null: 0)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in key] + [F.coalesce(F.col(text), F.lit(""))]
    return docs.withColumns({"_h": F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long"),
                             "_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")})


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Leaves of the directory: depth, prefix (the first `depth` bits as a number), n_rows, n_bytes.

    A bucket is split on its next bit only while it exceeds the limit and holds more than one row.  Ten bits are
    looked at per pass: sums for each prefix come from one aggregation of the rows of the still oversized
    buckets, and a later pass reads only those.  A bucket of one row above the limit, or of rows whose 60 bits
    all agree, cannot be split and stays oversized.
    """
    leaves, open_rows, base = None, rows.select("_h", "_bytes"), 0
    while True:
        deepest = min(base + STEP, BITS)
        cells = (open_rows.groupBy(F.shiftrightunsigned("_h", BITS - deepest).alias("cell"))
                 .agg(F.count("*").alias("n"), F.sum("_bytes").alias("b")))
        depths = cells.select("n", "b", "cell", F.explode(F.sequence(F.lit(base), F.lit(deepest))).alias("depth"))
        depths = depths.select("n", "b", "depth", F.expr(f"shiftrightunsigned(cell, {deepest} - depth)").alias("prefix"))
        sums = stage(depths.groupBy("depth", "prefix").agg(F.sum("n").alias("n_rows"), F.sum("b").alias("n_bytes")), "buckets")
        heavy = (F.col("n_bytes") > limit) & (F.col("n_rows") > 1)
        parents = sums.where(heavy).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_p"))
        reached = sums.withColumn("_p", F.shiftrightunsigned("prefix", 1)).join(parents, ["depth", "_p"], "left_semi").drop("_p")
        reached = reached.unionByName(sums.where(F.col("depth") == base)) if base == 0 else reached
        done = reached.where(~heavy | (F.col("depth") == BITS)) if deepest == BITS else reached.where(~heavy)
        leaves = done if leaves is None else leaves.unionByName(done)
        over = reached.where(heavy & (F.col("depth") == deepest)).select(F.col("prefix").alias("_p"))
        if deepest == BITS or over.isEmpty():
            return leaves.select("depth", "prefix", "n_rows", "n_bytes")
        open_rows = open_rows.withColumn("_p", F.shiftrightunsigned("_h", BITS - deepest)).join(over, "_p", "left_semi").drop("_p")
        base = deepest


def _located(rows: DataFrame, limit: int) -> DataFrame:
    """Rows with _h joined to their leaf.

    Leaves are disjoint, so a row finds its own by equality on the prefix at each depth that occurs (at most 61).
    """
    leaves = stage(directory(rows, limit), "directory").select(F.col("depth").alias("shard_depth"), F.col("prefix").alias("shard_prefix"), F.col("n_bytes").alias("shard_bytes"), (F.col("n_bytes") > limit).alias("shard_oversized"))
    used = sorted(r[0] for r in leaves.select("shard_depth").distinct().collect()) or [0]
    probes = F.array(*(F.struct(F.lit(d).alias("shard_depth"), F.shiftrightunsigned("_h", BITS - d).alias("shard_prefix")) for d in used))
    return rows.select("*", F.inline(probes)).join(leaves, ["shard_depth", "shard_prefix"])


def assign_shards(docs: DataFrame, limit: int, key: list[str], text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, shard_depth, shard_prefix, n_bytes, shard_bytes, shard_oversized.

    Native throughout; only key columns, hash and length travel, and no text.  Null text counts zero bytes, null
    keys hash as "~", equal rows share a shard, an empty table gives no rows, other columns are not read.
    """
    rows = _keyed(docs, key, text).select(*key, "_h", "_bytes")
    return _located(rows, limit).select(*key, "shard_depth", "shard_prefix", F.col("_bytes").alias("n_bytes"), "shard_bytes", "shard_oversized")


def write_shards(docs: DataFrame, limit: int, key: list[str], path: str, text: str = "text") -> None:
    """Write whole rows as Parquet, one folder a shard; each shard is written by one task, as it fits its limit."""
    whole = _located(_keyed(docs, key, text), limit).withColumn("shard", F.concat_ws("-", "shard_depth", "shard_prefix"))
    whole.select(*docs.columns, "shard").repartition("shard").write.partitionBy("shard").parquet(path)
