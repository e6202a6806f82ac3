"""Readers for the input formats.  Schemas are explicit; nothing is inferred from data."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairlane.operators.ordered import quantiles

DETECTIONS = ("clip string, frame int, track_id long, conf double, x1 double, y1 double, x2 double, y2 double")
CURATION = "video string, content string, setting string, source_group string, reviewed_by string, notes string, pair_ok string"
INTERVALS = "start_time string, end_time string, label string, notes string"


def tracks(spark: SparkSession, path: str) -> DataFrame:
    """Long track table, one row per clip, frame and body; NaN becomes NULL on the way in."""
    df = spark.read.parquet(path)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def detections(spark, path) -> DataFrame:
    return spark.read.schema(DETECTIONS).option("header", True).csv(path)


def legacy_positions(spark, path, min_frames=30, min_px=2.0) -> DataFrame:
    """Older feature table: interpolated positions are undone where the body was absent; scale is twice
    the median torso-pelvis distance.  Columns: clip, frame, present, px, py, tx, ty."""
    d = spark.read.schema("clip long, frame int, present boolean, px double, py double, tx double, ty double").option("header", True).csv(path)
    d = d.withColumns({c: F.when(F.col("present"), F.col(c)) for c in ("px", "py", "tx", "ty")})
    t = d.select("clip", (2 * F.sqrt((F.col("tx") - F.col("px")) ** 2 + (F.col("ty") - F.col("py")) ** 2)).alias("t")).where(F.col("t") > min_px)
    q = quantiles(t, ["clip"], "t", {"m": 0.5})
    return d.join(q.select("clip", F.when(F.col("n") >= min_frames, F.col("m")).alias("scale")), "clip", "left")


def clip_dirs(spark, root, suffix="parquet") -> DataFrame:
    """One directory per clip (`clip=...`); the clip name comes from the path, clips without files do not appear."""
    d = spark.read.option("recursiveFileLookup", True).format(suffix).load(root)
    return d.withColumn("clip", F.regexp_extract(F.col("_metadata.file_path"), r"clip=([^/]+)/", 1))


def clip_info(spark, path, fallback_path, schema: str) -> DataFrame:
    """Nested info record per clip; missing parts come from a second file."""
    a = spark.read.schema(schema).json(path)
    b = spark.read.schema("clip long, camera struct<static: boolean, moving_fraction: double>").json(fallback_path).withColumnRenamed("camera", "_cam")
    return a.join(b, "clip", "left").withColumn("camera", F.coalesce("camera", "_cam")).drop("_cam")


def curation(spark, path) -> DataFrame:
    """Clip registry; an absent file is an empty dimension."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(conf).exists(p):
        return spark.createDataFrame([], CURATION)
    return spark.read.schema(CURATION).option("header", True).csv(path)


def clock(c: Column) -> Column:
    """`HH:MM:SS`, `MM:SS` or plain seconds as seconds; NULL when unreadable."""
    p = F.split(F.trim(c), ":")
    n = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    return F.when(F.size(p) == 3, n(1) * 3600 + n(2) * 60 + n(3)).when(F.size(p) == 2, n(1) * 60 + n(2)).when(F.size(p) == 1, n(1))


def intervals(spark, csv_path=None, json_path=None) -> DataFrame:
    """Annotated intervals from CSV and JSON under one schema: start_s, end_s, label, notes."""
    parts = []
    if csv_path:
        parts.append(spark.read.schema(INTERVALS).option("header", True).csv(csv_path))
    if json_path:
        parts.append(spark.read.schema(INTERVALS).json(json_path))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(clock(F.col("start_time")).alias("start_s"), clock(F.col("end_time")).alias("end_s"), "label", F.coalesce("notes", F.lit("")).alias("notes"))


def add_interval(iv: DataFrame, start, end, label, notes="") -> DataFrame:
    spark = iv.sparkSession
    row = spark.createDataFrame([(str(start), str(end), label, notes)], INTERVALS)
    return iv.unionByName(row.select(clock(F.col("start_time")).alias("start_s"), clock(F.col("end_time")).alias("end_s"), "label", "notes"))


def figures_tsv(spark, path, tier="Together") -> DataFrame:
    """Tab-separated tiers; lines with at least nine fields of the wanted tier: start_s, end_s, label."""
    f = F.split("value", "\t")
    return spark.read.text(path).where((F.size(f) >= 9) & (F.get(f, F.lit(0)) == tier)).select(
        F.get(f, F.lit(3)).cast("double").alias("start_s"), F.get(f, F.lit(5)).cast("double").alias("end_s"), F.get(f, F.lit(8)).alias("label"))


def wide_channels(spark, path, block=10) -> DataFrame:
    """One line per channel with all its samples, averaged in blocks of `block`: channel, t, v.  Lines are
    exploded where they are read, so a line is the only thing a task must hold."""
    f = F.split("value", ",")
    d = spark.read.text(path).select(F.get(f, F.lit(0)).cast("long").alias("channel"), F.posexplode(F.slice(f, 2, F.size(f) - 1)).alias("pos", "s"))
    v = F.col("s").try_cast("double")
    return d.groupBy("channel", F.floor(F.col("pos") / block).cast("int").alias("t")).agg(F.avg(F.when(~F.isnan(v), v)).alias("v"))


def posture_labels(spark, paths) -> DataFrame:
    """Header-less label files under each other."""
    return spark.read.schema("seq string, frame int, label int").csv(paths)


def condition_matrix(spark, path, key="dyad") -> DataFrame:
    """Wide key x trial matrix to one row per cell: key, trial, cond."""
    d = spark.read.option("header", True).csv(path)
    cols = [c for c in d.columns if c != key]
    return d.unpivot(key, cols, "trial", "cond").select(F.col(key).cast("long").alias(key), F.col("trial").cast("int").alias("trial"), F.col("cond").cast("double").alias("cond"))
