"""Frame tables derived from the driver tables; every one grows with its input."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from pairlane.operators.ordered import bucketed_row_number

FPS = 30.0
EPOCH = 1704067200          # 2024-01-01T00:00:00Z, first day of `events`


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def duet(spark, sf) -> DataFrame:
    """Two bodies per supplier: clip, frame, positions (NULL when absent) and a camera step."""
    li = table(spark, sf, "lineitem")
    n = bucketed_row_number(
        li, ["l_suppkey"], F.to_date("l_shipdate"),
        ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "frame")
    pa, pb, cam = F.col("l_tax") != 0.08, F.col("l_discount") != 0.1, F.col("l_linenumber") != 7
    t, q = F.col("l_quantity"), (F.col("l_discount") - 0.05) / 5
    return n.select(
        F.col("l_suppkey").alias("clip"), "frame", pa.alias("present_a"), pb.alias("present_b"),
        F.when(pa, F.col("l_extendedprice") / 997.0).alias("ax"), F.when(pa, t * 1.01).alias("ay"),
        F.when(pb, (F.col("l_partkey") % 1000) / 9.7).alias("bx"), F.when(pb, (F.col("l_orderkey") % 50) * 1.03).alias("by"),
        F.when(cam, 1 + (t - 25) / 2500).alias("m00"), F.when(cam, -q).alias("m01"), F.when(cam, F.col("l_tax") * 10 - 0.4).alias("m02"),
        F.when(cam, q).alias("m10"), F.when(cam, 1 + (t - 25) / 2500).alias("m11"), F.when(cam, F.col("l_discount") * 10 - 0.5).alias("m12"))


def long_track(duet_df: DataFrame) -> DataFrame:
    """(clip, frame, body, x, y) from the wide pair table, without a second scan."""
    return duet_df.select("clip", "frame", F.explode(F.array(
        F.struct(F.lit("A").alias("body"), F.col("ax").alias("x"), F.col("ay").alias("y")),
        F.struct(F.lit("B").alias("body"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("s")).select("clip", "frame", "s.*")


def hourly_long(spark, sf) -> DataFrame:
    """Hourly means of click (a) and view (b) values; hours without events, from the first to the last with
    one, are NULL rows."""
    ev = table(spark, sf, "events")
    f = F.floor((F.unix_timestamp("ts") - EPOCH) / 3600).cast("int")
    g = ev.where(F.col("event_type").isin("click", "view")).groupBy(f.alias("frame")).agg(
        F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"),
        F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b"))
    grid = g.agg(F.min("frame").alias("lo"), F.max("frame").alias("hi")).where("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi")).alias("frame"))
    return grid.join(g, "frame", "left").select(F.lit(0).alias("clip"), "frame", "a", "b")


def pair(spark, sf) -> DataFrame:
    """Scalar A/B series per supplier and week of shipping: clip, frame, a, b (NULL = unseen week)."""
    li = table(spark, sf, "lineitem")
    f = F.floor((F.unix_timestamp("l_shipdate") - 788918400) / 604800).cast("int")     # weeks since 1995-01-01
    g = li.groupBy(F.col("l_suppkey").alias("clip"), f.alias("frame")).agg(
        F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice"))).alias("a"),
        F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice"))).alias("b"))
    return g.select("clip", "frame", (F.col("a") / 997.0).alias("a"), (F.col("b") / 997.0).alias("b"))


def pose(spark, sf) -> DataFrame:
    """17 keypoints per body and frame folded from embeddings: clip, frame, body, k (array of x, y, c)."""
    e = table(spark, sf, "embeddings").select(
        F.col("label").alias("clip"), "vec_id", F.when(F.col("vec_id") % 2 == 0, "A").otherwise("B").alias("body"),
        F.transform("embedding", lambda v: v.cast("double") * 100).alias("e"))
    n = bucketed_row_number(e, ["clip", "body"], F.floor(F.col("vec_id") / 65536), ["vec_id"], "frame")
    kp = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.struct(
        F.get("e", i * 3).alias("x"), F.get("e", i * 3 + 1).alias("y"), (F.abs(F.get("e", i * 3 + 2)) * 0.08).alias("c")))
    return n.select("clip", "frame", "body", "vec_id", kp.alias("k"))


def pose_pair(spark, sf) -> DataFrame:
    """A and B of the same clip and frame side by side: clip, frame, ka, kb."""
    p = pose(spark, sf)
    return (p.groupBy("clip", "frame").agg(
        F.first(F.when(F.col("body") == "A", F.col("k")), ignorenulls=True).alias("ka"),
        F.first(F.when(F.col("body") == "B", F.col("k")), ignorenulls=True).alias("kb"))
        .where(F.col("ka").isNotNull() & F.col("kb").isNotNull()))


def detections(spark, sf) -> DataFrame:
    """Boxes of tracked people: clip = event type, frame = hour, track_id = user."""
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    g = ev.groupBy(F.col("event_type").alias("clip"), F.floor((F.unix_timestamp("ts") - EPOCH) / 3600).cast("int").alias("frame"),
                   F.col("user_id").alias("track_id")).agg(F.avg("value").alias("cx"), F.avg(k).alias("cy"), F.count("*").alias("n"))
    h = 10 + F.col("track_id") % 7
    return g.select("clip", "frame", "track_id", "cx", "cy", F.least(F.lit(1.0), F.lit(0.25) + 0.1 * (F.col("n") + F.col("track_id") % 3 - 1)).alias("conf"),
                    (F.col("cx") - 4).alias("x1"), (F.col("cy") - h / 2).alias("y1"), (F.col("cx") + 4).alias("x2"), (F.col("cy") + h / 2).alias("y2"))


def symbols(spark, sf) -> DataFrame:
    """Event type sequence per user: clip, pos, symbol."""
    ev = table(spark, sf, "events").select(F.col("user_id").alias("clip"), F.col("event_type").alias("symbol"), "ts", "event_id", "value")
    return bucketed_row_number(ev, ["clip"], F.to_date("ts"), ["ts", "event_id"], "pos").drop("event_id")


def roles(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("clip"), F.col("turn").alias("pos"), F.col("role").alias("symbol"))


def raters(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("r1"), (1 - F.col("toxic")).alias("r2"))


def spans(spark, sf) -> DataFrame:
    """Labelled intervals in days per customer: group_id, ord, start_d, end_d, label."""
    d = F.floor(F.unix_timestamp("o_orderdate") / 86400).cast("int")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("ord"), d.alias("start_d"),
                                             (d + 30).alias("end_d"), F.col("o_orderpriority").alias("label"))


def points(spark, sf) -> DataFrame:
    """Event points in days per customer: group_id, point_id, t_d, v."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("group_id"), F.col("event_id").alias("point_id"),
        (9131 + F.col("event_id") % 2400).cast("int").alias("t_d"), F.col("value").alias("v"))
