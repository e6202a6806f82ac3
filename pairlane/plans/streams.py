"""Streaming twins run over the whole event table until no input is left."""
from pyspark.sql import functions as F

from pairlane.sources import views as V
from pairlane.streaming import twins as T

from .registry import query
from .sources import r, rr
from .views_sql import with_views as sql

# what the watermark has passed when the input ends
WM = "wm AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events)"


@query("stream_window_table", "WITH " + WM + f", x AS (SELECT event_type, value, unnest(range(4)) AS k, ts FROM events), g AS (SELECT date_trunc('hour', ts) - to_hours(CAST(k AS INT)) AS t_start, event_type, value FROM x) SELECT CAST(epoch(t_start) AS BIGINT) AS t_start, event_type, count(*) AS n, {rr('avg(value)')} AS mean FROM g, wm WHERE t_start + INTERVAL 4 HOUR <= w GROUP BY 1, 2")
def _(spark, sf):
    w = T.run_to_files(T.window_table(T.events(spark, sf)), "windows")
    return w.select(F.unix_timestamp("t_start").alias("t_start"), "event_type", "n", r("mean").alias("mean"))


@query("stream_episodes", "WITH " + WM + ", o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS o FROM events), g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o), e AS (SELECT user_id, g, min(ts) AS t0, max(ts) AS t1, count(*) AS n FROM g GROUP BY 1, 2) SELECT user_id, epoch_us(t0) AS t0_us, epoch_us(t1) AS t1_us, n FROM e, wm WHERE t1 + INTERVAL 2 HOUR <= w")
def _(spark, sf):
    e = T.run_to_files(T.episodes(T.events(spark, sf)), "episodes")
    return e.select("user_id", F.unix_micros("t0").alias("t0_us"), F.unix_micros("t1").alias("t1_us"), "n")


@query("stream_states", sql("sym", "SELECT event_id, user_id, \"on\" FROM (SELECT e.event_id, e.user_id, e.ts, coalesce(last_value(CASE WHEN e.value > 40 THEN false WHEN e.value < 10 THEN true END IGNORE NULLS) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id), false) AS \"on\" FROM events e)"))
def _(spark, sf):
    """The state after every event; a closing row releases the last ten minutes."""
    ev, end = T.with_closing_row(T.events(spark, sf), V.table(spark, sf, "events"))
    return T.run_to_files(T.states(ev).where("user_id IS NOT NULL"), "states", end=end)


@query("stream_two_slot_assign")
def _(spark, sf):
    """Detections written as files, read as a stream, tracked with state; closing rows, written last, end every clip."""
    from pairlane.sources.scratch import scratch
    p = scratch(spark, "det")
    d = V.detections(spark, sf).select("clip", "frame", "track_id", "cx", "cy", "x1", "y1", "x2", "y2")
    d.write.parquet(p)
    end = lambda: T.closing_frames(spark.read.schema(d.schema).parquet(p)).write.mode("append").parquet(p)
    return T.run_to_files(T.two_slots(spark.readStream.schema(d.schema).parquet(p)), "slots", end=end)


@query("stream_graph_metrics", "WITH " + WM + """, n AS (SELECT event_type AS clip, CAST(floor((epoch(ts) - 1704067200) / 3600) AS INT) AS frame, user_id AS id, avg(value) AS x, avg(CAST(json_extract(props, '$.k') AS DOUBLE)) AS y FROM events, wm WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= w GROUP BY 1, 2, 3),
 e AS (SELECT a.clip, a.frame, count(*) AS n_edges FROM n a JOIN n b ON a.clip = b.clip AND a.frame = b.frame AND a.id < b.id WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) < 12 GROUP BY 1, 2) SELECT n.clip, n.frame, count(*) AS n_nodes, coalesce(any_value(n_edges), 0) AS n_edges FROM n LEFT JOIN e ON e.clip = n.clip AND e.frame = n.frame GROUP BY 1, 2""")
def _(spark, sf):
    """Nodes of finished hours come from the stream; the graph of a finished hour is a batch operator."""
    from pairlane.operators.joins import grid_join
    n = T.run_to_files(T.frame_nodes(T.events(spark, sf)), "nodes")
    side = lambda x: n.select("clip", "frame", F.col("track_id").alias(f"id_{x}"), F.col("cx").alias(f"x_{x}"), F.col("cy").alias(f"y_{x}"))
    e = grid_join(side("a"), side("b"), ["clip", "frame"], 12.0).where(F.col("id_a") < F.col("id_b")).groupBy("clip", "frame").agg(F.count("*").alias("n_edges"))
    return n.groupBy("clip", "frame").agg(F.count("*").alias("n_nodes")).join(e, ["clip", "frame"], "left").select("clip", "frame", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
