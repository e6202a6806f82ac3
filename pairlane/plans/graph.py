"""Proximity graphs."""
from pyspark.sql import functions as F

from pairlane.operators import graph as GR
from pairlane.operators.ordered import cut_lineage, quantiles
from pairlane.sources import views as V

from .registry import query
from .sources import r, rr
from .views_sql import with_views as sql

EDGE = 3.0
ED = """dn AS (SELECT * FROM det WHERE conf >= 0.3 AND track_id >= 0), rd AS (SELECT clip, quantile_cont(y2 - y1, 0.5) / 3.3::DOUBLE * 3 AS radius FROM dn GROUP BY clip), ed AS (SELECT a.clip, a.frame, a.track_id AS ia, b.track_id AS ib, sqrt(power(a.cx - b.cx, 2) + power((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) AS d FROM dn a JOIN dn b ON a.clip = b.clip AND a.frame = b.frame AND a.track_id < b.track_id JOIN rd ON rd.clip = a.clip WHERE sqrt(power(a.cx - b.cx, 2) + power((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) < radius)"""
CC = ED + """, sy AS (SELECT clip, frame, ia AS s, ib AS t FROM ed UNION ALL SELECT clip, frame, ib, ia FROM ed UNION ALL SELECT clip, frame, track_id, track_id FROM dn), h2 AS (SELECT DISTINCT a.clip, a.frame, a.s, b.t FROM sy a JOIN sy b ON a.clip = b.clip AND a.frame = b.frame AND a.t = b.s), h4 AS (SELECT DISTINCT a.clip, a.frame, a.s, b.t FROM h2 a JOIN h2 b ON a.clip = b.clip AND a.frame = b.frame AND a.t = b.s),
 h8 AS (SELECT DISTINCT a.clip, a.frame, a.s, b.t FROM h4 a JOIN h4 b ON a.clip = b.clip AND a.frame = b.frame AND a.t = b.s), cc AS (SELECT clip, frame, s AS id, min(t) AS comp FROM h8 GROUP BY 1, 2, 3)"""
FM = CC + """, sz AS (SELECT clip, frame, comp, count(*) AS s FROM cc GROUP BY 1, 2, 3), fm AS (SELECT z.clip, z.frame, CAST(z.n AS BIGINT) AS n_nodes, coalesce(e.n, 0) AS n_edges, z.c AS n_components, z.m AS largest_component FROM (SELECT clip, frame, sum(s) AS n, count(*) AS c, max(s) AS m FROM sz GROUP BY 1, 2) z LEFT JOIN (SELECT clip, frame, count(*) AS n FROM ed GROUP BY 1, 2) e ON e.clip = z.clip AND e.frame = z.frame)"""


def edges(spark, sf):
    return GR.proximity_edges(V.detections(spark, sf), EDGE)


def nodes(spark, sf):
    return V.detections(spark, sf).where((F.col("conf") >= 0.3) & (F.col("track_id") >= 0)).select("clip", "frame", F.col("track_id").alias("id"))


def metrics(spark, sf):
    e, n = cut_lineage(edges(spark, sf)), nodes(spark, sf)          # read by every round and by the counts
    return GR.frame_metrics(n, e, GR.components(n, e, ["clip", "frame"]))


@query("proximity_edges", sql("det", ED + f" SELECT clip, frame, ia AS id_a, ib AS id_b, {rr('d')} AS d FROM ed"))
def _(spark, sf):
    return edges(spark, sf).select("clip", "frame", "id_a", "id_b", r("d").alias("d"))


@query("frame_graph_metrics", sql("det", FM + f" SELECT clip, frame, n_nodes, n_edges, n_components, largest_component, {rr('2 * n_edges / n_nodes')} AS mean_degree FROM fm"))
def _(spark, sf):
    return metrics(spark, sf).select("clip", "frame", "n_nodes", "n_edges", "n_components", "largest_component", r("mean_degree").alias("mean_degree"))


@query("pair_persistence", sql("det", ED + " SELECT clip, ia AS id_a, ib AS id_b, count(*) AS frames_connected FROM ed GROUP BY 1, 2, 3"))
def _(spark, sf):
    return edges(spark, sf).groupBy("clip", "id_a", "id_b").agg(F.count("*").alias("frames_connected"))


@query("graph_summary", sql("det", FM + f", pp AS (SELECT clip, count(*) AS n_pairs, count(*) FILTER (n > 1) AS n_long FROM (SELECT clip, ia, ib, count(*) AS n FROM ed GROUP BY 1, 2, 3) GROUP BY clip) SELECT clip, count(*) AS n_frames, {rr('avg(n_nodes)')} AS mean_nodes, {rr('avg(n_edges)')} AS mean_edges, {rr('avg(n_components)')} AS mean_components, {rr('quantile_cont(largest_component, 0.95)')} AS p95_largest, {rr('avg(n_edges / greatest(1, n_nodes * (n_nodes - 1) / 2))')} AS density, any_value(coalesce(n_pairs, 0)) AS n_pairs, any_value(coalesce(n_long, 0)) AS n_long FROM fm LEFT JOIN pp USING (clip) GROUP BY clip"))
def _(spark, sf):
    m = metrics(spark, sf)
    p = edges(spark, sf).groupBy("clip", "id_a", "id_b").agg(F.count("*").alias("n")).groupBy("clip").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("n") > 1).alias("n_long"))
    n = F.col("n_nodes")
    a = m.groupBy("clip").agg(F.count("*").alias("n_frames"), r(F.avg("n_nodes")).alias("mean_nodes"), r(F.avg("n_edges")).alias("mean_edges"), r(F.avg("n_components")).alias("mean_components"), r(F.avg(F.col("n_edges") / F.greatest(F.lit(1.0), n * (n - 1) / 2))).alias("density"))
    q = quantiles(m, ["clip"], "largest_component", {"q": 0.95})
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(q, "clip").join(p, "clip", "left").select("clip", "n_frames", "mean_nodes", "mean_edges", "mean_components", r("q").alias("p95_largest"), "density", z("n_pairs"), z("n_long"))
