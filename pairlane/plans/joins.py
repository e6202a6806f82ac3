"""Join operators over the derived tables."""
from pyspark.sql import functions as F

from pairlane.operators import joins as J
from pairlane.operators.pseudo import pseudo_ranks
from pairlane.operators import lags as L
from pairlane.operators.ordered import over_neighbours
from pairlane.sources import views as V

from .geometry import markers
from .registry import query
from .sources import r, rr
from .views_sql import with_views as sql


@query("lag_self_join", sql("pair", "SELECT x.clip, y.frame - x.frame AS lag, count(*) AS n, round(sum(x.a * y.b), 3) AS sxy FROM pair x JOIN pair y ON x.clip = y.clip AND y.frame BETWEEN x.frame - 4 AND x.frame + 4 WHERE x.a IS NOT NULL AND y.b IS NOT NULL GROUP BY 1, 2"))
def _(spark, sf):
    p = L.lag_pairs(V.pair(spark, sf), ["clip"], "a", "b", 4)
    return p.groupBy("clip", "lag").agg(F.count("*").alias("n"), F.round(F.sum(F.col("a") * F.col("b")), 3).alias("sxy"))


IJ = "ij AS (SELECT p.group_id, p.point_id, p.t_d, p.v, s.ord, s.label, s.start_d, s.end_d FROM points p JOIN spans s ON p.group_id = s.group_id AND p.t_d BETWEEN s.start_d AND s.end_d)"


def inside(spark, sf):
    return J.interval_join(V.points(spark, sf), V.spans(spark, sf), "group_id", "t_d", "start_d", "end_d", 32)


@query("interval_join", sql("points spans", IJ + " SELECT group_id, point_id, ord, label FROM ij"))
def _(spark, sf):
    return inside(spark, sf).select("group_id", "point_id", "ord", "label")


@query("first_interval", sql("points spans", IJ + " SELECT p.point_id, f.label FROM points p LEFT JOIN (SELECT point_id, arg_min(label, ord) AS label FROM ij GROUP BY point_id) f USING (point_id)"))
def _(spark, sf):
    f = inside(spark, sf).groupBy("point_id").agg(F.min_by("label", "ord").alias("label"))
    return V.points(spark, sf).select("point_id").join(f, "point_id", "left")


@query("overlap_join", sql("spans", "SELECT a.group_id, a.ord AS ord_a, b.ord AS ord_b, least(a.end_d, b.end_d) - greatest(a.start_d, b.start_d) AS days FROM spans a JOIN spans b ON a.group_id = b.group_id AND a.start_d < b.end_d AND a.end_d > b.start_d WHERE a.label IN ('1-URGENT', '2-HIGH') AND b.label NOT IN ('1-URGENT', '2-HIGH')"))
def _(spark, sf):
    s = V.spans(spark, sf)
    side = lambda x: s.select("group_id", *[F.col(c).alias(f"{n}_{x}") for c, n in (("ord", "ord"), ("start_d", "start"), ("end_d", "end"), ("label", "label"))])
    hi = F.col("label_a").isin("1-URGENT", "2-HIGH")
    j = J.overlap_join(side("a").where(hi), side("b").where(~F.col("label_b").isin("1-URGENT", "2-HIGH")), "group_id", 32)
    return j.select("group_id", "ord_a", "ord_b", (F.least("end_a", "end_b") - F.greatest("start_a", "start_b")).alias("days"))


@query("fuzzy_time_join", """WITH l AS (SELECT user_id, event_id AS id_l, epoch(ts) AS t_l FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, event_id AS id_r, epoch(ts) AS t_r FROM events WHERE event_type = 'click')
 SELECT l.user_id, id_l, min(id_r) AS id_r, count(*) AS n FROM l JOIN r ON l.user_id = r.user_id AND abs(t_l - t_r) < 7200 GROUP BY 1, 2""")
def _(spark, sf):
    """First click within two hours of each purchase of the same user."""
    ev = V.table(spark, sf, "events")
    t = F.unix_micros(F.to_timestamp("ts")) / 1e6
    l = ev.where(F.col("event_type") == "purchase").select("user_id", F.col("event_id").alias("id_l"), t.alias("t_l"))
    rt = ev.where(F.col("event_type") == "click").select("user_id", F.col("event_id").alias("id_r"), t.alias("t_r"))
    return J.near_time_join(l, rt, ["user_id"], 7200.0).groupBy("user_id", "id_l").agg(F.min("id_r").alias("id_r"), F.count("*").alias("n"))


NEXT = """mk_ AS (SELECT clip, frame, CASE WHEN ax >= 60 THEN frame END AS sf, CASE WHEN ax < 10 THEN frame END AS ff FROM duet),
nx AS (SELECT clip, frame AS f1, ff, last_value(sf IGNORE NULLS) OVER w AS f0, last_value(ff IGNORE NULLS) OVER w AS pf FROM mk_ WINDOW w AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ev AS (SELECT clip, f0, f1 FROM nx WHERE ff IS NOT NULL AND f0 IS NOT NULL AND f1 - f0 <= 20 AND (pf IS NULL OR pf < f0))"""


def descents(df, keys, stand, floor, reach):
    """One event per floor frame whose previous marked frame is a standing one at most `reach` back:
    the first floor frame after a standing frame, with the last standing frame before it."""
    mark = F.when(stand, F.struct(F.lit(True).alias("up"), F.col("frame").alias("f"))).when(floor, F.struct(F.lit(False).alias("up"), F.col("frame").alias("f")))
    d = over_neighbours(df, keys, {"_pm": lambda w: F.last(mark, ignorenulls=True).over(w.rowsBetween(-reach, -1))}, back=reach)
    return d.where(floor & F.col("_pm.up")).withColumns({"f0": F.col("_pm.f"), "f1": F.col("frame")}).drop("_pm")


@query("next_within", sql("duet", NEXT + " SELECT clip, f0, f1 FROM ev"))
def _(spark, sf):
    return descents(V.duet(spark, sf), ["clip"], F.col("ax") >= 60, F.col("ax") < 10, 20).select("clip", "f0", "f1")


@query("frame_pair_join", sql("det", f"SELECT a.clip, a.frame, a.track_id AS id_a, b.track_id AS id_b, {rr('sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2))')} AS d FROM det a JOIN det b ON a.clip = b.clip AND a.frame = b.frame AND a.track_id < b.track_id WHERE sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)) < 12"))
def _(spark, sf):
    """Unordered pairs of one frame closer than the edge length; only touching grid cells are compared."""
    d = V.detections(spark, sf)
    side = lambda x: d.select("clip", "frame", F.col("track_id").alias(f"id_{x}"), F.col("cx").alias(f"x_{x}"), F.col("cy").alias(f"y_{x}"))
    j = J.grid_join(side("a"), side("b"), ["clip", "frame"], 12.0).where(F.col("id_a") < F.col("id_b"))
    return j.select("clip", "frame", "id_a", "id_b", r("d").alias("d"))


PSEUDO = """g AS (SELECT s_suppkey AS clip, s_nationkey AS grp FROM supplier), pj AS (SELECT x.clip AS ca, y.clip AS cb, l.range - 2 AS lag, count(*) AS n, sum(x.a) AS sx, sum(y.b) AS sy, sum(x.a*x.a) AS sxx, sum(y.b*y.b) AS syy, sum(x.a*y.b) AS sxy
 FROM (SELECT clip, frame, a FROM pair WHERE a IS NOT NULL) x, range(5) l, (SELECT clip, frame, b FROM pair WHERE b IS NOT NULL) y, g ga, g gb WHERE y.frame = x.frame + l.range - 2 AND ga.clip = x.clip AND gb.clip = y.clip AND (ga.grp <> gb.grp OR x.clip = y.clip) GROUP BY 1, 2, 3),
 pr AS (SELECT ca, cb, max(abs(r)) AS r, max(CASE WHEN lag = 0 THEN r END) AS r0 FROM (SELECT ca, cb, lag, CASE WHEN n >= 20 THEN (sxy - sx*sy/n) / sqrt((sxx - sx*sx/n) * (syy - sy*sy/n)) END AS r FROM pj) GROUP BY 1, 2)"""


def pseudo(spark, sf, probs=(), **part):
    grp = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("clip"), F.col("s_nationkey").alias("grp"))
    return pseudo_ranks(V.pair(spark, sf), grp, 2, 20, list(probs), **part)


@query("pseudo_pair_join", sql("pair", PSEUDO + f""", t AS (SELECT ca AS clip, r AS tr FROM pr WHERE ca = cb), u AS (SELECT ca AS clip, r FROM pr WHERE ca <> cb UNION ALL SELECT cb, r FROM pr WHERE ca <> cb)
 SELECT clip, {rr('any_value(tr)')} AS true_abs_r, {rr('quantile_cont(r, 0.5)')} AS pseudo_median, {rr('quantile_cont(r, 0.95)')} AS pseudo_95, {rr('(count(*) FILTER (r >= tr) + 1) / (count(*) + 1)')} AS p_pseudo, count(*) AS n_pseudo FROM u JOIN t USING (clip) WHERE r IS NOT NULL GROUP BY clip"""))
def _(spark, sf):
    """Where each clip's own |r| stands among those of its A and B with strangers."""
    p = pseudo(spark, sf, (0.5, 0.95)).where("n_pseudo > 0")
    return p.select("clip", r("true_abs_r").alias("true_abs_r"), r(F.get("quantiles", F.lit(0))).alias("pseudo_median"), r(F.get("quantiles", F.lit(1))).alias("pseudo_95"),
                    r((F.col("n_as_strong") + 1) / (F.col("n_pseudo") + 1)).alias("p_pseudo"), "n_pseudo")


@query("pseudo_pair_full", sql("pair", PSEUDO + f""", t AS (SELECT ca AS clip, r0 AS tr FROM pr WHERE ca = cb), u AS (SELECT ca AS clip, r0 FROM pr WHERE ca <> cb UNION ALL SELECT cb, r0 FROM pr WHERE ca <> cb)
 SELECT clip, {rr('any_value(tr)')} AS true_r0, {rr('avg(r0)')} AS pseudo_mean, {rr('stddev_pop(r0)')} AS pseudo_sd, count(r0) AS n_pseudo FROM u JOIN t USING (clip) WHERE r0 IS NOT NULL GROUP BY clip"""))
def _(spark, sf):
    return pseudo(spark, sf, far_lags=0).where("n_r0 > 0").select("clip", r("true_r0").alias("true_r0"), r("mean_r0").alias("pseudo_mean"), r("sd_r0").alias("pseudo_sd"), F.col("n_r0").alias("n_pseudo"))


@query("spread_exclusion", sql("det", """k AS (SELECT * FROM det WHERE track_id % 10 <> 0), e AS (SELECT * FROM det WHERE track_id % 10 = 0)
 SELECT clip, frame, track_id FROM k WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.clip = k.clip AND e.frame BETWEEN k.frame - 2 AND k.frame + 2 AND greatest(0, least(k.x2, e.x2) - greatest(k.x1, e.x1)) * greatest(0, least(k.y2, e.y2) - greatest(k.y1, e.y1))
 > 0.4 * ((k.x2 - k.x1) * (k.y2 - k.y1) + (e.x2 - e.x1) * (e.y2 - e.y1) - greatest(0, least(k.x2, e.x2) - greatest(k.x1, e.x1)) * greatest(0, least(k.y2, e.y2) - greatest(k.y1, e.y1))))"""))
def _(spark, sf):
    d = V.detections(spark, sf)
    x = F.col("track_id") % 10 == 0
    return J.spread_exclusion(d.where(~x), d.where(x), ["clip"], 2, 0.4, 8.0, 16.0).select("clip", "frame", "track_id")


@query("radius_nn_join", sql("det", f"""SELECT a.frame, a.track_id AS id_a, arg_min(b.track_id, {{'d': sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)), 'i': b.track_id}}) AS id_b, {rr('min(sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)))')} AS d
 FROM det a JOIN det b ON a.frame = b.frame AND a.clip = 'click' AND b.clip = 'view' WHERE sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)) < 25 GROUP BY 1, 2"""))
def _(spark, sf):
    d = V.detections(spark, sf)
    side = lambda x, c: d.where(F.col("clip") == c).select("frame", F.col("track_id").alias(f"id_{x}"), F.col("cx").alias(f"x_{x}"), F.col("cy").alias(f"y_{x}"))
    return J.nearest_in_tiles(side("a", "click"), side("b", "view"), ["frame"], 25.0).select("frame", "id_a", "id_b", r("d").alias("d"))


@query("cross_distance", """WITH e AS (SELECT label AS clip, vec_id, embedding AS e, row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id) AS n FROM embeddings), p AS (SELECT a.clip, a.n - 1 AS frame, i.range AS i, j.range AS j, sqrt(power((a.e[3*i.range+1]::DOUBLE - b.e[3*j.range+1]::DOUBLE) * 100, 2) + power((a.e[3*i.range+2]::DOUBLE - b.e[3*j.range+2]::DOUBLE) * 100, 2) + power((a.e[3*i.range+3]::DOUBLE - b.e[3*j.range+3]::DOUBLE) * 100, 2)) AS d
 FROM e a JOIN e b ON a.clip = b.clip AND a.n = b.n AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1, range(21) i, range(21) j) SELECT clip, frame, """ + rr("min(d)") + """ AS d_min, bool_or(d < 6 AND i >= 8 AND i <= 9 AND j >= 8 AND j <= 9) AS grip, bool_or(d < 6 AND NOT (i >= 8 AND i <= 9 AND j >= 8 AND j <= 9)) AS surface FROM p GROUP BY clip, frame""")
def _(spark, sf):
    """All marker distances of a frame inside the row: 21 x 21, no shuffle beyond pairing the bodies."""
    p = marker_pairs(spark, sf)
    d = F.flatten(F.transform("a", lambda u, i: F.transform("b", lambda v, j: F.struct(
        F.sqrt((u["x"] - v["x"]) * (u["x"] - v["x"]) + (u["y"] - v["y"]) * (u["y"] - v["y"]) + (u["z"] - v["z"]) * (u["z"] - v["z"])).alias("d"),
        (i.between(8, 9) & j.between(8, 9)).alias("hand")))))
    p = p.select("clip", "frame", d.alias("d"))
    return p.select("clip", "frame", r(F.array_min("d")["d"]).alias("d_min"), F.exists("d", lambda s: (s["d"] < 6) & s["hand"]).alias("grip"),
                    F.exists("d", lambda s: (s["d"] < 6) & ~s["hand"]).alias("surface"))


def marker_pairs(spark, sf):
    """Markers of both bodies of a frame: clip, frame, a, b (arrays of struct(x, y, z))."""
    from pairlane.operators.ordered import bucketed_row_number
    m = markers(spark, sf).withColumnRenamed("frame", "vec_id").withColumn("side", F.col("vec_id") % 2)
    n = bucketed_row_number(m, ["clip", "side"], F.floor(F.col("vec_id") / 65536), ["vec_id"], "frame")
    g = n.groupBy("clip", "frame").agg(F.first(F.when(F.col("side") == 0, F.col("mk")), ignorenulls=True).alias("a"), F.first(F.when(F.col("side") == 1, F.col("mk")), ignorenulls=True).alias("b"))
    return g.where(F.col("a").isNotNull() & F.col("b").isNotNull())


@query("dim_joins", f"SELECT s_suppkey, coalesce(n_name, 'none') AS nation, coalesce(r_name, 'none') AS region, count(l_orderkey) AS n, {rr('sum(l_quantity)')} AS qty FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL")
def _(spark, sf):
    """Facts are aggregated first; the dimensions' join strategy is left to their measured size."""
    T = lambda n: V.table(spark, sf, n)
    li = T("lineitem").groupBy("l_suppkey").agg(F.count("l_orderkey").alias("n"), F.sum("l_quantity").alias("qty"))
    d = T("supplier").join(T("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(T("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return d.join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("none")).alias("nation"), F.coalesce("r_name", F.lit("none")).alias("region"), F.coalesce("n", F.lit(0)).alias("n"), r("qty").alias("qty"))


@query("semi_anti", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def _(spark, sf):
    T = lambda n: V.table(spark, sf, n)
    big = T("orders").where(F.col("o_totalprice") > 100000).select(F.col("o_custkey").alias("c_custkey"))
    err = T("events").where(F.col("event_type") == "error").select(F.col("user_id").alias("c_custkey"))
    return T("customer").join(big, "c_custkey", "left_semi").join(err, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("dup_detect", "SELECT doc_id, CASE WHEN doc_id > first THEN 'duplicate_of:' || first END AS reason FROM documents JOIN (SELECT md5(text) AS h, min(doc_id) AS first FROM documents GROUP BY 1) ON md5(text) = h")
def _(spark, sf):
    """Signature of the whole content; copies point to the first holder.  Grouping ships one row per
    signature and task, so a group holding a third of the rows stays cheap."""
    d = V.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    return d.join(first, "h").select("doc_id", F.when(F.col("doc_id") > F.col("first"), F.concat(F.lit("duplicate_of:"), F.col("first").cast("string"))).alias("reason"))


@query("dup_detect_frames", sql("duet", """s AS (SELECT clip, list({'f': frame, 'a': ax, 'b': ay, 'c': bx, 'd': "by"} ORDER BY frame) AS sig FROM duet GROUP BY clip) SELECT clip, CASE WHEN clip > first THEN 'duplicate_of:' || first END AS reason FROM s JOIN (SELECT sig, min(clip) AS first FROM s GROUP BY sig) USING (sig)"""))
def _(spark, sf):
    """Duplicate series by a signature of all their rows: sums of two hashes of each row, which merge in any order."""
    return duplicate_series(V.duet(spark, sf), ["ax", "ay", "bx", "by"])


def duplicate_series(frames, cols):
    row = lambda seed: F.sum(F.xxhash64(F.lit(seed), "frame", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols]).cast("decimal(38,0)"))
    s = frames.groupBy("clip").agg(row(1).alias("h1"), row(2).alias("h2"), F.count("*").alias("n"))
    first = s.groupBy("h1", "h2", "n").agg(F.min("clip").alias("first"))
    return s.join(first, ["h1", "h2", "n"]).select("clip", F.when(F.col("clip") > F.col("first"), F.concat(F.lit("duplicate_of:"), F.col("first").cast("string"))).alias("reason"))
