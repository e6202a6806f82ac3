"""Per-row geometry over the pose views."""
from pyspark.sql import functions as F

from pairlane.constants import CHART, LIMBS, MARKERS, MARKERS_OF_KEYPOINT, REGIONS, SEGMENTS
from pairlane.functions import geometry as G
from pairlane.functions.contact import contact_location, flat, nearest_regions
from pairlane.operators.ordered import quantiles
from pairlane.sources import views as V

from .registry import query
from .sources import r, rr
from .views_sql import with_views as sql

SC = 12.0          # body length used where a query is not about estimating it


def pairs(spark, sf):
    p = V.pose_pair(spark, sf)
    return p.select("clip", "frame", G.masked(F.col("ka")).alias("ma"), G.masked(F.col("kb")).alias("mb"), "ka", "kb")


def bodies(spark, sf):
    return V.pose(spark, sf).select("clip", "frame", "body", G.masked(F.col("k")).alias("m"), "k")


MASK = "list_transform({k}, lambda p: CASE WHEN p.c >= 0.3 THEN p END)"
PAIRS = f"mp AS (SELECT clip, frame, {MASK.format(k='ka')} AS a, {MASK.format(k='kb')} AS b FROM posep)"
BODIES = f"mb AS (SELECT clip, frame, body, k, {MASK.format(k='k')} AS m FROM pose)"
X = lambda m, i: f"{m}[{i + 1}].x"
Y = lambda m, i: f"{m}[{i + 1}].y"
MX = lambda m, i, j: f"(({X(m, i)} + {X(m, j)}) / 2)"
MY = lambda m, i, j: f"(({Y(m, i)} + {Y(m, j)}) / 2)"
D = lambda dx, dy: f"sqrt(power({dx}, 2) + power({dy}, 2))"
TRUNK = lambda m: D(f"{MX(m, 5, 6)} - {MX(m, 11, 12)}", f"{MY(m, 5, 6)} - {MY(m, 11, 12)}")
FOOT = lambda m: f"greatest({Y(m, 15)}, {Y(m, 16)})"
LEVEL = lambda m, s="12": f"(({FOOT(m)} - {MY(m, 11, 12)}) / {s})"
MEAN2 = lambda m, i, j: f"list_avg(list_filter([{Y(m, i)}, {Y(m, j)}], lambda v: v IS NOT NULL))"


@query("conf_mask", sql("pose", BODIES + f" SELECT clip, frame, body, len(list_filter(m, lambda p: p IS NOT NULL))::BIGINT AS n_conf, len(list_filter(k, lambda p: p.c >= 0.25))::BIGINT AS n_25, len(list_filter(k, lambda p: p.c >= 0.5))::BIGINT AS n_50, {rr(X('m', 3))} AS x3 FROM mb"))
def _(spark, sf):
    n = lambda c: F.size(G.present(G.masked(F.col("k"), c))).cast("long")
    return bodies(spark, sf).select("clip", "frame", "body", n(0.3).alias("n_conf"), n(0.25).alias("n_25"), n(0.5).alias("n_50"), r(G.at(F.col("m"), 3)["x"]).alias("x3"))


@query("body_centers", sql("pose", BODIES + f" SELECT clip, frame, body, {rr(MX('m', 11, 12))} AS pelvis_x, {rr(MY('m', 11, 12))} AS pelvis_y, {rr('(' + '+'.join(X('m', i) for i in (5, 6, 11, 12)) + ')/4')} AS torso_x, {rr('(list_min(list_transform(k, lambda p: p.x)) + list_max(list_transform(k, lambda p: p.x))) / 2')} AS body_x FROM mb"))
def _(spark, sf):
    m, xs = F.col("m"), F.transform("k", lambda p: p["x"])
    return bodies(spark, sf).select("clip", "frame", "body", r(G.pelvis(m)[0]).alias("pelvis_x"), r(G.pelvis(m)[1]).alias("pelvis_y"), r(G.torso(m)[0]).alias("torso_x"),
                                    r((F.array_min(xs) + F.array_max(xs)) / 2).alias("body_x"))


@query("trunk_length", sql("pose", BODIES + f" SELECT clip, frame, body, {rr(TRUNK('m'))} AS trunk, {rr('CASE WHEN ' + TRUNK('m') + ' > 10 THEN ' + TRUNK('m') + ' END')} AS trunk_min FROM mb"))
def _(spark, sf):
    return bodies(spark, sf).select("clip", "frame", "body", r(G.trunk_length(F.col("m"))).alias("trunk"), r(G.trunk_length(F.col("m"), 10.0)).alias("trunk_min"))


SCALE = BODIES + f""", tl AS (SELECT clip, body, CASE WHEN {TRUNK('m')} > 1 THEN {TRUNK('m')} END AS t, list_max(list_transform(k, lambda p: p.y)) - list_min(list_transform(k, lambda p: p.y)) AS h FROM mb),
 sc AS (SELECT clip, body, CASE WHEN count(t) >= 6 THEN quantile_cont(t, 0.5) WHEN count(*) FILTER (h > 1) >= 6 THEN 0.3::DOUBLE * quantile_cont(h, 0.5) END AS scale, CASE WHEN count(t) >= 6 THEN 'trunk_median' WHEN count(*) FILTER (h > 1) >= 6 THEN 'bbox_height' ELSE 'unavailable' END AS method FROM tl GROUP BY clip, body)"""


def body_scale(b, min_frames):
    """Median trunk length per (clip, body) if enough frames, else 0.3 of the median box height."""
    ys = F.transform("k", lambda p: p["y"])
    t = b.select("clip", "body", G.trunk_length(F.col("m"), 1.0).alias("t"), (F.array_max(ys) - F.array_min(ys)).alias("h"))
    qt = quantiles(t, ["clip", "body"], "t", {"mt": 0.5}).withColumnRenamed("n", "nt")
    qh = quantiles(t.where(F.col("h") > 1), ["clip", "body"], "h", {"mh": 0.5}).withColumnRenamed("n", "nh")
    j = qt.join(qh, ["clip", "body"], "full")
    use_t, use_h = F.coalesce("nt", F.lit(0)) >= min_frames, F.coalesce("nh", F.lit(0)) >= min_frames
    return j.select("clip", "body", F.when(use_t, F.col("mt")).when(use_h, 0.3 * F.col("mh")).alias("scale"),
                    F.when(use_t, "trunk_median").when(use_h, "bbox_height").otherwise("unavailable").alias("method"))


@query("body_scale", sql("pose", SCALE + f" SELECT clip, body, {rr('scale')} AS scale, method FROM sc"))
def _(spark, sf):
    return body_scale(bodies(spark, sf), 6).select("clip", "body", r("scale").alias("scale"), "method")


@query("unit_scale", sql("pose", SCALE + f" SELECT mb.clip, frame, mb.body, {rr(MX('m', 11, 12) + ' / scale')} AS pelvis_x_u, {rr(MX('m', 11, 12) + ' / 120')} AS pelvis_x_m FROM mb JOIN sc USING (clip, body)"))
def _(spark, sf):
    b = bodies(spark, sf)
    px = G.pelvis(F.col("m"))[0]
    return b.join(body_scale(b, 6), ["clip", "body"]).select("clip", "frame", "body", r(px / F.col("scale")).alias("pelvis_x_u"), r(px / 120).alias("pelvis_x_m"))


PD = lambda i, j: D(f"{MX('a', i, j)} - {MX('b', i, j)}", f"{MY('a', i, j)} - {MY('b', i, j)}")


@query("part_distance", sql("posep", PAIRS + f" SELECT clip, frame, {rr(PD(11, 12))} AS pelvis, {rr(D('(' + '+'.join(X('a', i) for i in (5, 6, 11, 12)) + ')/4 - (' + '+'.join(X('b', i) for i in (5, 6, 11, 12)) + ')/4', '(' + '+'.join(Y('a', i) for i in (5, 6, 11, 12)) + ')/4 - (' + '+'.join(Y('b', i) for i in (5, 6, 11, 12)) + ')/4'))} AS torso FROM mp"))
def _(spark, sf):
    a, b = F.col("ma"), F.col("mb")
    d = lambda f: G.norm(f(a)[0] - f(b)[0], f(a)[1] - f(b)[1])
    return pairs(spark, sf).select("clip", "frame", r(d(G.pelvis)).alias("pelvis"), r(d(G.torso)).alias("torso"))


@query("diag_norm", sql("posep", PAIRS + f" SELECT clip, frame, {rr(PD(11, 12) + ' / sqrt(1280 * 1280 + 720 * 720)')} AS pelvis_norm FROM mp"))
def _(spark, sf):
    a, b = G.pelvis(F.col("ma")), G.pelvis(F.col("mb"))
    return pairs(spark, sf).select("clip", "frame", r(G.norm(a[0] - b[0], a[1] - b[1]) / (1280 ** 2 + 720 ** 2) ** 0.5).alias("pelvis_norm"))


@query("pair_join", sql("posep", "SELECT clip, count(*) AS n_pairs, min(frame) AS f0, max(frame) AS f1 FROM posep GROUP BY clip"))
def _(spark, sf):
    return V.pose_pair(spark, sf).groupBy("clip").agg(F.count("*").alias("n_pairs"), F.min("frame").alias("f0"), F.max("frame").alias("f1"))


KPD = """kpd AS (SELECT clip, frame, min(sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2))) AS d FROM (SELECT clip, frame, unnest(a) AS p, b FROM mp), unnest(b) AS u(q) WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY clip, frame)"""


@query("min_kp_distance", sql("posep", PAIRS + ", " + KPD + f" SELECT clip, frame, {rr('d')} AS d FROM kpd"))
def _(spark, sf):
    return pairs(spark, sf).select("clip", "frame", r(G.min_keypoint_distance(F.col("ma"), F.col("mb"))).alias("d")).where(F.col("d").isNotNull())


HH = lambda p, i, q, j: D(f"{X(p, i)} - {X(q, j)}", f"{Y(p, i)} - {Y(q, j)}")


@query("hand_hip_distance", sql("posep", f"h AS (SELECT clip, frame, list_transform(ka, lambda p: CASE WHEN p.c >= 0.25 THEN p END) AS a, list_transform(kb, lambda p: CASE WHEN p.c >= 0.25 THEN p END) AS b FROM posep) SELECT clip, frame, {rr('least(' + ', '.join([HH('a', 9, 'b', 11), HH('a', 10, 'b', 12), HH('b', 9, 'a', 11), HH('b', 10, 'a', 12)]) + ')')} AS d FROM h"))
def _(spark, sf):
    m = lambda c: G.masked(F.col(c), 0.25)
    return pairs(spark, sf).select("clip", "frame", r(G.hand_hip_distance(m("ka"), m("kb"))).alias("d"))


@query("contact_state_raw", sql("posep", PAIRS + ", " + KPD + " SELECT mp.clip, mp.frame, d / 12 < 0.35 AS contact FROM mp LEFT JOIN kpd USING (clip, frame)"))
def _(spark, sf):
    return pairs(spark, sf).select("clip", "frame", (G.min_keypoint_distance(F.col("ma"), F.col("mb")) / SC < 0.35).alias("contact"))


SEGV = "segs(s, r, i, j) AS (VALUES " + ", ".join(f"({s}, {REGIONS.index(n)}, {i + 1}, {j + 1})" for s, (n, i, j) in enumerate(SEGMENTS)) + ")"
PS = lambda p, a, b: (f"sqrt(power({p}x - ({a}x + greatest(0, least(1, (({p}x - {a}x) * ({b}x - {a}x) + ({p}y - {a}y) * ({b}y - {a}y)) / greatest(power({b}x - {a}x, 2) + power({b}y - {a}y, 2), 1e-9::DOUBLE))) * ({b}x - {a}x)), 2)"
                      f" + power({p}y - ({a}y + greatest(0, least(1, (({p}x - {a}x) * ({b}x - {a}x) + ({p}y - {a}y) * ({b}y - {a}y)) / greatest(power({b}x - {a}x, 2) + power({b}y - {a}y, 2), 1e-9::DOUBLE))) * ({b}y - {a}y)), 2))")
SEGP = SEGV + """, sp AS (SELECT clip, frame, u.s AS sa, v.s AS sb, u.r AS ra, v.r AS rb, a[u.i].x AS px, a[u.i].y AS py, a[u.j].x AS qx, a[u.j].y AS qy, b[v.i].x AS ux, b[v.i].y AS uy, b[v.j].x AS vx, b[v.j].y AS vy FROM mp, segs u, segs v
 WHERE a[u.i] IS NOT NULL AND a[u.j] IS NOT NULL AND b[v.i] IS NOT NULL AND b[v.j] IS NOT NULL)"""
SEGD = f"sd AS (SELECT clip, frame, sa, sb, ra, rb, least({PS('p', 'u', 'v')}, {PS('q', 'u', 'v')}, {PS('u', 'p', 'q')}, {PS('v', 'p', 'q')}) AS d FROM sp)"
CR = PAIRS + ", " + SEGP + ", " + SEGD + ", cr AS (SELECT clip, frame, d / 12 AS d, ra, rb FROM sd QUALIFY row_number() OVER (PARTITION BY clip, frame ORDER BY d / 12, ra * 6 + rb) = 1)"
RN = "CASE {c} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(REGIONS)) + " END"


@query("segment_distance", sql("posep", PAIRS + ", " + SEGP + ", " + SEGD + f" SELECT clip, frame, sa, sb, {rr('d')} AS d FROM sd WHERE sa = 8 AND sb = 4"))
def _(spark, sf):
    pick = lambda m, s: F.get(F.filter(G.segment_array(F.col(m)), lambda q: q["s"] == s), F.lit(0))
    p = pairs(spark, sf).select("clip", "frame", pick("ma", 8).alias("p"), pick("mb", 4).alias("q")).where(F.col("p").isNotNull() & F.col("q").isNotNull())
    return p.select("clip", "frame", F.col("p.s").alias("sa"), F.col("q.s").alias("sb"), r(G.segment_distance(F.col("p"), F.col("q"))).alias("d"))


@query("contact_regions", sql("posep", CR + f" SELECT clip, frame, {rr('d')} AS d, {RN.format(c='ra')} AS reg_a, {RN.format(c='rb')} AS reg_b FROM cr"))
def _(spark, sf):
    p = pairs(spark, sf).select("clip", "frame", nearest_regions(flat(F.col("ka")), flat(F.col("kb"))).alias("c")).where(F.col("c.d").isNotNull())
    return p.select("clip", "frame", r(F.col("c.d") / SC).alias("d"), G.region_name(F.floor(F.col("c.idx") / 6)).alias("reg_a"), G.region_name(F.col("c.idx") % 6).alias("reg_b"))


@query("pelvis_point", sql("pose", BODIES + f" SELECT clip, frame, body, {rr(MX('m', 11, 12))} AS x, {rr(MY('m', 11, 12))} AS y FROM mb"))
def _(spark, sf):
    x, y = G.pelvis(F.col("m"))
    return bodies(spark, sf).select("clip", "frame", "body", r(x).alias("x"), r(y).alias("y"))


@query("body_extents", sql("pose", BODIES + f""" SELECT clip, frame, body, {rr(FOOT('m'))} AS foot_y, {rr(MEAN2('m', 13, 14))} AS knee_y, {rr(MEAN2('m', 5, 6))} AS shoulder_y,
 {rr('list_min(list_transform(m, lambda p: p.x))')} AS x0, {rr('list_max(list_transform(m, lambda p: p.x))')} AS x1 FROM mb"""))
def _(spark, sf):
    m = F.col("m")
    return bodies(spark, sf).select("clip", "frame", "body", r(G.lowest_foot_y(m)).alias("foot_y"), r(G.knee_y(m)).alias("knee_y"), r(G.shoulder_y(m)).alias("shoulder_y"),
                                    r(G.x_extent(m)[0]).alias("x0"), r(G.x_extent(m)[1]).alias("x1"))


@query("level", sql("pose", BODIES + f" SELECT clip, frame, body, {rr(LEVEL('m'))} AS level FROM mb"))
def _(spark, sf):
    return bodies(spark, sf).select("clip", "frame", "body", r(G.level(F.col("m"), F.lit(SC))).alias("level"))


@query("level_class", sql("pose", BODIES + f" SELECT clip, frame, body, CASE WHEN {LEVEL('m')} >= 1.2 THEN 'standing' WHEN {LEVEL('m')} >= 0.6 THEN 'middle' WHEN {LEVEL('m')} < 0.6 THEN 'floor' END AS level FROM mb"))
def _(spark, sf):
    return bodies(spark, sf).select("clip", "frame", "body", G.level_class(G.level(F.col("m"), F.lit(SC))).alias("level"))


AER = f"""g AS (SELECT clip, frame, {MX('a', 11, 12)} AS pax, {MY('a', 11, 12)} AS pay, {MX('b', 11, 12)} AS pbx, {MY('b', 11, 12)} AS pby, {MEAN2('a', 5, 6)} AS sha, {MEAN2('b', 5, 6)} AS shb, {FOOT('a')} AS fa, {FOOT('b')} AS fb,
 list_min(list_transform(a, lambda p: p.x)) AS xa0, list_max(list_transform(a, lambda p: p.x)) AS xa1, list_min(list_transform(b, lambda p: p.x)) AS xb0, list_max(list_transform(b, lambda p: p.x)) AS xb1 FROM mp),
 aer AS (SELECT clip, frame, CASE WHEN pay IS NULL OR pby IS NULL OR sha IS NULL OR shb IS NULL THEN NULL WHEN sha > pby AND pbx > xa0 AND pbx < xa1 THEN -1 WHEN shb > pay AND pax > xb0 AND pax < xb1 THEN 1 ELSE 0 END AS support,
 NOT coalesce((fa - pay) / 12 >= 0.6 AND (fb - pby) / 12 >= 0.6, false) OR coalesce(pay < shb, false) OR coalesce(pby < sha, false) OR fa IS NULL OR fb IS NULL OR coalesce(abs(fa - fb) / 12 < 0.35, false) AS depth_ok FROM g)"""


@query("aerial_support", sql("posep", PAIRS + ", " + AER.replace("greatest(a[16].y, a[17].y)", "greatest(a[16].y, a[17].y)") + " SELECT clip, frame, support FROM aer"))
def _(spark, sf):
    return pairs(spark, sf).select("clip", "frame", G.aerial_support(F.col("ma"), F.col("mb"), F.lit(SC), F.lit(SC), F.lit(True)).alias("support"))


@query("same_depth", sql("posep", PAIRS + ", " + AER + " SELECT clip, frame, depth_ok FROM aer"))
def _(spark, sf):
    return pairs(spark, sf).select("clip", "frame", G.same_depth(F.col("ma"), F.col("mb"), F.lit(SC), F.lit(SC)).alias("depth_ok"))


def ang_sql(m, a, b, c):
    ux, uy, vx, vy = f"({X(m, a)} - {X(m, b)})", f"({Y(m, a)} - {Y(m, b)})", f"({X(m, c)} - {X(m, b)})", f"({Y(m, c)} - {Y(m, b)})"
    cos = f"({ux} * {vx} + {uy} * {vy}) / greatest({D(ux, uy)} * {D(vx, vy)}, 1e-9::DOUBLE)"
    return f"(CASE WHEN {cos} IS NOT NULL THEN degrees(acos(greatest(-1, least(1, {cos})))) END)"


PF_SQL = {"trunk_tilt": f"degrees(atan2(abs({MX('m', 5, 6)} - {MX('m', 11, 12)}), -({MY('m', 5, 6)} - {MY('m', 11, 12)})))", "inverted": f"({Y('m', 0)} - {MY('m', 11, 12)}) / 12",
          "knee_l": ang_sql("m", 11, 13, 15), "knee_r": ang_sql("m", 12, 14, 16), "hip_l": ang_sql("m", 5, 11, 13), "hip_r": ang_sql("m", 6, 12, 14), "elbow_l": ang_sql("m", 5, 7, 9), "elbow_r": ang_sql("m", 6, 8, 10),
          "arm_up_l": f"({MY('m', 5, 6)} - {Y('m', 9)}) / 12", "arm_up_r": f"({MY('m', 5, 6)} - {Y('m', 10)}) / 12", "level": LEVEL("m"), "stance_width": f"abs({X('m', 15)} - {X('m', 16)}) / 12"}


@query("pose_features", sql("pose", BODIES + " SELECT clip, frame, body, " + ", ".join(f"{rr(e)} AS {n}" for n, e in PF_SQL.items()) + " FROM mb"))
def _(spark, sf):
    return bodies(spark, sf).select("clip", "frame", "body", *[r(e).alias(n) for n, e in G.pose_features(F.col("m"), F.lit(SC)).items()])


CX, CY = f"(({MX('m', 5, 6)} + {MX('m', 11, 12)}) / 2)", f"(({MY('m', 5, 6)} + {MY('m', 11, 12)}) / 2)"
PM_SQL = {"level": PF_SQL["level"], "trunk_tilt": PF_SQL["trunk_tilt"], "inverted": PF_SQL["inverted"],
          **{f"{n}_{f}": f"{'least' if f == 'min' else 'greatest'}({PF_SQL[k + '_l']}, {PF_SQL[k + '_r']})" for n, k in (("knee", "knee"), ("hip", "hip"), ("elbow", "elbow"), ("armup", "arm_up")) for f in ("min", "max")},
          "openness": "list_avg(list_filter([" + ", ".join(D(f"{X('m', i)} - {CX}", f"{Y('m', i)} - {CY}") for i in (9, 10, 15, 16)) + "], lambda v: v IS NOT NULL)) / 12", "stance": PF_SQL["stance_width"]}


@query("posture_minmax", sql("pose", BODIES + " SELECT clip, frame, body, " + ", ".join(f"{rr(e)} AS {n}" for n, e in PM_SQL.items()) + " FROM mb"))
def _(spark, sf):
    return bodies(spark, sf).select("clip", "frame", "body", *[r(e).alias(n) for n, e in G.posture_minmax(F.col("m"), F.lit(SC)).items()])


CPTS = PAIRS + ", " + SEGP + """, sm AS (SELECT clip, frame, sa, sb, ra, rb, i.range AS i, j.range AS j, px + i.range / 10.0::DOUBLE * (qx - px) AS xa, py + i.range / 10.0::DOUBLE * (qy - py) AS ya, ux + j.range / 10.0::DOUBLE * (vx - ux) AS xb, uy + j.range / 10.0::DOUBLE * (vy - uy) AS yb
 FROM sp, range(11) i, range(11) j WHERE sa <> 1 AND sb <> 1),
 cp AS (SELECT clip, frame, sa, sb, any_value(ra) AS ra, any_value(rb) AS rb, arg_min({'i': i, 'j': j, 'xa': xa, 'ya': ya, 'xb': xb, 'yb': yb}, {'d': sqrt(power(xa - xb, 2) + power(ya - yb, 2)), 'o': i * 11 + j}) AS b, min(sqrt(power(xa - xb, 2) + power(ya - yb, 2))) AS d FROM sm GROUP BY clip, frame, sa, sb)"""


THR = 6.0


def located(spark, sf):
    return pairs(spark, sf).select("clip", "frame", contact_location(flat(F.col("ka")), flat(F.col("kb")), F.lit(THR)).alias("c"))


@query("contact_points", sql("posep", CPTS + f" SELECT clip, frame, {rr('d')} AS d, {RN.format(c='ra')} AS reg_a, {RN.format(c='rb')} AS reg_b, {rr('b.xa')} AS xa, {rr('b.ya')} AS ya, {rr('b.xb')} AS xb, {rr('b.yb')} AS yb FROM cp QUALIFY row_number() OVER (PARTITION BY clip, frame ORDER BY d, sa * 14 + sb) = 1"))
def _(spark, sf):
    p = located(spark, sf).where(F.col("c.d").isNotNull())
    return p.select("clip", "frame", r("c.d").alias("d"), G.region_name(F.col("c.ra")).alias("reg_a"), G.region_name(F.col("c.rb")).alias("reg_b"),
                    *[r(f"c.{n}").alias(n) for n in ("xa", "ya", "xb", "yb")])


@query("contact_centroids", sql("posep", CPTS + f""", w AS (SELECT *, greatest(0, 6 - d) AS w FROM cp), ra_ AS (SELECT clip, frame, ra, sum(w) AS s FROM w GROUP BY ALL HAVING sum(w) > 0), rb_ AS (SELECT clip, frame, rb, sum(w) AS s FROM w GROUP BY ALL HAVING sum(w) > 0)
 SELECT c.*, {RN.format(c='x.ra')} AS reg_a, {RN.format(c='y.rb')} AS reg_b FROM (SELECT clip, frame, {rr('sum(w * b.xa) / sum(w)')} AS xa, {rr('sum(w * b.ya) / sum(w)')} AS ya, {rr('sum(w * b.xb) / sum(w)')} AS xb, {rr('sum(w * b.yb) / sum(w)')} AS yb FROM w GROUP BY clip, frame HAVING sum(w) > 0) c
 JOIN (SELECT * FROM ra_ QUALIFY row_number() OVER (PARTITION BY clip, frame ORDER BY s DESC, ra) = 1) x USING (clip, frame) JOIN (SELECT * FROM rb_ QUALIFY row_number() OVER (PARTITION BY clip, frame ORDER BY s DESC, rb) = 1) y USING (clip, frame)"""))
def _(spark, sf):
    p = located(spark, sf).where(F.col("c.cxa").isNotNull())
    return p.select("clip", "frame", *[r(f"c.c{n}").alias(n) for n in ("xa", "ya", "xb", "yb")], G.region_name(F.col("c.dra")).alias("reg_a"), G.region_name(F.col("c.drb")).alias("reg_b"))


CH = "ch(s, x1, y1, x2, y2) AS (VALUES " + ", ".join(f"({s}, {CHART[i][0]}::DOUBLE, {CHART[i][1]}::DOUBLE, {CHART[j][0]}::DOUBLE, {CHART[j][1]}::DOUBLE)" for s, (_, i, j) in enumerate(SEGMENTS)) + ")"


@query("contact_surface", sql("posep", CPTS + ", " + CH + f""", w AS (SELECT *, greatest(0, 6 - d) AS w FROM cp) SELECT clip, frame, {rr('abs(sum(w * (p.x1 + b.i / 10.0::DOUBLE * (p.x2 - p.x1))) / sum(w))')} AS xa, {rr('sum(w * (p.y1 + b.i / 10.0::DOUBLE * (p.y2 - p.y1))) / sum(w)')} AS ya,
 {rr('abs(sum(w * (q.x1 + b.j / 10.0::DOUBLE * (q.x2 - q.x1))) / sum(w))')} AS xb, {rr('sum(w * (q.y1 + b.j / 10.0::DOUBLE * (q.y2 - q.y1))) / sum(w)')} AS yb FROM w JOIN ch p ON p.s = sa JOIN ch q ON q.s = sb GROUP BY clip, frame HAVING sum(w) > 0"""))
def _(spark, sf):
    return located(spark, sf).where(F.col("c.sxa").isNotNull()).select("clip", "frame", *[r(f"c.s{n}").alias(n) for n in ("xa", "ya", "xb", "yb")])


@query("body_frame", sql("posep", PAIRS + f""", f AS (SELECT clip, frame, {MX('a', 11, 12)} AS hx, {MY('a', 11, 12)} AS hy, {MX('a', 5, 6)} - {MX('a', 11, 12)} AS ux, {MY('a', 5, 6)} - {MY('a', 11, 12)} AS uy, {X('b', 9)} AS px, {Y('b', 9)} AS py FROM mp)
 SELECT clip, frame, {rr('((px - hx) * uy - (py - hy) * ux) / greatest(sqrt(ux * ux + uy * uy), 1e-6::DOUBLE) / 12')} AS u, {rr('((px - hx) * ux + (py - hy) * uy) / greatest(sqrt(ux * ux + uy * uy), 1e-6::DOUBLE) / 12')} AS v FROM f"""))
def _(spark, sf):
    x, y = G.xy(F.col("mb"), 9)
    u, v = G.body_frame(F.col("ma"), x, y, F.lit(SC))
    return pairs(spark, sf).select("clip", "frame", r(u).alias("u"), r(v).alias("v"))


@query("contraction_index", sql("pose", BODIES + f""", e AS (SELECT clip, frame, body, unnest(m) AS p FROM mb), c AS (SELECT clip, frame, body, avg(p.x) AS cx, avg(p.y) AS cy, count(p) AS n FROM e GROUP BY ALL)
 SELECT clip, frame, body, {rr('avg(sqrt(power(p.x - cx, 2) + power(p.y - cy, 2))) / 12')} AS contraction FROM e JOIN c USING (clip, frame, body) WHERE n >= 5 GROUP BY clip, frame, body"""))
def _(spark, sf):
    return bodies(spark, sf).select("clip", "frame", "body", r(G.contraction_index(F.col("m"), F.lit(SC))).alias("contraction")).where(F.col("contraction").isNotNull())


@query("bounding_area", sql("pose", BODIES + f""", e AS (SELECT clip, frame, body, unnest(m) AS p FROM mb) SELECT clip, frame, body, {rr('CASE WHEN count(p) >= 5 THEN (max(p.x) - min(p.x)) * (max(p.y) - min(p.y)) / 144 END')} AS area FROM e GROUP BY clip, frame, body"""))
def _(spark, sf):
    return bodies(spark, sf).select("clip", "frame", "body", r(G.bounding_area(F.col("m"), F.lit(SC))).alias("area"))


@query("dir_similarity", sql("duet", f"""v AS (SELECT clip, frame, ax - lag(ax) OVER w AS vax, ay - lag(ay) OVER w AS vay, bx - lag(bx) OVER w AS vbx, "by" - lag("by") OVER w AS vby FROM duet WINDOW w AS (PARTITION BY clip ORDER BY frame))
 SELECT clip, frame, {rr('CASE WHEN sqrt(vax*vax+vay*vay) * sqrt(vbx*vbx+vby*vby) > 1e-9 THEN greatest(-1, least(1, (vax*vbx+vay*vby) / (sqrt(vax*vax+vay*vay) * sqrt(vbx*vbx+vby*vby)))) END')} AS cos FROM v"""))
def _(spark, sf):
    from pairlane.operators.ordered import over_neighbours
    d = over_neighbours(V.duet(spark, sf), ["clip"], {f"v{c}": (lambda c: lambda w: F.col(c) - F.lag(c).over(w))(c) for c in ("ax", "ay", "bx", "by")}, back=1)
    return d.select("clip", "frame", r(G.dir_similarity(*[F.col(c) for c in ("vax", "vay", "vbx", "vby")])).alias("cos"))


WD = lambda e: f"((({e}) + 180) - 360 * floor((({e}) + 180) / 360) - 180)"
UP = lambda m: f"atan2({MX(m, 5, 6)} - {MX(m, 11, 12)}, -({MY(m, 5, 6)} - {MY(m, 11, 12)}))"
LA = lambda m: [WD(f"degrees(atan2({X(m, j)} - {X(m, i)}, -({Y(m, j)} - {Y(m, i)})) - {UP(m)})") for _, i, j, _ in LIMBS] + [f"degrees({UP(m)})"]


@query("segment_angles", sql("pose", BODIES + " SELECT clip, frame, body, " + ", ".join(f"{rr(e)} AS {n}" for n, e in zip([x[0] for x in LIMBS] + ["lean"], LA("m"))) + " FROM mb"))
def _(spark, sf):
    b = bodies(spark, sf).select("clip", "frame", "body", G.limb_angles(F.col("m")).alias("g"))
    return b.select("clip", "frame", "body", *[r(F.get("g", F.lit(i))).alias(n) for i, n in enumerate([x[0] for x in LIMBS] + ["lean"])])


WTS = [x[3] for x in LIMBS] + [2.0]


def angd_sql(order, sign):
    d = [f"greatest(0, abs({WD(f'ga[{i + 1}] - {sign} * gb[{order[i] + 1}]')}) - 10)" for i in range(9)]
    ok = [f"ga[{i + 1}] IS NOT NULL AND gb[{order[i] + 1}] IS NOT NULL" for i in range(9)]
    tot = "(" + " + ".join(f"CASE WHEN {o} THEN {w}::DOUBLE ELSE 0 END" for o, w in zip(ok, WTS)) + ")"
    acc = "(" + " + ".join(f"CASE WHEN {o} THEN {w}::DOUBLE * {e} ELSE 0 END" for o, w, e in zip(ok, WTS, d)) + ")"
    return f"CASE WHEN {tot} >= 0.7::DOUBLE * {sum(WTS)}::DOUBLE THEN {acc} / {tot} END"


ANG = PAIRS + f", ga AS (SELECT clip, frame, [{', '.join(LA('a'))}] AS ga, [{', '.join(LA('b'))}] AS gb FROM mp)"


@query("angular_distance", sql("posep", ANG + f" SELECT clip, frame, {rr(angd_sql(list(range(9)), 1))} AS same_side, {rr(angd_sql([4, 5, 6, 7, 0, 1, 2, 3, 8], -1))} AS mirror FROM ga"))
def _(spark, sf):
    p = pairs(spark, sf).select("clip", "frame", G.limb_angles(F.col("ma")).alias("ga"), G.limb_angles(F.col("mb")).alias("gb"))
    return p.select("clip", "frame", r(G.angular_distance(F.col("ga"), F.col("gb"))).alias("same_side"), r(G.angular_distance(F.col("ga"), F.col("gb"), True)).alias("mirror"))


@query("upright", sql("pose", BODIES + f""" SELECT clip, frame, body, coalesce({LEVEL('m', '6')}, 0) >= 1.2 AND coalesce(({MEAN2('m', 11, 12)} - {MEAN2('m', 5, 6)}) / 6 >= 0.7, false) AND (coalesce(({Y('m', 15)} - {Y('m', 13)}) / 6 >= 0.45 AND ({Y('m', 13)} - {Y('m', 11)}) / 6 >= 0.35, false)
 OR coalesce(({Y('m', 16)} - {Y('m', 14)}) / 6 >= 0.45 AND ({Y('m', 14)} - {Y('m', 12)}) / 6 >= 0.35, false)) AS upright FROM mb"""))
def _(spark, sf):
    return bodies(spark, sf).select("clip", "frame", "body", G.upright(F.col("m"), F.lit(6.0)).alias("upright"))


@query("bbox_iou", sql("det", f"""l AS (SELECT *, lead(x1) OVER w AS u1, lead(y1) OVER w AS v1, lead(x2) OVER w AS u2, lead(y2) OVER w AS v2 FROM det WINDOW w AS (PARTITION BY clip, frame ORDER BY track_id))
 SELECT clip, frame, track_id, {rr('i / ((x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - i)')} AS iou FROM (SELECT *, greatest(0, least(x2, u2) - greatest(x1, u1)) * greatest(0, least(y2, v2) - greatest(y1, v1)) AS i FROM l WHERE u1 IS NOT NULL)"""))
def _(spark, sf):
    """Overlap of each box with the next one in its frame."""
    from pyspark.sql import Window as W
    d = V.detections(spark, sf)
    box = F.struct("x1", "y1", "x2", "y2")
    nxt = F.lead(box).over(W.partitionBy("clip", "frame").orderBy("track_id"))
    d = d.select("clip", "frame", "track_id", box.alias("a"), nxt.alias("b")).where(F.col("b").isNotNull())
    return d.select("clip", "frame", "track_id", r(G.iou(F.col("a"), F.col("b"))).alias("iou"))


@query("edge_partial_filter", sql("pose", BODIES + f" SELECT clip, frame, body, {rr('list_max(list_transform(k, lambda p: p.y))')} AS y2 FROM mb WHERE NOT (list_max(list_transform(k, lambda p: p.y)) >= 20 AND m[12] IS NULL AND m[13] IS NULL)"))
def _(spark, sf):
    y2 = F.array_max(F.transform("k", lambda p: p["y"]))
    m = F.col("m")
    return bodies(spark, sf).where(~((y2 >= 20) & G.at(m, 11).isNull() & G.at(m, 12).isNull())).select("clip", "frame", "body", r(y2).alias("y2"))


MARK_SQL = "mk AS (SELECT label AS clip, vec_id AS frame, m.range AS marker, embedding[3 * m.range + 1]::DOUBLE * 100 AS x, embedding[3 * m.range + 2]::DOUBLE * 100 AS y, embedding[3 * m.range + 3]::DOUBLE * 100 AS z FROM embeddings, range(21) m)"


def markers(spark, sf):
    """21 three-dimensional markers per frame folded from embeddings, as an array of struct(x, y, z)."""
    e = V.table(spark, sf, "embeddings").select(F.col("label").alias("clip"), F.col("vec_id").alias("frame"), F.transform("embedding", lambda v: v.cast("double") * 100).alias("e"))
    return e.select("clip", "frame", F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(
        F.get("e", i * 3).alias("x"), F.get("e", i * 3 + 1).alias("y"), F.get("e", i * 3 + 2).alias("z"))).alias("mk"))


MAP = [(k, MARKERS.index(n)) for k, ns in enumerate(MARKERS_OF_KEYPOINT) for n in ns]
MAPV = "mp_(kp, marker) AS (VALUES " + ", ".join(f"({k}, {m})" for k, m in MAP) + ")"


def keypoints3(mk):
    """17 keypoints as means of their markers: array of struct(x, y, z)."""
    mean = lambda c, ns: sum((F.get(mk, F.lit(MARKERS.index(n)))[c] for n in ns), F.lit(0.0)) / len(ns)
    return F.array(*[F.struct(mean("x", ns).alias("x"), mean("y", ns).alias("y"), mean("z", ns).alias("z")) for ns in MARKERS_OF_KEYPOINT])


@query("marker_to_coco", "WITH " + MARK_SQL + ", " + MAPV + f" SELECT clip, frame, kp, {rr('avg(x)')} AS x, {rr('avg(y)')} AS y, {rr('avg(z)')} AS z FROM mk JOIN mp_ USING (marker) GROUP BY clip, frame, kp")
def _(spark, sf):
    return markers(spark, sf).select("clip", "frame", F.posexplode(keypoints3(F.col("mk"))).alias("kp", "p")).select(
        "clip", "frame", "kp", r("p.x").alias("x"), r("p.y").alias("y"), r("p.z").alias("z"))


@query("vertical_axis", "WITH " + MARK_SQL + """, d AS (SELECT a.clip, a.x - b.x AS x, a.y - b.y AS y, a.z - b.z AS z FROM mk a JOIN mk b ON a.clip = b.clip AND a.frame = b.frame AND a.marker = 0 AND b.marker = 18),
 q AS (SELECT clip, abs(quantile_cont(x, 0.5)) AS x, abs(quantile_cont(y, 0.5)) AS y, abs(quantile_cont(z, 0.5)) AS z FROM d GROUP BY clip) SELECT clip, CASE WHEN x >= y AND x >= z THEN 0 WHEN y >= z THEN 1 ELSE 2 END AS up_axis, """ + rr("greatest(x, y, z)") + " AS height FROM q")
def _(spark, sf):
    a, b = F.get("mk", F.lit(0)), F.get("mk", F.lit(18))
    d = markers(spark, sf).select("clip", F.explode(F.array(*[F.struct(F.lit(i).alias("ax"), (a[c] - b[c]).alias("v")) for i, c in enumerate("xyz")])).alias("s")).select("clip", "s.*")
    q = quantiles(d, ["clip", "ax"], "v", {"m": 0.5})
    return q.groupBy("clip").agg(F.min_by("ax", F.struct(-F.abs("m"), F.col("ax"))).alias("up_axis"), r(F.max(F.abs("m"))).alias("height"))


@query("ortho_project", "WITH " + MARK_SQL + ", " + MAPV + f" SELECT clip, frame, kp, {rr('avg(x) / 12 * 100')} AS u, {rr('-avg(z) / 12 * 100')} AS v FROM mk JOIN mp_ USING (marker) GROUP BY clip, frame, kp")
def _(spark, sf):
    """Orthographic view along y, z up, 12 units = 100 px."""
    k = markers(spark, sf).select("clip", "frame", F.posexplode(keypoints3(F.col("mk"))).alias("kp", "p"))
    return k.select("clip", "frame", "kp", r(F.col("p.x") / 12 * 100).alias("u"), r(-F.col("p.z") / 12 * 100).alias("v"))


@query("posture_3d", "WITH " + MARK_SQL + f""", g AS (SELECT clip, frame, avg(x) FILTER (marker IN (4, 13)) AS cx, avg(y) FILTER (marker IN (4, 13)) AS cy, avg(z) FILTER (marker IN (4, 13)) AS cz, avg(x) FILTER (marker < 4) AS hx, avg(y) FILTER (marker < 4) AS hy, avg(z) FILTER (marker < 4) AS hz,
 avg(z) FILTER (marker IN (8, 9)) AS lz, avg(z) FILTER (marker IN (11, 12)) AS rz, min(z) FILTER (marker IN (17, 18, 20)) AS low FROM mk GROUP BY clip, frame)
 SELECT clip, frame, {rr('(cz - low) / 12')} AS level, {rr('degrees(atan2(sqrt(power(hx - cx, 2) + power(hy - cy, 2)), hz - cz))')} AS trunk_tilt, {rr('(cz - hz) / 12')} AS inverted, {rr('least(lz - hz, rz - hz) / 12')} AS armup_min, {rr('greatest(lz - hz, rz - hz) / 12')} AS armup_max FROM g""")
def _(spark, sf):
    g = lambda c, ids: sum((F.get("mk", F.lit(i))[c] for i in ids), F.lit(0.0)) / len(ids)
    c, h = [g(a, (4, 13)) for a in "xyz"], [g(a, range(4)) for a in "xyz"]
    low = F.least(*[F.get("mk", F.lit(i))["z"] for i in (17, 18, 20)])
    lz, rz = g("z", (8, 9)), g("z", (11, 12))
    return markers(spark, sf).select("clip", "frame", r((c[2] - low) / 12).alias("level"), r(F.degrees(F.atan2(G.norm(h[0] - c[0], h[1] - c[1]), h[2] - c[2]))).alias("trunk_tilt"),
                                     r((c[2] - h[2]) / 12).alias("inverted"), r(F.least(lz - h[2], rz - h[2]) / 12).alias("armup_min"), r(F.greatest(lz - h[2], rz - h[2]) / 12).alias("armup_max"))


@query("add_noise", sql("pose", f"SELECT clip, frame, body, {rr('k[1].x + 0.5::DOUBLE * ((vec_id * 7919 % 1000) / 500.0::DOUBLE - 1)')} AS x FROM pose"))
def _(spark, sf):
    """Deterministic offset in [-0.5, 0.5) derived from the row id, so that reruns and lost tasks agree."""
    p = V.pose(spark, sf)
    return p.select("clip", "frame", "body", r(G.at(F.col("k"), 0)["x"] + 0.5 * (F.col("vec_id") * 7919 % 1000 / 500.0 - 1)).alias("x"))


@query("classify_figure", """WITH l AS (SELECT p_partkey, lower(p_type || ' ' || p_name) AS s FROM part) SELECT p_partkey, CASE WHEN regexp_matches(s, 'economy|small.*ring') THEN 'travel' WHEN regexp_matches(s, 'standard') THEN 'closed' WHEN contains(s, 'promo') AND (contains(s, 'ring') OR contains(s, 'box')) THEN 'turn' WHEN contains(s, 'large') OR contains(s, 'box') THEN 'open' ELSE 'other' END AS cls,
 CASE WHEN contains(s, 'ring') AND contains(s, 'small') THEN 'both' WHEN contains(s, 'ring') THEN 'follower' WHEN contains(s, 'small') THEN 'leader' ELSE 'none' END AS target FROM l""")
def _(spark, sf):
    """Ordered keyword rules: first match wins."""
    s = F.lower(F.concat_ws(" ", "p_type", "p_name"))
    has = lambda w: F.contains(s, F.lit(w))
    cls = (F.when(s.rlike("economy|small.*ring"), "travel").when(s.rlike("standard"), "closed")
           .when(has("promo") & (has("ring") | has("box")), "turn").when(has("large") | has("box"), "open").otherwise("other"))
    tgt = F.when(has("ring") & has("small"), "both").when(has("ring"), "follower").when(has("small"), "leader").otherwise("none")
    return V.table(spark, sf, "part").select("p_partkey", cls.alias("cls"), tgt.alias("target"))


@query("clip_filters", """WITH c AS (SELECT DISTINCT source, lang FROM documents), v AS (SELECT source || '_' || lang AS v FROM c UNION ALL SELECT source || '_' || lang || '_full' FROM c WHERE lang = 'en') SELECT v FROM v WHERE v || '_full' NOT IN (SELECT v FROM v)""")
def _(spark, sf):
    """Prefer the full version of a clip: drop names whose `_full` twin exists."""
    c = V.table(spark, sf, "documents").select("source", "lang").distinct()
    name = F.concat_ws("_", "source", "lang")
    v = c.select(name.alias("v")).unionByName(c.where(F.col("lang") == "en").select(F.concat(name, F.lit("_full")).alias("v")))
    return v.join(v.select(F.col("v").alias("full")), F.concat("v", F.lit("_full")) == F.col("full"), "left_anti")
