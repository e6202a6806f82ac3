"""Gaps, islands, smoothing and derivatives over the frame tables."""
from pyspark.sql import functions as F

from pairlane.functions.mathx import probit_sql
from pairlane.operators import series as S
from pairlane.operators.ordered import islands, over_neighbours, quantiles, running
from pairlane.operators.steps import (Step, apply_steps, dist, ffill, fill_small_gaps, gradient, majority5, remove_teleports,
                                      rolling, savgol, sg_matrix, shifted, sustained)
from pairlane.sources import views as V

from .registry import query
from .sources import r, rr
from .views_sql import with_views as sql

K = ["clip", "body"]
PW = "PARTITION BY clip, body ORDER BY frame"


def track(spark, sf):
    return V.long_track(V.duet(spark, sf))


def at(c, o):
    return c if o == 0 else f"lag({c}, {-o}) OVER w" if o < 0 else f"lead({c}, {o}) OVER w"


def dot_sql(c, weights, i):
    return "(" + " + ".join(f"({at(c, j - i)}) * ({float(v)!r}::DOUBLE)" for j, v in enumerate(weights)) + ")"


def fill_sql(c, n, out, src):
    """CTE body: linear fill of bounded gaps of at most n rows."""
    return f"""SELECT *, coalesce({c} IS NULL AND nf - pf - 1 <= {n}, false) AS fl_{c}, CASE WHEN {c} IS NULL AND nf - pf - 1 <= {n} THEN pv + (nv - pv) * ((frame - pf)::DOUBLE / (nf - pf)) ELSE {c} END AS {out} FROM (
 SELECT *, last_value({c} IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN {c} IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS pf,
 first_value({c} IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN {c} IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS nf FROM {src}
 WINDOW b AS ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS ({PW} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


def filled_sql(src="track", n=2):
    return (f"f1 AS ({fill_sql('x', n, 'xf', src)}), f2 AS ({fill_sql('y', n, 'yf', '(SELECT clip, body, frame, x, y, xf, fl_x FROM f1)')})")


def sg_sql(window, derivs, fps, run_min, x="xf", y="yf", src="f2", poly=3):
    """CTE text: run-wise Savitzky-Golay columns d0x, d0y, d1x, ..."""
    half, cols = window // 2, []
    for d in derivs:
        m = sg_matrix(window, poly, d, 1.0 / fps)
        for c, nm in ((x, "x"), (y, "y")):
            e = f"CASE WHEN NOT ok OR n < {run_min} THEN NULL WHEN i >= {half} AND n - 1 - i >= {half} THEN {dot_sql(c, m[half], half)}"
            if d == 0:
                for k in range(half):
                    e += f" WHEN i = {k} THEN {dot_sql(c, m[k], k)} WHEN n - 1 - i = {k} THEN {dot_sql(c, m[window - 1 - k], window - 1 - k)}"
            cols.append(e + f" END AS d{d}{nm}")
    return f"""rn AS (SELECT *, {x} IS NOT NULL AND {y} IS NOT NULL AS ok, frame - row_number() OVER (PARTITION BY clip, body, {x} IS NOT NULL AND {y} IS NOT NULL ORDER BY frame) AS grp FROM {src}),
rl AS (SELECT *, count(*) OVER (PARTITION BY clip, body, ok, grp) AS n, row_number() OVER (PARTITION BY clip, body, ok, grp ORDER BY frame) - 1 AS i FROM rn),
sg AS (SELECT *, {", ".join(cols)} FROM rl WINDOW w AS (PARTITION BY clip, body, ok, grp ORDER BY frame))"""


@query("valid_runs", sql("duet track", "SELECT clip, body, min(frame) AS start, max(frame) + 1 AS \"end\" FROM (SELECT clip, body, frame, frame - row_number() OVER (" + PW + ") AS g FROM track WHERE x IS NOT NULL) GROUP BY clip, body, g"))
def _(spark, sf):
    return S.valid_runs(track(spark, sf), K, F.col("x").isNotNull())


@query("fill_small_gaps", sql("duet track", f"f AS ({fill_sql('x', 2, 'xf', 'track')}) SELECT clip, body, frame, {rr('xf')} AS xf, fl_x AS filled FROM f"))
def _(spark, sf):
    t = apply_steps(track(spark, sf), K, fill_small_gaps("x", 2, "xf", "filled"))
    return t.select("clip", "body", "frame", r("xf").alias("xf"), "filled")


def tele_sql(limit):
    return (f"tele AS (SELECT clip, body, frame, CASE WHEN NOT far THEN x END AS x, CASE WHEN NOT far THEN y END AS y, far FROM (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) > {limit}, false) AS far "
            f"FROM track WINDOW w AS ({PW})))")


TELE = tele_sql(60)


@query("remove_teleports", sql("duet track", TELE + f" SELECT clip, body, frame, {rr('x')} AS x, {rr('y')} AS y, far AS teleport FROM tele"))
def _(spark, sf):
    t = apply_steps(track(spark, sf), K, remove_teleports("x", "y", 60.0, "teleport"))
    return t.select("clip", "body", "frame", r("x").alias("x"), r("y").alias("y"), "teleport")


CAM_SQL = """p AS (SELECT clip, frame, ax AS x, ay AS y, m00, m01, m02, m10, m11, m12, m00 IS NULL AS badm FROM duet),
r0 AS (SELECT *, frame - row_number() OVER (PARTITION BY clip ORDER BY frame) AS run, lag(x) OVER (PARTITION BY clip ORDER BY frame) AS px, lag(y) OVER (PARTITION BY clip ORDER BY frame) AS py FROM p WHERE x IS NOT NULL AND y IS NOT NULL),
r1 AS (SELECT *, row_number() OVER (PARTITION BY clip, run ORDER BY frame) - 1 AS i FROM r0),
r2 AS (SELECT *, i - row_number() OVER (PARTITION BY clip, run, badm ORDER BY frame) AS st FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY clip, run, badm, st ORDER BY frame) - 1 AS pos, min(i) OVER (PARTITION BY clip, run, badm, st) AS i0 FROM r2),
r4 AS (SELECT *, badm AND (CASE WHEN i0 = 0 THEN pos % 2 = 1 ELSE pos % 2 = 0 END) AS blocked FROM r3),
r5 AS (SELECT *, NOT blocked AND (i = 0 OR lag(blocked) OVER (PARTITION BY clip, run ORDER BY frame)) AS seed FROM r4),
r6 AS (SELECT *, sum(CASE WHEN seed OR blocked THEN 1 ELSE 0 END) OVER (PARTITION BY clip, run ORDER BY frame) AS seg FROM r5),
q AS (SELECT clip, frame, CASE WHEN NOT blocked THEN sum(CASE WHEN seed THEN x ELSE x - (m00 * px + m01 * py + m02) END) OVER v END AS qx,
 CASE WHEN NOT blocked THEN sum(CASE WHEN seed THEN y ELSE y - (m10 * px + m11 * py + m12) END) OVER v END AS qy,
 CASE WHEN NOT blocked AND NOT seed THEN sqrt(abs(m00 * m11 - m01 * m10)) END AS zoom FROM r6 WINDOW v AS (PARTITION BY clip, run, seg ORDER BY frame))"""


def camera(spark, sf):
    d = V.duet(spark, sf).select("clip", "frame", F.col("ax").alias("x"), F.col("ay").alias("y"), "m00", "m01", "m02", "m10", "m11", "m12")
    return S.compensate_camera(d, ["clip"])


@query("compensate_camera", sql("duet", CAM_SQL + f" SELECT d.clip, d.frame, {rr('qx', 5)} AS qx, {rr('qy', 5)} AS qy, {rr('zoom')} AS zoom FROM duet d LEFT JOIN q USING (clip, frame)"))
def _(spark, sf):
    return camera(spark, sf).select("clip", "frame", r("qx", 5).alias("qx"), r("qy", 5).alias("qy"), r("zoom").alias("zoom"))


@query("compensate_camera_info", sql("duet", CAM_SQL + f""" SELECT clip, count(qx) AS n_compensated, {rr('count(qx)::DOUBLE / greatest(1, count(*))')} AS fraction,
 {rr('quantile_cont(abs(zoom - 1), 0.95)')} AS zoom_p95 FROM q GROUP BY clip"""))
def _(spark, sf):
    c = camera(spark, sf)
    frac = c.groupBy("clip").agg(F.count("qx").alias("n_compensated"), (F.count("qx") / F.greatest(F.lit(1), F.count("x"))).alias("fraction"))
    z = quantiles(c.withColumn("dz", F.abs(F.col("zoom") - 1)), ["clip"], "dz", {"zoom_p95": 0.95})
    return frac.join(z, "clip", "left").select("clip", "n_compensated", r("fraction").alias("fraction"), r("zoom_p95").alias("zoom_p95"))


SG11 = filled_sql() + ", " + sg_sql(11, (0, 1, 2, 3), 30.0, 11)


@query("sg_derivatives", sql("duet track", SG11 + f""" SELECT clip, body, frame, {rr('d0x', 5)} AS x_s, {rr('d0y', 5)} AS y_s, {rr('d1x', 5)} AS vx, {rr('d1y', 5)} AS vy, {rr('d2x', 4)} AS ax, {rr('d2y', 4)} AS ay,
 {rr('d3x', 2)} AS jx, {rr('d3y', 2)} AS jy, {rr('sqrt(power(xf - d0x, 2) + power(yf - d0y, 2))', 5)} AS residual, fl_x OR fl_y AS filled, d1x IS NOT NULL AND d3x IS NOT NULL AS valid_deriv FROM sg"""))
def _(spark, sf):
    t = S.sg_derivatives(track(spark, sf), K)
    return t.select("clip", "body", "frame", *[r(c, d).alias(n) for c, d, n in (
        ("x_s", 5, "x_s"), ("y_s", 5, "y_s"), ("vx", 5, "vx"), ("vy", 5, "vy"), ("axx", 4, "ax"), ("ayy", 4, "ay"), ("jx", 2, "jx"), ("jy", 2, "jy"), ("residual", 5, "residual"))], "filled", "valid_deriv")


@query("sg_generic", sql("duet track", filled_sql() + ", " + sg_sql(7, (0, 1), 15.0, 9) + f" SELECT clip, body, frame, {rr('d0x', 5)} AS x_s, {rr('d1x', 5)} AS vx, {rr('d1y', 5)} AS vy FROM sg"))
def _(spark, sf):
    t = apply_steps(track(spark, sf), K, fill_small_gaps("x", 2, "xf"), fill_small_gaps("y", 2, "yf"), savgol(["xf", "yf"], 15.0, 7, derivs=(0, 1), run_min=9))
    return t.select("clip", "body", "frame", r("xf_d0", 5).alias("x_s"), r("xf_d1", 5).alias("vx"), r("yf_d1", 5).alias("vy"))


@query("residual", sql("duet track", filled_sql() + ", " + sg_sql(11, (0,), 30.0, 11) + f" SELECT clip, body, frame, {rr('sqrt(power(xf - d0x, 2) + power(yf - d0y, 2))', 5)} AS residual FROM sg WHERE d0x IS NOT NULL"))
def _(spark, sf):
    return S.sg_derivatives(track(spark, sf), K).where(F.col("residual").isNotNull()).select("clip", "body", "frame", r("residual", 5).alias("residual"))


JIT = filled_sql() + ", " + sg_sql(11, (0,), 30.0, 11) + """, js AS (SELECT clip, body, count(d0x) AS n, CASE WHEN count(d0x) >= 50 THEN quantile_cont(sqrt(power(xf - d0x, 2) + power(yf - d0y, 2)), 0.5) / 1.1774::DOUBLE END AS sigma FROM sg GROUP BY clip, body HAVING count(d0x) > 0)"""


@query("jitter_sigma", sql("duet track", JIT + f" SELECT clip, body, n, {rr('sigma')} AS sigma FROM js"))
def _(spark, sf):
    j = S.jitter_sigma(S.sg_derivatives(track(spark, sf), K), K)
    return j.select("clip", "body", "n", r("sigma").alias("sigma"))


@query("jerk_noise_floor", sql("duet track", JIT + f" SELECT clip, body, {rr(f'sigma * {S.jerk_floor_factor(30.0)!r}::DOUBLE', 3)} AS jerk_floor FROM js"))
def _(spark, sf):
    j = S.jitter_sigma(S.sg_derivatives(track(spark, sf), K), K)
    return j.select("clip", "body", r(F.col("sigma") * S.jerk_floor_factor(30.0), 3).alias("jerk_floor"))


KIN_SQL = tele_sql(100) + ", " + filled_sql("tele") + ", " + sg_sql(11, (0, 1, 2, 3), 30.0, 11) + """, kin AS (SELECT clip, body, frame, CASE WHEN sp <= 120 THEN sp END AS speed, CASE WHEN sp <= 120 THEN sqrt(d2x * d2x + d2y * d2y) END AS accel,
 CASE WHEN sp <= 120 THEN sqrt(d3x * d3x + d3y * d3y) END AS jerk, CASE WHEN sp <= 120 THEN d1x END AS vx, CASE WHEN sp <= 120 THEN d1y END AS vy, coalesce(sp > 120, false) AS implausible, sp IS NOT NULL AND sp <= 120 AS valid_deriv FROM (SELECT *, sqrt(d1x * d1x + d1y * d1y) AS sp FROM sg))"""


def kinematics(spark, sf):
    return S.body_kinematics(track(spark, sf), K, 30.0, scale=40.0, max_jump=2.5, max_speed=3.0)


@query("body_kinematics", sql("duet track", KIN_SQL + f""" SELECT clip, body, frame, {rr('speed', 4)} AS speed, {rr('accel', 3)} AS accel, {rr('jerk', 2)} AS jerk, {rr('speed * speed', 2)} AS kinetic_energy, implausible, valid_deriv FROM kin"""))
def _(spark, sf):
    return kinematics(spark, sf).select("clip", "body", "frame", r("speed", 4).alias("speed"), r("accel", 3).alias("accel"), r("jerk", 2).alias("jerk"),
                                        r("kinetic_energy", 2).alias("kinetic_energy"), "implausible", "valid_deriv")


@query("kinematics_counters", sql("duet track", KIN_SQL + " SELECT k.clip, k.body, CAST(count(*) FILTER (implausible) AS BIGINT) AS n_implausible, CAST(count(*) FILTER (t.far) AS BIGINT) AS n_teleports, count(speed) AS n_speed FROM kin k JOIN tele t USING (clip, body, frame) GROUP BY k.clip, k.body"))
def _(spark, sf):
    return kinematics(spark, sf).groupBy("clip", "body").agg(F.count_if("implausible").alias("n_implausible"), F.count_if("teleport").alias("n_teleports"), F.count("speed").alias("n_speed"))


RM = lambda b, a, n, c="x", f="quantile_cont({c}, 0.5)": f"CASE WHEN count({c}) OVER (ROWSPEC {b} PRECEDING AND {a} FOLLOWING) >= {n} THEN {f.format(c=c)} OVER (ROWSPEC {b} PRECEDING AND {a} FOLLOWING) END".replace("ROWSPEC", PW + " ROWS BETWEEN")


@query("pelvis_kinematics", sql("duet track", TELE + f""", tr AS (SELECT clip, body, frame, x, y, {RM(7, 7, 3, 'y')} AS l0 FROM track),
 tl AS (SELECT clip, body, frame, coalesce(last_value(l0 IGNORE NULLS) OVER (PARTITION BY clip, body ORDER BY frame), first_value(l0 IGNORE NULLS) OVER (PARTITION BY clip, body ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS l FROM tr),
 """ + filled_sql("tele") + ", " + sg_sql(9, (0, 1, 2), 15.0, 11) + f""" SELECT clip, body, frame, {rr('sqrt(power(d1x / l, 2) + power(d1y / l, 2))', 5)} AS speed, {rr('2 * (d1x / l * d2x / l + d1y / l * d2y / l)', 3)} AS dke, {rr('sqrt(power(xf - d0x, 2) + power(yf - d0y, 2)) / l', 5)} AS jitter FROM sg JOIN tl USING (clip, body, frame)"""))
def _(spark, sf):
    """Kinematics in units of a rolling length (here: the rolling median of y)."""
    t = track(spark, sf).withColumn("len", F.col("y"))
    t = apply_steps(t, K, rolling("len", "l0", "median", 7, 7, 3), remove_teleports("x", "y", 60.0), fill_small_gaps("x", 2, "xf"),
                    fill_small_gaps("y", 2, "yf"), savgol(["xf", "yf"], 15.0, 9, derivs=(0, 1, 2), run_min=11))
    # only what the end needs goes on; before the first length a series takes that one
    t = t.select(*K, "frame", "l0", "xf_d1", "xf_d2", "yf_d1", "yf_d2", dist(F.col("xf") - F.col("xf_d0"), F.col("yf") - F.col("yf_d0")).alias("res"))
    t = running(t, K, {"lp": ("last", F.col("l0"))})
    first = t.where(F.col("l0").isNotNull()).groupBy(*K).agg(F.min_by("l0", "frame").alias("ln"))
    t = t.join(first, K, "left")
    l = F.coalesce("lp", "ln")
    v = lambda c: F.col(c) / l
    return t.select("clip", "body", "frame", r(dist(v("xf_d1"), v("yf_d1")), 5).alias("speed"),
                    r(2 * (v("xf_d1") * v("xf_d2") + v("yf_d1") * v("yf_d2")), 3).alias("dke"),
                    r(F.col("res") / l, 5).alias("jitter"))


@query("rolling_median", sql("duet track", f"SELECT clip, body, frame, {rr(RM(2, 2, 3))} AS med5, {rr(RM(22, 22, 9))} AS med45 FROM track"))
def _(spark, sf):
    t = apply_steps(track(spark, sf), K, rolling("x", "med5", "median", 2, 2, 3), rolling("x", "med45", "median", 22, 22, 9))
    return t.select("clip", "body", "frame", r("med5").alias("med5"), r("med45").alias("med45"))


@query("rolling_mean", sql("duet track", f"SELECT clip, body, frame, {rr(RM(7, 7, 1, 'x', 'avg({c})'))} AS mean15, {rr(RM(7, 7, 13, 'x', 'avg({c})'))} AS mean15_min13 FROM track"))
def _(spark, sf):
    t = apply_steps(track(spark, sf), K, rolling("x", "mean15", "mean", 7, 7), rolling("x", "mean15_min13", "mean", 7, 7, 13))
    return t.select("clip", "body", "frame", r("mean15").alias("mean15"), r("mean15_min13").alias("mean15_min13"))


FLAG = "fl AS (SELECT clip, body, frame, x, y, coalesce(x < 60, false) AS flag FROM track)"
M5 = f"""m5 AS (SELECT clip, body, frame, x, y, flag, (CASE WHEN flag THEN 1 ELSE 0 END + CASE WHEN coalesce(lag(flag, 1) OVER w, flag) THEN 1 ELSE 0 END + CASE WHEN coalesce(lag(flag, 2) OVER w, CASE WHEN lag(flag, 1) OVER w IS NULL THEN lead(flag, 1) OVER w ELSE lag(flag, 1) OVER w END) THEN 1 ELSE 0 END
 + CASE WHEN coalesce(lead(flag, 1) OVER w, flag) THEN 1 ELSE 0 END + CASE WHEN coalesce(lead(flag, 2) OVER w, CASE WHEN lead(flag, 1) OVER w IS NULL THEN lag(flag, 1) OVER w ELSE lead(flag, 1) OVER w END) THEN 1 ELSE 0 END) >= 3 AS m FROM fl WINDOW w AS ({PW}))"""


def flagged(spark, sf):
    return track(spark, sf).withColumn("flag", F.coalesce(F.col("x") < 60, F.lit(False)))


@query("median_filter5", sql("duet track", FLAG + ", " + M5 + " SELECT clip, body, frame, flag, m FROM m5"))
def _(spark, sf):
    return apply_steps(flagged(spark, sf), K, majority5("flag", "m")).select("clip", "body", "frame", "flag", "m")


@query("ffill_limit", sql("duet track", f"SELECT clip, body, frame, {rr(f'coalesce(x, last_value(x IGNORE NULLS) OVER ({PW} ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING))')} AS x FROM track"))
def _(spark, sf):
    return apply_steps(track(spark, sf), K, ffill("x", 1)).select("clip", "body", "frame", r("x").alias("x"))


@query("interp_inside", sql("duet track", f"f AS ({fill_sql('x', 1000000000, 'xf', 'track')}) SELECT clip, body, frame, {rr('CASE WHEN x IS NULL AND frame - pf > 1 THEN NULL ELSE xf END')} AS x FROM f"))
def _(spark, sf):
    return S.interp_inside(track(spark, sf), K, "x", 1, "xi").select("clip", "body", "frame", r("xi").alias("x"))


@query("sustained", sql("duet track", FLAG + f""", g AS (SELECT *, frame - row_number() OVER (PARTITION BY clip, body, flag ORDER BY frame) AS grp FROM fl) SELECT clip, body, frame, flag AND count(*) OVER (PARTITION BY clip, body, flag, grp) >= 4 AS kept FROM g"""))
def _(spark, sf):
    return apply_steps(flagged(spark, sf), K, sustained("flag", 4, "kept")).select("clip", "body", "frame", "kept")


HYS = f"""hy AS (SELECT *, coalesce(last_value(CASE WHEN coalesce(x, 99) > 80 THEN false WHEN coalesce(x, 99) < 30 THEN true END IGNORE NULLS) OVER ({PW}), false) AS contact FROM track)"""


def contact_hysteresis(spark, sf):
    d = F.coalesce("x", F.lit(99.0))
    return S.hysteresis(track(spark, sf), K, d < 30, d > 80, "contact")


@query("hysteresis", sql("duet track", HYS + " SELECT clip, body, frame, contact FROM hy"))
def _(spark, sf):
    return contact_hysteresis(spark, sf).select("clip", "body", "frame", "contact")


MERGED = HYS + """, hg AS (SELECT *, frame - row_number() OVER (PARTITION BY clip, body, contact ORDER BY frame) AS grp FROM hy), hx AS (SELECT *, max(coalesce(x, 0)) OVER (PARTITION BY clip, body, contact, grp) AS mx, min(frame) OVER (PARTITION BY clip, body, contact, grp) AS g0, max(frame) OVER (PARTITION BY clip, body, contact, grp) AS g1,
 max(frame) OVER (PARTITION BY clip, body) AS fl FROM hg), mg AS (SELECT clip, body, frame, x, y, contact OR (mx <= 90 AND g0 > 0 AND g1 < fl) AS contact FROM hx)"""


@query("merge_releases", sql("duet track", MERGED + " SELECT clip, body, frame, contact FROM mg"))
def _(spark, sf):
    return S.merge_releases(contact_hysteresis(spark, sf), K, "contact", F.col("x"), 90.0).select("clip", "body", "frame", "contact")


@query("normal_scores", sql("duet track", f"""rk AS (SELECT clip, body, frame, rank() OVER (PARTITION BY clip, body ORDER BY y) + (count(*) OVER (PARTITION BY clip, body, y) - 1) / 2 AS rnk, count(*) OVER (PARTITION BY clip, body) AS n FROM track WHERE y IS NOT NULL)
 SELECT t.clip, t.body, t.frame, {rr('CASE WHEN n > 10 THEN ' + probit_sql('(rnk - 0.5::DOUBLE) / n') + ' END')} AS score FROM track t LEFT JOIN rk USING (clip, body, frame)"""))
def _(spark, sf):
    return S.normal_scores(track(spark, sf), K, "y", "score").select("clip", "body", "frame", r("score").alias("score"))


@query("robust_z", sql("duet track", f"""q AS (SELECT clip, body, quantile_cont(x, 0.5) AS mx, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS ix, quantile_cont(y, 0.5) AS my, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iy FROM track GROUP BY clip, body)
 SELECT clip, body, frame, {rr('greatest(-3, least(3, (x - mx) / (ix / 1.35::DOUBLE)))')} AS zx, {rr('greatest(-3, least(3, (y - my) / (iy / 1.35::DOUBLE)))')} AS zy FROM track JOIN q USING (clip, body) WHERE x IS NOT NULL"""))
def _(spark, sf):
    z = S.robust_z(track(spark, sf), K, ["x", "y"])
    return z.where(F.col("x").isNotNull()).select("clip", "body", "frame", r("z_x").alias("zx"), r("z_y").alias("zy"))


@query("local_units", sql("duet track", f"SELECT clip, body, frame, {rr('x / ' + RM(7, 7, 3, 'y'))} AS local_x FROM track"))
def _(spark, sf):
    t = apply_steps(track(spark, sf), K, rolling("y", "l", "median", 7, 7, 3))
    return t.select("clip", "body", "frame", r(F.col("x") / F.col("l")).alias("local_x"))


@query("resample_nearest", sql("duet track", f"""n AS (SELECT clip, body, max(frame) + 1 AS n FROM track GROUP BY clip, body), g AS (SELECT clip, body, n, unnest(range(CAST(ceil(n / 30.0::DOUBLE * 25) AS BIGINT))) AS grid FROM n)
 SELECT g.clip, g.body, CAST(grid AS INT) AS grid, t.frame, {rr('x')} AS x FROM g JOIN track t ON t.clip = g.clip AND t.body = g.body AND t.frame = least(round_even(grid / 25.0::DOUBLE * 30, 0), n - 1)"""))
def _(spark, sf):
    return S.resample_nearest(track(spark, sf), K, 30.0, 25.0, ["x"]).select("clip", "body", "grid", "frame", r("x").alias("x"))


@query("block_downsample", sql("duet track", f"SELECT clip, body, CAST(floor(frame / 10) AS INT) AS block, {rr('avg(x)')} AS x, {rr('avg(y)')} AS y, count(x) AS n FROM track GROUP BY 1, 2, 3"))
def _(spark, sf):
    return track(spark, sf).groupBy("clip", "body", F.floor(F.col("frame") / 10).cast("int").alias("block")).agg(r(F.avg("x")).alias("x"), r(F.avg("y")).alias("y"), F.count("x").alias("n"))


@query("partial_out", sql("duet track", f"""m AS (SELECT clip, body, count(*) AS n, regr_slope(x, y) AS b, regr_intercept(x, y) AS a FROM track WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY clip, body)
 SELECT clip, body, frame, {rr('CASE WHEN n > 12 THEN x - a - b * y END', 5)} AS res FROM track JOIN m USING (clip, body)"""))
def _(spark, sf):
    return S.partial_out(track(spark, sf), K, "x", ["y"], "res").select("clip", "body", "frame", r("res", 5).alias("res"))


@query("partial_out_two", sql("duet track", f"""t0 AS (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY clip, body ORDER BY frame), 0) AS dx FROM track), m AS (SELECT clip, body, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(frame) AS mf, covar_pop(x, y) AS sxy, covar_pop(x, frame) AS sxf, var_pop(y) AS syy, var_pop(frame) AS sff, covar_pop(y, frame) AS syf FROM t0 WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY clip, body)
 SELECT clip, body, frame, {rr('x - mx - (sxy * sff - sxf * syf) / (syy * sff - syf * syf) * (y - my) - (sxf * syy - sxy * syf) / (syy * sff - syf * syf) * (frame - mf)', 5)} AS res FROM t0 JOIN m USING (clip, body)"""))
def _(spark, sf):
    return S.partial_out(track(spark, sf), K, "x", ["y", "frame"], "res").select("clip", "body", "frame", r("res", 5).alias("res"))


@query("camera_covariates", sql("duet", f"""c AS (SELECT clip, frame, sqrt(m02 * m02 + m12 * m12) / 20 * 30 AS t, ln(sqrt(abs(m00 * m11 - m01 * m10)) + 1e-12::DOUBLE) * 30 AS z, ln(1 + coalesce(ay, 1)) AS ls FROM duet)
 SELECT clip, frame, {rr('t')} AS t, {rr('CASE WHEN frame = 0 THEN 0 ELSE (t - lag(t) OVER w) * 30 END')} AS dt, {rr('z')} AS z, {rr('abs(z)')} AS abs_z, {rr('CASE WHEN frame = 0 THEN 0 ELSE (ls - lag(ls) OVER w) * 30 END', 5)} AS dls FROM c WINDOW w AS (PARTITION BY clip ORDER BY frame)"""))
def _(spark, sf):
    d = V.duet(spark, sf).select("clip", "frame", (dist(F.col("m02"), F.col("m12")) / 20 * 30).alias("t"),
                                 (F.ln(F.sqrt(F.abs(F.col("m00") * F.col("m11") - F.col("m01") * F.col("m10"))) + 1e-12) * 30).alias("z"),
                                 F.ln(1 + F.coalesce("ay", F.lit(1.0))).alias("ls"))
    first = F.col("frame") == 0
    d = over_neighbours(d, ["clip"], {n: (lambda c: lambda w: F.when(first, F.lit(0.0)).otherwise((F.col(c) - F.lag(c).over(w)) * 30))(c)
                                      for n, c in (("dt", "t"), ("dls", "ls"))}, back=1)
    return d.select("clip", "frame", r("t").alias("t"), r("dt").alias("dt"), r("z").alias("z"), r(F.abs("z")).alias("abs_z"), r("dls", 5).alias("dls"))


@query("camera_static_summary", sql("duet", f"""m AS (SELECT clip, sqrt(m02 * m02 + m12 * m12) AS px FROM duet) SELECT clip, count(px) AS measured, {rr('quantile_cont(px, 0.5)')} AS median_px, {rr('quantile_cont(px, 0.95)')} AS p95_px,
 {rr('count(*) FILTER (px > 0.003::DOUBLE * 200)::DOUBLE / greatest(1, count(px))')} AS moving_fraction, count(px) > 0 AND count(*) FILTER (px > 0.003::DOUBLE * 200)::DOUBLE / greatest(1, count(px)) <= 0.05 AS static FROM m GROUP BY clip"""))
def _(spark, sf):
    m = V.duet(spark, sf).select("clip", dist(F.col("m02"), F.col("m12")).alias("px"))
    frac = F.count_if(F.col("px") > 0.003 * 200) / F.greatest(F.lit(1), F.count("px"))
    a = m.groupBy("clip").agg(F.count("px").alias("measured"), r(frac).alias("moving_fraction"), ((F.count("px") > 0) & (frac <= 0.05)).alias("static"))
    q = quantiles(m, ["clip"], "px", {"median_px": 0.5, "p95_px": 0.95})
    return a.join(q, "clip", "left").select("clip", "measured", r("median_px").alias("median_px"), r("p95_px").alias("p95_px"), "moving_fraction", "static")


@query("step_path", sql("duet track", f"""s AS (SELECT clip, body, frame, {RM(4, 4, 5, 'x')} AS mx, {RM(4, 4, 5, 'y')} AS my FROM track) SELECT clip, body, frame, {rr('sqrt(power(mx - lag(mx, 5) OVER w, 2) + power(my - lag(my, 5) OVER w, 2)) / 5 / 20')} AS step FROM s WINDOW w AS ({PW})"""))
def _(spark, sf):
    t = apply_steps(track(spark, sf), K, rolling("x", "mx", "median", 4, 4, 5), rolling("y", "my", "median", 4, 4, 5), shifted("px", "mx", -5), shifted("py", "my", -5))
    return t.select("clip", "body", "frame", r(dist(F.col("mx") - F.col("px"), F.col("my") - F.col("py")) / 5 / 20).alias("step"))


@query("interp_all_deriv", sql("duet track", f"""f AS ({fill_sql('x', 1000000000, 'xf', 'track')}), z AS (SELECT *, coalesce(xf, pv, nv) AS zz, row_number() OVER ({PW}) - 1 AS i, count(*) OVER (PARTITION BY clip, body) AS n, count(x) OVER (PARTITION BY clip, body) AS nv_ FROM f)
 SELECT clip, body, frame, round(CASE WHEN x IS NULL OR nv_ <= 20 THEN NULL WHEN i >= 5 AND n - 1 - i >= 5 THEN {dot_sql('zz', sg_matrix(11, 3, 1, 1 / 30.0)[5], 5)} """ + " ".join(
    f"WHEN i = {k} THEN {dot_sql('zz', sg_matrix(11, 3, 1, 1 / 30.0)[k], k)} WHEN n - 1 - i = {k} THEN {dot_sql('zz', sg_matrix(11, 3, 1, 1 / 30.0)[10 - k], 10 - k)}" for k in range(5)) + f" END, 5) + 0.0::DOUBLE AS v FROM z WINDOW w AS ({PW})"))
def _(spark, sf):
    return S.interp_all_derivative(track(spark, sf), K, "x", 30.0, "v").select("clip", "body", "frame", r("v", 5).alias("v"))


@query("simple_smooth_velocity", sql("duet track", f"""z AS (SELECT clip, body, frame, coalesce(x, 0) AS x, row_number() OVER ({PW}) - 1 AS i, count(*) OVER (PARTITION BY clip, body) AS n FROM track),
 s AS (SELECT clip, body, frame, i, n, CASE WHEN n <= 9 THEN x WHEN i >= 4 AND n - 1 - i >= 4 THEN {dot_sql('x', sg_matrix(9, 3, 0)[4], 4)} """ + " ".join(
    f"WHEN i = {k} THEN {dot_sql('x', sg_matrix(9, 3, 0)[k], k)} WHEN n - 1 - i = {k} THEN {dot_sql('x', sg_matrix(9, 3, 0)[8 - k], 8 - k)}" for k in range(4)) + f""" END AS xs FROM z WINDOW w AS ({PW}))
 SELECT clip, body, frame, {rr('xs', 5)} AS xs, {rr('CASE WHEN i = 0 THEN (lead(xs) OVER w - xs) * 30 WHEN i = n - 1 THEN (xs - lag(xs) OVER w) * 30 ELSE (lead(xs) OVER w - lag(xs) OVER w) * 15 END', 4)} AS v FROM s WINDOW w AS ({PW})"""))
def _(spark, sf):
    t = track(spark, sf).withColumn("x", F.coalesce("x", F.lit(0.0)))
    t = apply_steps(t, K, savgol(["x"], 30.0, 9, derivs=(0,), run_min=10), Step([{"xs": lambda w: F.coalesce("x_d0", "x")}], 0, 0), gradient("xs", "v", 1 / 30.0))
    return t.select("clip", "body", "frame", r("xs", 5).alias("xs"), r("v", 4).alias("v"))


@query("shot_cuts", sql("duet track", f"""s AS (SELECT clip, body, frame, coalesce(abs(x - lag(x) OVER w), 0) / 100 AS d FROM track WINDOW w AS ({PW})),
 n AS (SELECT clip, body, frame, d, [{', '.join(f'lag(d, {k}) OVER w' for k in range(2, 7))}, {', '.join(f'lead(d, {k}) OVER w' for k in range(2, 7))}] AS nb FROM s WINDOW w AS ({PW}))
 SELECT clip, body, frame, {rr('d')} AS d FROM n WHERE frame >= 30 AND d > 0.6 AND d > 2 * list_aggregate(list_filter(nb, lambda v: v IS NOT NULL), 'quantile_cont', 0.5)"""))
def _(spark, sf):
    """Isolated spikes against the median of their neighbours (gap of one row on each side)."""
    t = over_neighbours(track(spark, sf), K, [
        {"d": lambda w: F.coalesce(F.abs(F.col("x") - F.lag("x").over(w)), F.lit(0.0)) / 100},
        {"nb": lambda w: F.filter(F.array(*[F.lag("d", k).over(w) for k in range(2, 7)], *[F.lead("d", k).over(w) for k in range(2, 7)]), lambda v: v.isNotNull())},
        {"nb": lambda w: F.array_sort("nb")}], 7, 6)
    n = F.size("nb")
    med = (F.get("nb", F.floor((n - 1) / 2).cast("int")) + F.get("nb", F.floor(n / 2).cast("int"))) / 2
    return t.where((F.col("frame") >= 30) & (F.col("d") > 0.6) & (F.col("d") > 2 * med)).select("clip", "body", "frame", r("d").alias("d"))


@query("residual_factor", sql("duet track", JIT + f" SELECT clip, body, {rr(f'sigma / {float((1 - sg_matrix(11, 3, 0)[5][5]) ** 0.5)!r}::DOUBLE')} AS noise_sigma FROM js"))
def _(spark, sf):
    """Input noise from the residual: white noise leaves sqrt(1 - c0) of itself behind the filter."""
    j = S.jitter_sigma(S.sg_derivatives(track(spark, sf), K), K)
    return j.select("clip", "body", r(F.col("sigma") / float((1 - sg_matrix(11, 3, 0)[5][5]) ** 0.5)).alias("noise_sigma"))
