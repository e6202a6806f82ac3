"""Windowed and grouped aggregation."""
from pyspark.sql import functions as F

from pairlane.functions import geometry as G
from pairlane.operators import series as S
from pairlane.operators import windows as WN
from pairlane.operators.lags import corr_of, moments
from pairlane.operators.ordered import average_ranks, over_neighbours, quantiles
from pairlane.operators.spectral import filter_bands
from pairlane.operators.steps import Step, apply_steps, dist, savgol
from pairlane.sources import views as V
from pairlane.sources.scratch import staged

from .geometry import BODIES, PF_SQL, SC, bodies
from .joins import IJ, inside
from .ordered import K, KIN_SQL, track
from .registry import query
from .sources import r, rr
from .views_sql import with_views as sql

LEN, STEP, FPS = 40, 10, 10.0
SCALE = 40.0


def frames(spark, sf):
    """Wide kinematics of both bodies, one shuffle: the two chains run over the same partition."""
    d = V.duet(spark, sf).select("clip", "frame", "present_a", "present_b", "ax", "ay", "bx", "by")
    ch = [s for p, x, y in (("a_", "ax", "ay"), ("b_", "bx", "by")) for s in S.kinematics_chain(30.0, SCALE, 2.5, 3.0, x=x, y=y, p=p)]
    keep = Step([{"dist": lambda w: dist(F.col("_ax") - F.col("_bx"), F.col("_ay") - F.col("_by")),
                  "dir_sim": lambda w: G.dir_similarity(*[F.col(c) for c in ("a_vx", "a_vy", "b_vx", "b_vy")])}], 0, 0)
    raw = Step([{f"_{c}": (lambda c: lambda w: F.col(c))(c) for c in ("ax", "ay", "bx", "by")}], 0, 0)
    return apply_steps(d, ["clip"], raw, *ch, keep)


WIN_SQL = KIN_SQL + f""", fr AS (SELECT k.clip, k.frame, a.speed / 40 AS sa, b.speed / 40 AS sb, a.jerk / 40 AS ja, b.jerk / 40 AS jb, a.vx / 40 AS vax, a.vy / 40 AS vay, b.vx / 40 AS vbx, b.vy / 40 AS vby, a.valid_deriv AS va, b.valid_deriv AS vb,
 k.present_a AND k.present_b AS both_, sqrt(power(k.ax - k.bx, 2) + power(k.ay - k."by", 2)) / 40 AS d FROM duet k JOIN kin a ON a.clip = k.clip AND a.frame = k.frame AND a.body = 'A' JOIN kin b ON b.clip = k.clip AND b.frame = k.frame AND b.body = 'B'),
 fr2 AS (SELECT *, CASE WHEN sqrt(vax*vax+vay*vay) * sqrt(vbx*vbx+vby*vby) * 1600 > 1e-9 THEN greatest(-1, least(1, (vax*vbx+vay*vby) / (sqrt(vax*vax+vay*vay) * sqrt(vbx*vbx+vby*vby)))) END AS ds FROM fr),
 wr AS (SELECT *, unnest(range(CAST(greatest(0, ceil((frame - 39) / 10.0::DOUBLE)) AS BIGINT), CAST(floor(frame / 10) AS BIGINT) + 1)) AS wid FROM fr2)"""


@query("window_table", sql("duet track", WIN_SQL + f""" SELECT clip, wid, count(*) AS n_frames, {rr('avg(CASE WHEN va THEN 1 ELSE 0 END)')} AS valid_a, {rr('avg(CASE WHEN vb THEN 1 ELSE 0 END)')} AS valid_b, {rr('avg(sa)')} AS speed_a, {rr('avg(sb)')} AS speed_b,
 {rr('quantile_cont(ja, 0.5)', 4)} AS jerk_a, {rr('quantile_cont(jb, 0.5)', 4)} AS jerk_b, {rr('avg(CASE WHEN both_ THEN 1 ELSE 0 END)')} AS both_detected, {rr('avg(d)')} AS mean_dist, {rr('avg(CASE WHEN d < 0.8 THEN 1.0::DOUBLE WHEN d IS NOT NULL THEN 0.0::DOUBLE END)')} AS contact, {rr('avg(ds)')} AS dir_sim FROM wr GROUP BY clip, wid HAVING count(*) = 40"""))
def _(spark, sf):
    d = WN.window_rows(frames(spark, sf), LEN, STEP)
    share = lambda c: F.avg(F.when(c, 1).otherwise(0))
    d = d.groupBy("clip", "wid").agg(
        F.count("*").alias("n_frames"), r(share(F.col("a_valid_deriv"))).alias("valid_a"), r(share(F.col("b_valid_deriv"))).alias("valid_b"),
        r(F.avg(F.col("a_speed") / SCALE)).alias("speed_a"), r(F.avg(F.col("b_speed") / SCALE)).alias("speed_b"),
        r(F.percentile(F.col("a_jerk") / SCALE, F.lit(0.5)), 4).alias("jerk_a"), r(F.percentile(F.col("b_jerk") / SCALE, F.lit(0.5)), 4).alias("jerk_b"),
        r(share(F.col("present_a") & F.col("present_b"))).alias("both_detected"), r(F.avg(F.col("dist") / SCALE)).alias("mean_dist"),
        r(F.avg((F.col("dist") / SCALE < 0.8).cast("double"))).alias("contact"), r(F.avg("dir_sim")).alias("dir_sim"))
    return d.where(F.col("n_frames") == LEN)


def complete_windows(spark, sf, step=STEP):
    """Windows of simple velocities in which every row is present: the input of the smoothness metrics."""
    d = over_neighbours(track(spark, sf).withColumns({"x": F.coalesce("x", F.lit(50.0)), "y": F.coalesce("y", F.lit(25.0))}), K,
                        {"vx": lambda w: (F.lead("x").over(w) - F.lag("x").over(w)) / 0.2, "vy": lambda w: (F.lead("y").over(w) - F.lag("y").over(w)) / 0.2}, 1, 1)
    d = d.where(F.col("vx").isNotNull()).withColumn("speed", dist(F.col("vx"), F.col("vy")))
    return WN.window_rows(d.select("clip", "body", "frame", "vx", "vy", "speed"), LEN, step)


VEL = """vel AS (SELECT clip, body, frame, (lead(x0) OVER w - lag(x0) OVER w) / 0.2::DOUBLE AS vx, (lead(y0) OVER w - lag(y0) OVER w) / 0.2::DOUBLE AS vy FROM (SELECT clip, body, frame, coalesce(x, 50) AS x0, coalesce(y, 25) AS y0 FROM track) WINDOW w AS (PARTITION BY clip, body ORDER BY frame)),
 vw AS (SELECT *, sqrt(vx*vx+vy*vy) AS speed, unnest(range(CAST(greatest(0, ceil((frame - 39) / 10.0::DOUBLE)) AS BIGINT), CAST(floor(frame / 10) AS BIGINT) + 1)) AS wid FROM vel WHERE vx IS NOT NULL),
 vc AS (SELECT * FROM vw QUALIFY count(*) OVER (PARTITION BY clip, body, wid) = 40)"""


@query("sparc", sql("duet track", VEL + f""", sw AS (SELECT clip, body, wid, row_number() OVER (PARTITION BY clip, body, wid ORDER BY frame) - 1 AS i, speed FROM vc),
 tw AS (SELECT k.range AS k, i.range AS i, cos(2 * pi() * k.range * i.range / 1024) AS c, sin(2 * pi() * k.range * i.range / 1024) AS s FROM range(615) k, range(40) i),
 sp_ AS (SELECT clip, body, wid, k, sqrt(power(sum(speed * c), 2) + power(sum(speed * s), 2)) AS m FROM sw JOIN tw USING (i) GROUP BY clip, body, wid, k),
 nm AS (SELECT *, m / max(m) OVER (PARTITION BY clip, body, wid) AS mm, k * 10 / 1024.0::DOUBLE AS f FROM sp_),
 lim AS (SELECT clip, body, wid, min(f) FILTER (mm >= 0.05) AS f0, max(f) FILTER (mm >= 0.05) AS f1 FROM nm GROUP BY clip, body, wid),
 ar AS (SELECT clip, body, wid, f1 - f0 AS span, f - lag(f) OVER w AS df, mm - lag(mm) OVER w AS dm FROM nm JOIN lim USING (clip, body, wid) WHERE f BETWEEN f0 AND f1 WINDOW w AS (PARTITION BY clip, body, wid ORDER BY f))
 SELECT clip, body, wid, {rr('-sum(sqrt(power(df / span, 2) + power(dm, 2)))', 5)} AS sparc FROM ar GROUP BY clip, body, wid"""))
def _(spark, sf):
    d = complete_windows(spark, sf).groupBy("clip", "body", "wid").agg(F.sort_array(F.collect_list(F.struct("frame", "speed"))).alias("s"))    # at most LEN rows
    d = d.where(F.size("s") == LEN).select("clip", "body", "wid", WN.sparc_udf(FPS)(F.transform("s", lambda x: x["speed"])).alias("sparc"))
    return d.select("clip", "body", "wid", r("sparc", 5).alias("sparc"))


@query("ldlj", sql("duet track", VEL + f""", g1 AS (SELECT *, row_number() OVER w - 1 AS i, CASE WHEN lag(vx) OVER w IS NULL THEN (lead(vx) OVER w - vx) * 10 WHEN lead(vx) OVER w IS NULL THEN (vx - lag(vx) OVER w) * 10 ELSE (lead(vx) OVER w - lag(vx) OVER w) * 5 END AS ax,
 CASE WHEN lag(vx) OVER w IS NULL THEN (lead(vy) OVER w - vy) * 10 WHEN lead(vx) OVER w IS NULL THEN (vy - lag(vy) OVER w) * 10 ELSE (lead(vy) OVER w - lag(vy) OVER w) * 5 END AS ay FROM vc WINDOW w AS (PARTITION BY clip, body, wid ORDER BY frame)),
 g2 AS (SELECT *, CASE WHEN i = 0 THEN (lead(ax) OVER w - ax) * 10 WHEN i = 39 THEN (ax - lag(ax) OVER w) * 10 ELSE (lead(ax) OVER w - lag(ax) OVER w) * 5 END AS jx, CASE WHEN i = 0 THEN (lead(ay) OVER w - ay) * 10 WHEN i = 39 THEN (ay - lag(ay) OVER w) * 10 ELSE (lead(ay) OVER w - lag(ay) OVER w) * 5 END AS jy FROM g1 WINDOW w AS (PARTITION BY clip, body, wid ORDER BY frame))
 SELECT clip, body, wid, {rr('-ln(64.0::DOUBLE / power(max(speed), 2) * sum(jx*jx+jy*jy) * 0.1::DOUBLE)', 5)} AS ldlj FROM g2 GROUP BY clip, body, wid"""))
def _(spark, sf):
    d = WN.ldlj_columns(complete_windows(spark, sf), K, "vx", "vy", 0.1, "j2")
    g = d.groupBy("clip", "body", "wid").agg(F.count("*").alias("n"), F.max("speed").alias("vp"), F.sum("j2").alias("s")).where(F.col("n") == LEN)
    return g.select("clip", "body", "wid", r(WN.ldlj_of(LEN, 0.1, F.col("vp"), F.col("s")), 5).alias("ldlj"))


@query("ke_transfer_r", sql("duet track", VEL + f""", g AS (SELECT a.clip, a.wid, a.frame, a.speed * a.speed AS ka, b.speed * b.speed AS kb FROM vc a JOIN vc b ON a.clip = b.clip AND a.wid = b.wid AND a.frame = b.frame AND a.body = 'A' AND b.body = 'B'),
 d AS (SELECT clip, wid, CASE WHEN lag(ka) OVER w IS NULL THEN (lead(ka) OVER w - ka) * 10 WHEN lead(ka) OVER w IS NULL THEN (ka - lag(ka) OVER w) * 10 ELSE (lead(ka) OVER w - lag(ka) OVER w) * 5 END AS da,
 CASE WHEN lag(kb) OVER w IS NULL THEN (lead(kb) OVER w - kb) * 10 WHEN lead(kb) OVER w IS NULL THEN (kb - lag(kb) OVER w) * 10 ELSE (lead(kb) OVER w - lag(kb) OVER w) * 5 END AS db FROM g WINDOW w AS (PARTITION BY clip, wid ORDER BY frame))
 SELECT clip, wid, {rr('corr(da, db)', 5)} AS r FROM d GROUP BY clip, wid"""))
def _(spark, sf):
    d = over_neighbours(V.duet(spark, sf).select("clip", "frame", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("ax", 50.0), ("ay", 25.0), ("bx", 50.0), ("by", 25.0))]), ["clip"],
                        {f"v{c}": (lambda c: lambda w: (F.lead(c).over(w) - F.lag(c).over(w)) / 0.2)(c) for c in ("ax", "ay", "bx", "by")}, 1, 1).where(F.col("vax").isNotNull())
    d = d.select("clip", "frame", (F.col("vax") ** 2 + F.col("vay") ** 2).alias("ka"), (F.col("vbx") ** 2 + F.col("vby") ** 2).alias("kb"))
    d = WN.window_rows(d, LEN, STEP)
    w = WN.in_window(["clip"])
    d = d.withColumns({"da": WN.gradient_in(F.col("ka"), w, 0.1), "db": WN.gradient_in(F.col("kb"), w, 0.1)})
    m = d.groupBy("clip", "wid").agg(*moments("da", "db"), F.stddev_pop("da").alias("d1"), F.stddev_pop("db").alias("d2")).where(F.col("n") == LEN)
    return m.select("clip", "wid", r(F.when((F.col("d1") >= 1e-9) & (F.col("d2") >= 1e-9), corr_of(2, 0.0)), 5).alias("r"))


WC = """wc AS (SELECT clip, wid, CASE WHEN var_pop(ax) * var_pop(bx) > 1e-24 THEN corr(ax, bx) END AS r FROM (SELECT clip, frame, ax, bx, unnest(range(CAST(greatest(0, ceil((frame - 19) / 5.0::DOUBLE)) AS BIGINT), CAST(floor(frame / 5) AS BIGINT) + 1)) AS wid FROM duet WHERE ax IS NOT NULL AND bx IS NOT NULL) GROUP BY clip, wid HAVING count(*) = 20)"""


@query("window_corr", sql("duet", WC + f" SELECT clip, wid, {rr('r')} AS r FROM wc"))
def _(spark, sf):
    return WN.window_corr(V.duet(spark, sf), ["clip"], "ax", "bx", 20, 5).select("clip", "wid", r("r").alias("r"))


@query("handoff_share", sql("duet", WC + f" SELECT clip, count(r) AS n_win, {rr('avg(CASE WHEN r < -0.3 THEN 1 ELSE 0 END)')} AS frac_neg, {rr('avg(CASE WHEN r > 0.3 THEN 1 ELSE 0 END)')} AS frac_pos, {rr('min(r)')} AS r_min FROM wc WHERE r IS NOT NULL GROUP BY clip"))
def _(spark, sf):
    w = WN.window_corr(V.duet(spark, sf), ["clip"], "ax", "bx", 20, 5).where(F.col("r").isNotNull())
    return w.groupBy("clip").agg(F.count("r").alias("n_win"), r(F.avg(F.when(F.col("r") < -0.3, 1).otherwise(0))).alias("frac_neg"), r(F.avg(F.when(F.col("r") > 0.3, 1).otherwise(0))).alias("frac_pos"), r(F.min("r")).alias("r_min"))


@query("sparc_windows")
def _(spark, sf):
    """Median SPARC over half-overlapping complete windows; the last possible start is left out."""
    d = V.duet(spark, sf).select("clip", "frame", "ax")
    n = d.groupBy("clip").agg((F.max("frame") + 1).alias("n"))
    w = WN.window_rows(d.where(F.col("ax").isNotNull()), 24, 12).groupBy("clip", "wid").agg(F.sort_array(F.collect_list(F.struct("frame", "ax"))).alias("s")).where(F.size("s") == 24)
    w = w.join(n, "clip").where(F.col("wid") * 12 < F.col("n") - 24)
    w = w.select("clip", WN.sparc_udf(FPS, 4.5)(F.transform("s", lambda x: x["ax"])).alias("v")).where(F.col("v").isNotNull())
    return quantiles(w, ["clip"], "v", {"sparc": 0.5}).select("clip", F.col("n").alias("n_win"), r("sparc").alias("sparc"))


PWC = ["trunk_tilt", "inverted", "arm_up_l", "arm_up_r", "level", "stance_width"]


@query("pose_windows", sql("pose", BODIES + ", pf AS (SELECT clip, body, frame, " + ", ".join(f"{PF_SQL[c]} AS {c}" for c in PWC) + f""" FROM mb), n AS (SELECT clip, body, max(frame) + 1 AS n FROM pf GROUP BY clip, body),
 pw AS (SELECT pf.*, n, unnest(range(CAST(greatest(0, ceil((frame - 7) / 4.0::DOUBLE)) AS BIGINT), CAST(floor(frame / 4) AS BIGINT) + 1)) AS wid FROM pf JOIN n USING (clip, body))
 SELECT clip, body, wid, """ + ", ".join(f"{rr(f'quantile_cont({c}, 0.5)')} AS {c}" for c in PWC) + " FROM pw GROUP BY clip, body, wid HAVING wid * 4 < max(n) - 8 AND count(trunk_tilt) / 8 >= 0.3"))
def _(spark, sf):
    b = bodies(spark, sf)
    f = G.pose_features(F.col("m"), F.lit(SC))
    p = b.select("clip", "body", "frame", *[f[c].alias(c) for c in PWC])
    n = b.groupBy("clip", "body").agg((F.max("frame") + 1).alias("n"))
    g = WN.window_rows(p, 8, 4).groupBy("clip", "body", "wid").agg(F.count("trunk_tilt").alias("_k"), *[r(F.percentile(c, F.lit(0.5))).alias(c) for c in PWC])
    return g.join(n, ["clip", "body"]).where((F.col("wid") * 4 < F.col("n") - 8) & (F.col("_k") / 8 >= 0.3)).drop("n", "_k")


DIMS = ["ax", "ay", "bx", "by"]


def dims(spark, sf, length=50, min_valid=0.2):
    """Tumbling windows over four coordinates: covariance sums of raw and smoothed values on smoothed rows."""
    d = V.duet(spark, sf).select("clip", "frame", *DIMS)
    d = apply_steps(d, ["clip"], savgol(DIMS, 15.0, 7, derivs=(0,)))
    ok = F.col("ax_d0").isNotNull()
    sm = [c + "_d0" for c in DIMS]
    var = F.array(*[F.var_pop(F.when(ok, F.col(c) - F.col(c + "_d0"))) for c in DIMS]).alias("res_var")
    d = d.withColumns({c: F.when(ok, F.col(c)) for c in DIMS})
    g = d.groupBy("clip", F.floor(F.col("frame") / length).alias("win")).agg(F.count("*").alias("len"), F.count("ax_d0").alias("n"), *WN.cov_aggregates(DIMS, "r"), *WN.cov_aggregates(sm, "s"), var)
    return g.where((F.col("len") == length) & (F.col("n") / length >= min_valid))


def cov_sql(cols):
    tr = " + ".join(f"var_samp({c})" for c in cols)
    fro = " + ".join(f"{1 if i == j else 2} * power(covar_samp({cols[i]}, {cols[j]}), 2)" for i in range(len(cols)) for j in range(i, len(cols)))
    return f"power({tr}, 2) / ({fro})"


W4 = ("r0 AS (SELECT clip, frame, ax AS xf, ay AS yf, bx, \"by\", ax IS NOT NULL AND ay IS NOT NULL AND bx IS NOT NULL AND \"by\" IS NOT NULL AS ok FROM duet), r1 AS (SELECT *, frame - row_number() OVER (PARTITION BY clip, ok ORDER BY frame) AS grp FROM r0), "
      "r2 AS (SELECT *, count(*) OVER (PARTITION BY clip, ok, grp) AS n, row_number() OVER (PARTITION BY clip, ok, grp ORDER BY frame) - 1 AS i FROM r1)")


def sm_sql():
    from pairlane.operators.steps import sg_matrix
    from .ordered import dot_sql
    m = sg_matrix(7, 3, 0)
    cols = []
    for c, nm in (("xf", "sax"), ("yf", "say"), ("bx", "sbx"), ('"by"', "sby")):
        e = f"CASE WHEN NOT ok OR n < 7 THEN NULL WHEN i >= 3 AND n - 1 - i >= 3 THEN {dot_sql(c, m[3], 3)}"
        for k in range(3):
            e += f" WHEN i = {k} THEN {dot_sql(c, m[k], k)} WHEN n - 1 - i = {k} THEN {dot_sql(c, m[6 - k], 6 - k)}"
        cols.append(e + f" END AS {nm}")
    return W4 + f", sm AS (SELECT *, {', '.join(cols)} FROM r2 WINDOW w AS (PARTITION BY clip, ok, grp ORDER BY frame))"


@query("window_dims", sql("duet", sm_sql() + f""" SELECT clip, CAST(floor(frame / 50) AS BIGINT) AS win, count(sax) AS n, {rr('(' + cov_sql(['xf', 'yf', 'bx', '"by"']) + ') FILTER_', 5).replace(') FILTER_', ')')} AS pr_raw, {rr(cov_sql(['sax', 'say', 'sbx', 'sby']), 5)} AS pr_smooth
 FROM (SELECT clip, frame, CASE WHEN sax IS NOT NULL THEN xf END AS xf, CASE WHEN sax IS NOT NULL THEN yf END AS yf, CASE WHEN sax IS NOT NULL THEN bx END AS bx, CASE WHEN sax IS NOT NULL THEN "by" END AS "by", sax, say, sbx, sby FROM sm) GROUP BY 1, 2 HAVING count(*) = 50 AND count(sax) / 50 >= 0.2"""))
def _(spark, sf):
    pr = lambda p: WN.participation_ratio(F.col("n"), F.col(f"{p}_s"), F.col(f"{p}_ss"), 4)
    return dims(spark, sf).select("clip", "win", "n", r(pr("r"), 5).alias("pr_raw"), r(pr("s"), 5).alias("pr_smooth"))


@query("window_dims_denoised")
def _(spark, sf):
    """PR and n90 after subtracting jitter variance: eigenvalues of one small matrix per window."""
    from pairlane.operators.steps import sg_matrix
    c0 = float(sg_matrix(7, 3, 0)[3][3])
    d = dims(spark, sf).withColumn("noise", F.transform("res_var", lambda v: v / max(1 - c0, 1e-6)))
    u = WN.spectrum_udf(4)
    d = d.select("clip", "win", "n", u("n", "r_s", "r_ss", "noise").alias("d"), u("n", "r_s", "r_ss", F.transform("noise", lambda v: v * 0)).alias("w"), F.sqrt(F.sort_array("noise")[1] / 2 + F.sort_array("noise")[2] / 2).alias("jitter"))
    return d.select("clip", "win", "n", r("d.pr", 5).alias("pr_dn"), F.col("d.n90").alias("n90_dn"), r("w.pr", 5).alias("pr_raw"), F.col("w.n90").alias("n90_raw"), r("jitter").alias("jitter"))


@query("window_dims_3d", sql("duet", f"""SELECT clip, CAST(floor(frame / 50) AS BIGINT) AS win, count(*) FILTER (ok) AS n, CASE WHEN count(*) FILTER (ok) / 50 >= 0.8 THEN {rr(cov_sql(['x', 'y', 'z']), 5)} END AS pr FROM (SELECT clip, frame, ax IS NOT NULL AND bx IS NOT NULL AS ok, CASE WHEN ax IS NOT NULL AND bx IS NOT NULL THEN ax END AS x, CASE WHEN ax IS NOT NULL AND bx IS NOT NULL THEN ay END AS y, CASE WHEN ax IS NOT NULL AND bx IS NOT NULL THEN bx END AS z FROM duet) GROUP BY 1, 2 HAVING count(*) = 50"""))
def _(spark, sf):
    """Invalid windows stay as rows with NULL."""
    ok = F.col("ax").isNotNull() & F.col("bx").isNotNull()
    d = V.duet(spark, sf).select("clip", "frame", *[F.when(ok, F.col(c)).alias(n) for c, n in (("ax", "x"), ("ay", "y"), ("bx", "z"))])
    g = d.groupBy("clip", F.floor(F.col("frame") / 50).alias("win")).agg(F.count("*").alias("len"), F.count("x").alias("n"), *WN.cov_aggregates(["x", "y", "z"], "c")).where(F.col("len") == 50)
    return g.select("clip", "win", "n", r(F.when(F.col("n") / 50 >= 0.8, WN.participation_ratio(F.col("n"), F.col("c_s"), F.col("c_ss"), 3)), 5).alias("pr"))


@query("filter_pass_share", sql("det", f"SELECT clip, CAST(floor(cx / 25) AS INT) AS state, count(*) AS frames, {rr('avg(CASE WHEN conf >= 0.3 THEN 1 ELSE 0 END)')} AS pass_frac FROM det GROUP BY 1, 2 HAVING count(*) >= 30"))
def _(spark, sf):
    return V.detections(spark, sf).groupBy("clip", F.floor(F.col("cx") / 25).cast("int").alias("state")).agg(F.count("*").alias("frames"), r(F.avg(F.when(F.col("conf") >= 0.3, 1).otherwise(0))).alias("pass_frac")).where(F.col("frames") >= 30)


@query("weighted_mean", sql("det", f"SELECT clip, {rr('sum(conf * cx) / sum(conf)')} AS cx, {rr('sum(conf * cy) / sum(conf)')} AS cy FROM det GROUP BY clip"))
def _(spark, sf):
    w = lambda c: r(F.sum(F.col("conf") * F.col(c)) / F.sum("conf")).alias(c)
    return V.detections(spark, sf).groupBy("clip").agg(w("cx"), w("cy"))


FIGS = "figs AS (SELECT o_custkey AS clip, o_orderkey AS fig, o_orderkey % 480 AS f0, o_orderkey % 480 + 60 + o_orderkey % 40 AS f1, o_orderpriority AS label FROM orders)"


def figures(spark, sf):
    o = V.table(spark, sf, "orders")
    f0 = F.col("o_orderkey") % 480
    return o.select(F.col("o_custkey").alias("clip"), F.col("o_orderkey").alias("fig"), f0.alias("f0"), (f0 + 60 + F.col("o_orderkey") % 40).alias("f1"), F.col("o_orderpriority").alias("label"))


def figure_frames(spark, sf):
    """Frames of each annotated interval, end inclusive; buckets keep a busy clip spread out."""
    from pairlane.operators.joins import interval_join
    return interval_join(V.duet(spark, sf), figures(spark, sf), "clip", "frame", "f0", "f1", 64)


FF = FIGS + ", ff AS (SELECT d.*, fig, f0, f1, label FROM duet d JOIN figs USING (clip) WHERE frame BETWEEN f0 AND f1)"


@query("phase_summary", sql("duet", FF + f""", v AS (SELECT *, row_number() OVER (PARTITION BY clip, fig ORDER BY frame) AS i, count(*) OVER (PARTITION BY clip, fig) AS n FROM ff WHERE ax IS NOT NULL AND bx IS NOT NULL),
 z AS (SELECT *, (ax - avg(ax) OVER p) / stddev_pop(ax) OVER p AS za, (bx - avg(bx) OVER p) / stddev_pop(bx) OVER p AS zb FROM v WINDOW p AS (PARTITION BY clip, fig)),
 xc AS (SELECT a.clip, a.fig, b.i - a.i AS lag, sum(a.za * b.zb) / any_value(a.n) AS r FROM z a JOIN z b ON a.clip = b.clip AND a.fig = b.fig AND b.i BETWEEN a.i - 6 AND a.i + 6 WHERE a.n >= 30 GROUP BY 1, 2, 3),
 pk AS (SELECT clip, fig, arg_min(lag, {{'m': -abs(r), 'l': lag}}) AS lag, arg_min(r, {{'m': -abs(r), 'l': lag}}) AS r FROM xc GROUP BY 1, 2)
 SELECT f.*, {rr('coalesce(pk.lag, 0) / 30.0::DOUBLE')} AS peak_lag_s, {rr('coalesce(pk.r, 0)', 5)} AS peak_r FROM (SELECT clip, fig, label, count(*) AS n, {rr('avg(ax)')} AS mean_a, {rr('quantile_cont(ax, 0.5)')} AS median_a, {rr('avg(bx)')} AS mean_b, {rr('avg(sqrt(power(ax - bx, 2) + power(ay - "by", 2)))')} AS mean_dist FROM ff GROUP BY 1, 2, 3) f LEFT JOIN pk USING (clip, fig)"""))
def _(spark, sf):
    from pairlane.operators.lags import xcorr_dropna
    ff = figure_frames(spark, sf)
    a = ff.groupBy("clip", "fig", "label").agg(F.count("*").alias("n"), r(F.avg("ax")).alias("mean_a"), r(F.percentile("ax", F.lit(0.5))).alias("median_a"), r(F.avg("bx")).alias("mean_b"),
                                               r(F.avg(dist(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))).alias("mean_dist"))
    x = xcorr_dropna(ff.select("clip", "fig", "frame", F.col("ax").alias("a"), F.col("bx").alias("b")), ["clip", "fig"], 6, 30)
    p = x.groupBy("clip", "fig").agg(F.min(F.struct((-F.abs("r")).alias("m"), "lag", "r")).alias("p"))
    return a.join(p, ["clip", "fig"], "left").select("clip", "fig", "label", "n", "mean_a", "median_a", "mean_b", "mean_dist",
                                                    r(F.coalesce(F.col("p.lag"), F.lit(0)) / 30.0).alias("peak_lag_s"), r(F.coalesce("p.r", F.lit(0.0)), 5).alias("peak_r"))


@query("clip_row", sql("duet", f"""a AS (SELECT clip, count(*) AS n_frames, {rr('avg(CASE WHEN present_a THEN 1 ELSE 0 END)')} AS detected_a, {rr('avg(CASE WHEN present_b THEN 1 ELSE 0 END)')} AS detected_b, avg(CASE WHEN present_a AND present_b THEN 1 ELSE 0 END) AS both_, quantile_cont(ay, 0.5) AS ma, quantile_cont("by", 0.5) AS mb FROM duet GROUP BY clip)
 SELECT clip, s_nationkey AS source_group, n_frames, detected_a, detected_b, {rr('both_')} AS both_detected, {rr('least(ma, mb)')} AS min_median, least(ma, mb) < 24 AS low_activity,
 concat_ws(';', CASE WHEN n_frames < 590 THEN 'too_short' END, CASE WHEN both_ < 0.85 THEN 'low_detection' END, CASE WHEN s_suppkey IS NULL THEN 'not_curated' WHEN s_acctbal < 2000 THEN 'not_dance:low' END) AS exclusion_reason,
 NOT (n_frames < 590 OR both_ < 0.85 OR s_suppkey IS NULL OR coalesce(s_acctbal < 2000, false)) AS included FROM a LEFT JOIN supplier ON s_suppkey = clip"""))
def _(spark, sf):
    d = V.duet(spark, sf)
    share = lambda c: F.avg(F.when(c, 1).otherwise(0))
    a = d.groupBy("clip").agg(F.count("*").alias("n_frames"), r(share(F.col("present_a"))).alias("detected_a"), r(share(F.col("present_b"))).alias("detected_b"), share(F.col("present_a") & F.col("present_b")).alias("both_"))
    m = quantiles(d, ["clip"], "ay", {"ma": 0.5}).drop("n").join(quantiles(d, ["clip"], "by", {"mb": 0.5}).drop("n"), "clip", "full")
    cur = V.table(spark, sf, "supplier")
    j = a.join(m, "clip", "left").join(cur, F.col("clip") == F.col("s_suppkey"), "left")
    why = F.array_compact(F.array(F.when(F.col("n_frames") < 590, "too_short"), F.when(F.col("both_") < 0.85, "low_detection"),
                                  F.when(F.col("s_suppkey").isNull(), "not_curated").when(F.col("s_acctbal") < 2000, "not_dance:low")))
    low = F.least("ma", "mb")
    return j.select("clip", F.col("s_nationkey").alias("source_group"), "n_frames", "detected_a", "detected_b", r("both_").alias("both_detected"), r(low).alias("min_median"), (low < 24).alias("low_activity"),
                    F.concat_ws(";", why).alias("exclusion_reason"), (F.size(why) == 0).alias("included"))


@query("continuity", sql("duet track", KIN_SQL + f""", kj AS (SELECT k.clip, k.body, k.speed, sqrt(power(xf - d0x, 2) + power(yf - d0y, 2)) / {SCALE}::DOUBLE AS jitter FROM kin k JOIN sg USING (clip, body, frame))
 SELECT clip, body, count(speed) AS n, CASE WHEN count(speed) > 30 THEN {rr('avg(CASE WHEN speed < 40 THEN 1 ELSE 0 END) FILTER (speed IS NOT NULL)')} END AS stop_frac, CASE WHEN count(speed) > 30 THEN {rr('quantile_cont(speed, 0.5)', 4)} END AS speed_med,
 CASE WHEN count(jitter) > 30 THEN {rr('quantile_cont(jitter, 0.5)')} END AS jitter_med FROM kj GROUP BY clip, body"""))
def _(spark, sf):
    """Share of stops, median speed and median jitter (the smoothing residual in body lengths), each over the frames that have it and from 31 of them."""
    k = S.body_kinematics(track(spark, sf), K, 30.0, scale=SCALE, max_jump=2.5, max_speed=3.0)
    k = staged(k.select(*K, "speed", (F.col("residual") / SCALE).alias("jitter")), "speeds")           # read by shares and medians
    a = k.groupBy(*K).agg(F.count("speed").alias("n"), F.count("jitter").alias("nj"), F.avg(F.when(F.col("speed") < 40, 1).when(F.col("speed").isNotNull(), 0)).alias("s"))
    middle = lambda c: quantiles(k, K, c, {f"m_{c}": 0.5}).drop("n")
    enough = F.col("n") > 30
    return a.join(middle("speed"), K, "left").join(middle("jitter"), K, "left").select(
        "clip", "body", "n", F.when(enough, r("s")).alias("stop_frac"), F.when(enough, r("m_speed", 4)).alias("speed_med"), F.when(F.col("nj") > 30, r("m_jitter")).alias("jitter_med"))


@query("still_noise")
def _(spark, sf):
    """SD of raw minus low-pass over present runs of at least a second."""
    f = filter_bands(track(spark, sf), K, ["y"], 30.0, {"f": (None, 3.0)}, min_run=15)
    return f.where(F.col("y_f").isNotNull()).groupBy(*K).agg(F.count("*").alias("n"), r(F.stddev_pop(F.col("y") - F.col("y_f")), 5).alias("noise"))


@query("noise_match")
def _(spark, sf):
    """Grow the noise added to body A until its median residual is within 5 % of body B's, at most four
    rounds; one aggregate value per round reaches the driver (a mergeable sketch: the target is 5 %)."""
    t = staged(track(spark, sf), "track")                 # read once a round
    unit = (F.pmod(F.xxhash64("clip", "frame"), F.lit(2001)) - 1000) / 500.0

    def residual(body, amp):
        d = t.where(F.col("body") == body).withColumn("x", F.col("x") + unit * amp)
        return S.sg_derivatives(d, K).agg(F.percentile_approx("residual", 0.5, 10000)).first()[0]
    base, target = residual("A", 0.0), residual("B", 0.0)
    rows, amp, got = [(0, 0.0, base, target)], (max(abs(target ** 2 - base ** 2), 1e-6)) ** 0.5, base
    for i in range(1, 5):
        got = residual("A", amp)
        rows.append((i, float(amp), float(got), float(target)))
        if abs(got - target) / target < 0.05 or got <= base:
            break
        amp *= (max(target ** 2 - base ** 2, 1e-12) / max(got ** 2 - base ** 2, 1e-12)) ** 0.5
    return spark.createDataFrame(rows, "round int, added double, residual double, target double")


@query("group_summaries", f"""SELECT o_orderpriority AS grp, o_orderstatus AS state, count(*) AS n, count(DISTINCT o_custkey) AS units, {rr('avg(o_totalprice)', 4)} AS mean, {rr('quantile_cont(o_totalprice, 0.5)', 4)} AS median, {rr('avg(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END)')} AS share_high FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("state"), "o_custkey", "o_totalprice")
    a = o.groupBy("grp", "state").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("units"), r(F.avg("o_totalprice"), 4).alias("mean"), r(F.avg(F.when(F.col("o_totalprice") > 200000, 1).otherwise(0))).alias("share_high"))
    q = quantiles(o, ["grp", "state"], "o_totalprice", {"m": 0.5}, split=True).select("grp", "state", r("m", 4).alias("median"))
    return a.join(q, ["grp", "state"])


@query("describe_stats", f"""SELECT event_type AS kind, count(*) AS n, {rr('avg(value)')} AS mean, {rr('stddev_samp(value)')} AS std, {rr('min(value)')} AS min, {rr('quantile_cont(value, 0.25)')} AS q25, {rr('quantile_cont(value, 0.5)')} AS q50, {rr('quantile_cont(value, 0.75)')} AS q75, {rr('max(value)')} AS max FROM events GROUP BY 1""")
def _(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("event_type").alias("kind"), "value")
    a = e.groupBy("kind").agg(r(F.avg("value")).alias("mean"), r(F.stddev_samp("value")).alias("std"), r(F.min("value")).alias("min"), r(F.max("value")).alias("max"))
    q = quantiles(e, ["kind"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, split=True)
    return a.join(q.select("kind", "n", *[r(c).alias(c) for c in ("q25", "q50", "q75")]), "kind")


@query("crosstab", f"""SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o, {rr("count(*) FILTER (l_linestatus = 'F') / count(*)")} AS share_f FROM lineitem GROUP BY 1""")
def _(spark, sf):
    g = V.table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    f, o = F.coalesce("F", F.lit(0)), F.coalesce("O", F.lit(0))
    return g.select("l_returnflag", f.alias("f"), o.alias("o"), r(f / (f + o)).alias("share_f"))


@query("value_counts", f"SELECT event_type, n, {rr('n / sum(n) OVER ()')} AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def _(spark, sf):
    """Counts of every value and their shares of the total."""
    c = V.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = V.table(spark, sf, "events").count()
    return c.select("event_type", "n", r(F.col("n") / F.lit(total)).alias("share"))


@query("mode_label", "SELECT l_suppkey, arg_min(l_returnflag, {'n': -n, 'v': l_returnflag}) AS mode, max(n) AS n FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    c = V.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return c.groupBy("l_suppkey").agg(F.min_by("l_returnflag", F.struct(-F.col("n"), F.col("l_returnflag"))).alias("mode"), F.max("n").alias("n"))


@query("trial_rows", sql("duet", f"""lv(level) AS (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (2.0::DOUBLE)), d AS (SELECT clip, level, ax + level * ((frame * 7919 + clip * 104729) % 1000 / 500.0::DOUBLE - 1) AS a, bx + level * ((frame * 6101 + clip * 7607) % 1000 / 500.0::DOUBLE - 1) AS b FROM duet, lv WHERE ax IS NOT NULL AND bx IS NOT NULL)
 SELECT clip, level, count(*) AS n, {rr('corr(a, b)')} AS r0, {rr('avg(CASE WHEN a < 20 THEN 1 ELSE 0 END)')} AS low_a FROM d GROUP BY 1, 2"""))
def _(spark, sf):
    """Every trial at several added-noise levels; the three levels are exploded from the row itself."""
    nz = lambda p, q: (F.col("frame").cast("long") * p + F.col("clip") * q) % 1000 / 500.0 - 1
    d = V.duet(spark, sf).where(F.col("ax").isNotNull() & F.col("bx").isNotNull()).select("clip", "frame", "ax", "bx", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(2.0))).alias("level"))
    d = d.select("clip", "level", (F.col("ax") + F.col("level") * nz(7919, 104729)).alias("a"), (F.col("bx") + F.col("level") * nz(6101, 7607)).alias("b"))
    m = d.groupBy("clip", "level").agg(*moments(), F.avg(F.when(F.col("a") < 20, 1).otherwise(0)).alias("low"))
    return m.select("clip", "level", "n", r(corr_of()).alias("r0"), r("low").alias("low_a"))


@query("unit_tables", sql("duet pair", f"""u AS (SELECT 'frames' AS source, clip, frame, ax AS v FROM duet WHERE frame % 2 = 0 UNION ALL SELECT 'weeks', clip, frame, a FROM pair) SELECT source, clip, count(*) AS rows, count(v) AS n, {rr('avg(v)')} AS mean FROM u GROUP BY 1, 2"""))
def _(spark, sf):
    """Descriptor tables of several sources under one schema; the faster source keeps every second row."""
    a = V.duet(spark, sf).where(F.col("frame") % 2 == 0).select(F.lit("frames").alias("source"), "clip", "frame", F.col("ax").alias("v"))
    b = V.pair(spark, sf).select(F.lit("weeks").alias("source"), "clip", "frame", F.col("a").alias("v"))
    return a.unionByName(b).groupBy("source", "clip").agg(F.count("*").alias("rows"), F.count("v").alias("n"), r(F.avg("v")).alias("mean"))


@query("retrack_eval", sql("duet", f"""t AS (SELECT DISTINCT l_suppkey AS clip, l_linenumber * 37 AS frame, CASE WHEN l_linenumber <= 3 THEN 'hard' ELSE 'ordinary' END AS kind FROM lineitem), c AS (SELECT d.clip, kind, d.present_a AND d.present_b AS old_, d.present_a OR d.present_b AS new_ FROM duet d JOIN t USING (clip, frame))
 SELECT clip, kind, count(*) AS n, count(*) FILTER (old_) AS n_old, count(*) FILTER (new_) AS n_new, {rr('avg(CASE WHEN old_ THEN 1 ELSE 0 END)')} AS share_old FROM c GROUP BY 1, 2"""))
def _(spark, sf):
    """Old against new assignment on the checked frames."""
    t = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("clip"), (F.col("l_linenumber") * 37).alias("frame"), F.when(F.col("l_linenumber") <= 3, "hard").otherwise("ordinary").alias("kind")).distinct()
    c = V.duet(spark, sf).join(t, ["clip", "frame"]).select("clip", "kind", (F.col("present_a") & F.col("present_b")).alias("o"), (F.col("present_a") | F.col("present_b")).alias("w"))
    return c.groupBy("clip", "kind").agg(F.count("*").alias("n"), F.count_if("o").alias("n_old"), F.count_if("w").alias("n_new"), r(F.avg(F.when(F.col("o"), 1).otherwise(0))).alias("share_old"))


@query("distinct_ids", sql("det", "SELECT clip, count(DISTINCT track_id) AS n_ids, max(n) AS max_frames FROM (SELECT clip, track_id, count(*) AS n FROM det GROUP BY 1, 2) GROUP BY 1"))
def _(spark, sf):
    g = V.detections(spark, sf).groupBy("clip", "track_id").agg(F.count("*").alias("n"))
    return g.groupBy("clip").agg(F.count("*").alias("n_ids"), F.max("n").alias("max_frames"))


@query("group_demean", sql("duet track", f"SELECT clip, body, frame, {rr('x - avg(x) OVER (PARTITION BY clip, body)')} AS xd FROM track WHERE x IS NOT NULL"))
def _(spark, sf):
    """Group means by partial aggregation and a join, so a large group is never one task."""
    t = track(spark, sf).where(F.col("x").isNotNull())
    return t.join(t.groupBy(*K).agg(F.avg("x").alias("m")), K).select("clip", "body", "frame", r(F.col("x") - F.col("m")).alias("xd"))
