"""Vocabulary, charts and spectral kernels."""
from pyspark.sql import functions as F

from pairlane.functions import geometry as G
from pairlane.operators import spectral as SP
from pairlane.operators import words as WD
from pairlane.operators.ordered import over_neighbours, quantiles
from pairlane.operators.steps import dist
from pairlane.operators.joins import interval_join
from pairlane.sources import views as V

from .geometry import BODIES, PF_SQL, SC, bodies, markers, MARK_SQL
from .joins import descents
from .ordered import K, track
from .registry import query
from .sources import r, rr
from .views_sql import with_views as sql

COLS = ["trunk_tilt", "inverted", "arm_up_l", "arm_up_r", "level", "stance_width"]


def features(spark, sf):
    f = G.pose_features(F.col("m"), F.lit(SC))
    return bodies(spark, sf).select("clip", "frame", "body", *[F.when(f[c].isNotNull(), F.least(f[c], F.lit(3.0))).alias(c) if c == "stance_width" else f[c].alias(c) for c in COLS])


def imputed(spark, sf):
    f = features(spark, sf)
    return WD.impute(f, COLS, WD.medians(f, COLS))


IMP = BODIES + ", f AS (SELECT clip, frame, body, " + ", ".join((f"CASE WHEN {PF_SQL[c]} IS NOT NULL THEN least(3, {PF_SQL[c]}) END" if c == "stance_width" else PF_SQL[c]) + f" AS {c}" for c in COLS) + " FROM mb), md AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in COLS) + " FROM f), im AS (SELECT clip, frame, body, " + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in COLS) + " FROM f, md)"


@query("median_impute_clip", sql("pose", IMP + " SELECT clip, frame, body, " + ", ".join(f"{rr(c)} AS {c}" for c in COLS) + " FROM im"))
def _(spark, sf):
    return imputed(spark, sf).select("clip", "frame", "body", *[r(c).alias(c) for c in COLS])


@query("zscore_fit_transform", sql("pose", IMP + ", st AS (SELECT " + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in COLS) + " FROM im) SELECT clip, frame, body, " + ", ".join(f"{rr(f'({c} - a_{c}) / s_{c}')} AS z_{c}" for c in COLS) + " FROM im, st"))
def _(spark, sf):
    d = imputed(spark, sf)
    return WD.zscore(d, COLS, WD.zscore_fit(d, COLS)).select("clip", "frame", "body", *[r(f"z_{c}").alias(f"z_{c}") for c in COLS])


def worded(spark, sf, k=6):
    d = imputed(spark, sf)
    z = WD.zscore(d, COLS, WD.zscore_fit(d, COLS))
    fit = WD.fit_words(z, COLS, k)
    return WD.apply_words(z, COLS, fit), fit


@query("kmeans_words")
def _(spark, sf):
    return worded(spark, sf)[0].groupBy("clip", "word").agg(F.count("*").alias("n"))


@query("word_profiles")
def _(spark, sf):
    w, _ = worded(spark, sf)
    lng = w.select("word", F.explode(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).alias("v")) for c in COLS])).alias("s")).select("word", "s.m", "s.v")
    q = quantiles(lng, ["word", "m"], "v", {"med": 0.5}, split=True)
    return q.groupBy("word").agg(F.max("n").alias("n"), *[r(F.max(F.when(F.col("m") == c, F.col("med")))).alias(c) for c in COLS])


@query("apply_vocab")
def _(spark, sf):
    """Vocabulary fitted on body A, medians and scaling included, applied to body B."""
    f = features(spark, sf)
    a = f.where(F.col("body") == "A")
    med = WD.medians(a, COLS)
    da = WD.impute(a, COLS, med)
    fit = WD.zscore_fit(da, COLS)
    voc = WD.fit_words(WD.zscore(da, COLS, fit), COLS, 6)
    b = WD.zscore(WD.impute(f.where(F.col("body") == "B"), COLS, med), COLS, fit)
    return WD.apply_words(b, COLS, voc).groupBy("clip", "word").agg(F.count("*").alias("n"))


NM = 21
PD_SQL = "WITH " + MARK_SQL + ", pd AS (SELECT a.clip, a.frame, a.marker AS i, b.marker AS j, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) AS d FROM mk a JOIN mk b ON a.clip = b.clip AND a.frame = b.frame AND a.marker < b.marker)"


def marker_distances(spark, sf, ids=None):
    """Distances between the markers of one body, inside the row: clip, frame, i, j, d."""
    ids = list(ids or range(NM))
    g = lambda i, c: F.get("mk", F.lit(i))[c]
    d = lambda i, j: F.sqrt(sum(((g(i, c) - g(j, c)) * (g(i, c) - g(j, c)) for c in "xyz"), F.lit(0.0)))
    if len(ids) > 6:
        pairs = F.flatten(F.transform("mk", lambda u, i: F.transform("mk", lambda v, j: F.struct(i.alias("i"), j.alias("j"), F.sqrt((u["x"] - v["x"]) * (u["x"] - v["x"]) + (u["y"] - v["y"]) * (u["y"] - v["y"]) + (u["z"] - v["z"]) * (u["z"] - v["z"])).alias("d")))))
        pairs = F.filter(pairs, lambda s: s["i"] < s["j"])
    else:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), d(i, j).alias("d")) for i in ids for j in ids if i < j])
    return markers(spark, sf).select("clip", "frame", F.explode(pairs).alias("s")).select("clip", "frame", "s.*")


@query("median_marker_distances", PD_SQL + f" SELECT clip, i, j, {rr('quantile_cont(d, 0.5)')} AS d FROM pd GROUP BY clip, i, j")
def _(spark, sf):
    q = quantiles(marker_distances(spark, sf), ["clip", "i", "j"], "d", {"m": 0.5})
    return q.select("clip", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r("m").alias("d"))


@query("body_chart_mds", "WITH e AS (SELECT label AS clip FROM embeddings GROUP BY 1) SELECT clip, CAST(p.range AS INT) AS point FROM e, range(21) p")
def _(spark, sf):
    """Canonical layout per clip from the median distances; eigenvector signs are free, so the check
    compares the points and the tests compare the distances."""
    return chart(spark, sf).select("clip", "point")


def chart(spark, sf):
    q = quantiles(marker_distances(spark, sf), ["clip", "i", "j"], "d", {"d": 0.5})
    return WD.mds_chart(q, "clip", NM)


@query("body_chart_coordinates")
def _(spark, sf):
    return chart(spark, sf).select("clip", "point", *[r(F.abs(f"c{k}"), 4).alias(f"abs_c{k}") for k in range(3)])


@query("rigid_noise", PD_SQL + f", g AS (SELECT clip, i, j, stddev_pop(d) AS sd, CASE WHEN i < 4 AND j < 4 THEN 'head' WHEN i BETWEEN 10 AND 12 AND j BETWEEN 10 AND 12 THEN 'arm' WHEN i BETWEEN 16 AND 18 AND j BETWEEN 16 AND 18 THEN 'leg' END AS grp FROM pd GROUP BY clip, i, j), m AS (SELECT clip, grp, avg(sd) AS sd FROM g WHERE grp IS NOT NULL GROUP BY 1, 2) SELECT clip, {rr('quantile_cont(sd, 0.5)')} AS noise FROM m GROUP BY clip")
def _(spark, sf):
    b = lambda lo, hi: F.col("i").between(lo, hi) & F.col("j").between(lo, hi)
    d = marker_distances(spark, sf).withColumn("grp", F.when(b(0, 3), "head").when(b(10, 12), "arm").when(b(16, 18), "leg")).where(F.col("grp").isNotNull())
    m = d.groupBy("clip", "grp", "i", "j").agg(F.stddev_pop("d").alias("sd")).groupBy("clip", "grp").agg(F.avg("sd").alias("sd"))
    return m.groupBy("clip").agg(r(F.percentile("sd", F.lit(0.5))).alias("noise"))                # three groups per clip


# ---- recursive filters and spectra


@query("bandpass_runs")
def _(spark, sf):
    """Low, mid and high band of every run of at least sixteen rows."""
    bands = {"low": (None, 0.5), "mid": (0.5, 1.5), "high": (1.5, None)}
    out = SP.filter_bands(track(spark, sf), K, ["x"], 10.0, bands, 16)
    return out.select(*K, "frame", *[r(f"x_{n}", 5).alias(n) for n in bands])


@query("lowpass")
def _(spark, sf):
    return SP.filter_runs(track(spark, sf), K, ["x", "y"], 30.0, hi=3.0, min_run=13).select(*K, "frame", r("x_f", 5).alias("x"), r("y_f", 5).alias("y"))


@query("fir_lowpass", sql("duet track", "t AS (SELECT clip, body, frame, coalesce(x, 50) AS x FROM track) SELECT clip, body, frame, " + rr("CASE WHEN count(*) OVER (PARTITION BY clip, body ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) = 9 THEN " + " + ".join(
    f"({'lag(x, ' + str(-o) + ')' if o < 0 else 'lead(x, ' + str(o) + ')'} OVER (PARTITION BY clip, body ORDER BY frame)) * {{{o + 4}}}" for o in range(-4, 5)) + " END") + " AS x FROM t"))
def _(spark, sf):
    """Native alternative to the recursive low-pass: a nine-tap windowed sinc."""
    t = track(spark, sf).withColumn("x", F.coalesce("x", F.lit(50.0)))
    w9 = fir_taps(9, 0.2)
    def stage(w):
        at = lambda o: F.col("x") if o == 0 else F.lag("x", -o).over(w) if o < 0 else F.lead("x", o).over(w)
        return sum((at(o) * v for o, v in zip(range(-4, 5), w9)), F.lit(0.0))
    t = over_neighbours(t, K, {"f": stage}, 4, 4)
    return t.select(*K, "frame", r("f").alias("x"))


def fir_taps(n, cutoff):
    import numpy as np
    k = np.arange(n) - (n - 1) / 2
    h = np.sinc(2 * cutoff * k) * np.hamming(n)
    return [float(v) for v in h / h.sum()]


def _fill_taps():
    from .registry import ORACLES
    for i, v in enumerate(fir_taps(9, 0.2)):
        ORACLES["fir_lowpass"] = ORACLES["fir_lowpass"].replace(f"{{{i}}}", f"({v!r}::DOUBLE)")


_fill_taps()


@query("phase_coherence")
def _(spark, sf):
    """Phase locking value of the two scalar series of each clip: mean resultant of the phase difference."""
    p = SP.phase_difference(V.pair(spark, sf), ["clip"], "a", "b", 10.0).where(F.col("dphi").isNotNull())
    return p.groupBy("clip").agg(F.count("*").alias("n"), r(F.sqrt(F.avg(F.cos("dphi")) ** 2 + F.avg(F.sin("dphi")) ** 2), 5).alias("plv"))


AUD = "au AS (SELECT clip, CAST(floor(frame / 16) AS INT) AS f, frame % 16 AS i, coalesce(ax, 0) / 100 AS s FROM duet), ar AS (SELECT clip, f, ln(sqrt(avg(s * s)) + 1e-6::DOUBLE) AS rms, count(*) AS n FROM au GROUP BY 1, 2 HAVING count(*) = 16)"


@query("audio_envelope", sql("duet", AUD + f""", tw AS (SELECT k.range AS k, i.range AS i, (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i.range / 15)) * cos(2 * pi() * k.range * i.range / 16) AS c, (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i.range / 15)) * sin(2 * pi() * k.range * i.range / 16) AS s FROM range(9) k, range(16) i),
 mg AS (SELECT clip, f, k, sqrt(power(sum(au.s * c), 2) + power(sum(au.s * tw.s), 2)) AS m FROM au JOIN tw USING (i) GROUP BY 1, 2, 3), fx AS (SELECT a.clip, a.f, sum(greatest(a.m - b.m, 0)) AS flux FROM mg a JOIN mg b ON a.clip = b.clip AND a.k = b.k AND b.f = a.f - 1 GROUP BY 1, 2)
 SELECT ar.clip, ar.f, {rr('rms')} AS rms, {rr('flux')} AS flux FROM ar LEFT JOIN fx ON fx.clip = ar.clip AND fx.f = ar.f"""))
def _(spark, sf):
    """Log RMS and half-wave spectral flux per block of sixteen samples."""
    a = V.duet(spark, sf).select("clip", F.floor(F.col("frame") / 16).cast("int").alias("frame"), (F.col("frame") % 16).alias("i"), (F.coalesce("ax", F.lit(0.0)) / 100).alias("s"))
    g = a.groupBy("clip", "frame").agg(F.ln(F.sqrt(F.avg(F.col("s") * F.col("s"))) + 1e-6).alias("rms"), F.sort_array(F.collect_list(F.struct("i", "s"))).alias("v")).where(F.size("v") == 16)
    g = g.select("clip", "frame", "rms", SP.spectrum_udf(16)(F.transform("v", lambda x: x["s"])).alias("m"))
    g = over_neighbours(g, ["clip"], {"p": lambda w: F.lag("m").over(w)}, back=1)
    flux = F.aggregate(F.zip_with("m", "p", lambda x, y: F.greatest(x - y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return g.select("clip", F.col("frame").alias("f"), r("rms").alias("rms"), r(F.when(F.col("p").isNotNull(), flux)).alias("flux"))


@query("stabilise", sql("duet", """ev0 AS (SELECT clip, frame, CASE WHEN ax >= 60 THEN frame END AS sf, CASE WHEN ax < 10 THEN frame END AS ff FROM duet), nx AS (SELECT clip, frame AS f1, ff, last_value(sf IGNORE NULLS) OVER w AS f0, last_value(ff IGNORE NULLS) OVER w AS pf FROM ev0 WINDOW w AS (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 ev AS (SELECT clip, f0, f1 FROM nx WHERE ff IS NOT NULL AND f0 IS NOT NULL AND f1 - f0 BETWEEN 1 AND 2 AND (pf IS NULL OR pf < f0)),
 j AS (SELECT e.clip, f0, f1, coalesce(a.m00, 1) AS a00, coalesce(a.m01, 0) AS a01, coalesce(a.m02, 0) AS a02, coalesce(a.m10, 0) AS a10, coalesce(a.m11, 1) AS a11, coalesce(a.m12, 0) AS a12, coalesce(b.m00, 1) AS b00, coalesce(b.m01, 0) AS b01, coalesce(b.m02, 0) AS b02, coalesce(b.m10, 0) AS b10, coalesce(b.m11, 1) AS b11, coalesce(b.m12, 0) AS b12, CASE WHEN f1 - f0 = 1 THEN a.ax ELSE b.ax END AS x, CASE WHEN f1 - f0 = 1 THEN a.ay ELSE b.ay END AS y FROM ev e JOIN duet a ON a.clip = e.clip AND a.frame = f0 + 1 LEFT JOIN duet b ON b.clip = e.clip AND b.frame = f0 + 2 AND f1 - f0 = 2),
 u AS (SELECT clip, f0, f1, CASE WHEN f1 - f0 = 2 THEN (b11 * (x - b02) - b01 * (y - b12)) / (b00 * b11 - b01 * b10) ELSE x END AS x, CASE WHEN f1 - f0 = 2 THEN (b00 * (y - b12) - b10 * (x - b02)) / (b00 * b11 - b01 * b10) ELSE y END AS y, a00, a01, a02, a10, a11, a12 FROM j)
 SELECT clip, f0, f1, """ + rr("(a11 * (x - a02) - a01 * (y - a12)) / (a00 * a11 - a01 * a10)", 5) + " AS x, " + rr("(a00 * (y - a12) - a10 * (x - a02)) / (a00 * a11 - a01 * a10)", 5) + " AS y FROM u"))
def _(spark, sf):
    """Last point of each short event mapped back through the camera steps to its first frame."""
    d = V.duet(spark, sf)
    ev = descents(d, ["clip"], F.col("ax") >= 60, F.col("ax") < 10, 20).select("clip", "f0", "f1").where(F.col("f1") - F.col("f0") <= 2)
    j = interval_join(d.select("clip", "frame", "ax", "ay", "m00", "m01", "m02", "m10", "m11", "m12"), ev, "clip", "frame", "f0", "f1", 64)
    st = F.struct("frame", "ax", "ay", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("m00", 1.0), ("m01", 0.0), ("m02", 0.0), ("m10", 0.0), ("m11", 1.0), ("m12", 0.0))])
    g = j.groupBy("clip", "f0", "f1").agg(F.sort_array(F.collect_list(st), asc=False).alias("s"))                      # latest first, at most 21 rows
    last = F.get("s", F.lit(0))
    start = F.struct(last["ax"].alias("x"), last["ay"].alias("y"))

    def back(acc, m):
        det = m["m00"] * m["m11"] - m["m01"] * m["m10"]
        dx, dy = acc["x"] - m["m02"], acc["y"] - m["m12"]
        return F.struct(((m["m11"] * dx - m["m01"] * dy) / det).alias("x"), ((m["m00"] * dy - m["m10"] * dx) / det).alias("y"))
    g = g.select("clip", "f0", "f1", F.aggregate(F.slice("s", 1, F.size("s") - 1), start, back).alias("p"))
    return g.select("clip", "f0", "f1", r("p.x", 5).alias("x"), r("p.y", 5).alias("y"))


@query("tracklet_activity", sql("det", f"""s AS (SELECT clip, track_id, frame, cx, cy, y2 - y1 AS h, frame - lag(frame) OVER w AS df, sqrt(power(cx - lag(cx) OVER w, 2) + power(cy - lag(cy) OVER w, 2)) AS st FROM det WINDOW w AS (PARTITION BY clip, track_id ORDER BY frame)) SELECT clip, track_id, count(*) AS n_frames, {rr('quantile_cont(h, 0.5)')} AS bbox_h, {rr('quantile_cont(st, 0.5) FILTER (df <= 6) / quantile_cont(h, 0.5)')} AS activity FROM s GROUP BY 1, 2"""))
def _(spark, sf):
    """Median step between close frames over median box height, per track."""
    k = ["clip", "track_id"]
    d = V.detections(spark, sf).select(*k, "frame", "cx", "cy", (F.col("y2") - F.col("y1")).alias("h"))
    d = over_neighbours(d, k, {"df": lambda w: F.col("frame") - F.lag("frame").over(w), "st": lambda w: dist(F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w))}, back=7)
    h = quantiles(d, k, "h", {"mh": 0.5}).withColumnRenamed("n", "n_frames")
    a = quantiles(d.where(F.col("df") <= 6), k, "st", {"ms": 0.5}).drop("n")
    return h.join(a, k, "left").select(*k, "n_frames", r("mh").alias("bbox_h"), r(F.col("ms") / F.col("mh")).alias("activity"))


@query("mocap_signals", "WITH " + MARK_SQL + """, tr AS (SELECT a.clip, quantile_cont(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)), 0.5) AS trunk FROM mk a JOIN mk b ON a.clip = b.clip AND a.frame = b.frame AND a.marker = 4 AND b.marker = 13 GROUP BY 1), p AS (SELECT mk.clip, row_number() OVER (PARTITION BY mk.clip ORDER BY frame) - 1 AS frame, x / trunk AS x, y / trunk AS y, z / trunk AS z FROM mk JOIN tr USING (clip) WHERE marker = 13)
 SELECT clip, CAST(frame AS INT) AS frame, """ + rr("sqrt(power((lead(x) OVER w - lag(x) OVER w) * 12.5::DOUBLE, 2) + power((lead(y) OVER w - lag(y) OVER w) * 12.5::DOUBLE, 2))", 5) + " AS speed, " + rr("(lead(z) OVER w - lag(z) OVER w) * 12.5::DOUBLE", 5) + " AS bounce FROM p WINDOW w AS (PARTITION BY clip ORDER BY frame)")
def _(spark, sf):
    """Body-length units by the median trunk, then horizontal speed and vertical velocity of the pelvis."""
    from pairlane.operators.ordered import bucketed_row_number
    m = markers(spark, sf)
    g = lambda i, c: F.get("mk", F.lit(i))[c]
    m = m.select("clip", F.col("frame").alias("vec_id"), g(13, "x").alias("x"), g(13, "y").alias("y"), g(13, "z").alias("z"),
                 F.sqrt(sum(((g(4, c) - g(13, c)) * (g(4, c) - g(13, c)) for c in "xyz"), F.lit(0.0))).alias("t"))
    q = quantiles(m, ["clip"], "t", {"trunk": 0.5}).select("clip", "trunk")
    d = bucketed_row_number(m, ["clip"], F.floor(F.col("vec_id") / 65536), ["vec_id"], "frame").join(q, "clip")
    d = d.select("clip", "frame", *[(F.col(c) / F.col("trunk")).alias(c) for c in "xyz"])
    v = lambda c: lambda w: (F.lead(c).over(w) - F.lag(c).over(w)) * 12.5
    d = over_neighbours(d, ["clip"], {f"v{c}": v(c) for c in "xyz"}, 1, 1)
    return d.select("clip", "frame", r(dist(F.col("vx"), F.col("vy")), 5).alias("speed"), r("vz", 5).alias("bounce"))
