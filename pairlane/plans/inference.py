"""Correlation, shift nulls and tests."""
import functools

from pyspark.sql import functions as F

from pairlane.functions import geometry as G
from pairlane.functions.mathx import probit, probit_sql
from pairlane.operators import inference as I
from pairlane.operators import lags as L
from pairlane.operators import rolls as R
from pairlane.operators import series as S
from pairlane.operators import windows as WN
from pairlane.operators.ordered import average_ranks, over_neighbours, quantiles
from pairlane.operators.pseudo import pseudo_similarity
from pairlane.operators.steps import Step, apply_steps, dist, rolling
from pairlane.operators.windows import window_rows
from pairlane.sources import views as V
from pairlane.sources.scratch import staged

from .geometry import ANG, angd_sql, pairs
from .joins import PSEUDO, pseudo
from .registry import query
from .sources import r, rr
from .views_sql import with_views as sql
from .windows import LEN, WIN_SQL, frames

C = ["clip"]
SHIFTS = L.shift_table(500, 20, 300)         # weeks
LOCAL = L.shift_table(500, 6, 20)            # every shift of the range, both ways
CIRC, STATE_SHIFTS = L.shift_table(200, 10, 120), L.shift_table(100, 6, 34)


def lc_sql(src, max_lag, min_n, keys="clip"):
    k = ", ".join(f"x.{c}" for c in keys.split(", "))
    on = " AND ".join(f"x.{c} = y.{c}" for c in keys.split(", "))
    return (f"lm AS (SELECT {k}, y.frame - x.frame AS lag, count(*) AS n, sum(x.a) AS sx, sum(y.b) AS sy, sum(x.a * x.a) AS sxx, sum(y.b * y.b) AS syy, sum(x.a * y.b) AS sxy FROM {src} x JOIN {src} y ON {on} AND y.frame BETWEEN x.frame - {max_lag} AND x.frame + {max_lag} WHERE x.a IS NOT NULL AND y.b IS NOT NULL GROUP BY ALL), "
            f"lc AS (SELECT {keys}, lag, n, CASE WHEN n >= {min_n} AND sxx - sx*sx/n > 1e-12 AND syy - sy*sy/n > 1e-12 THEN greatest(-1, least(1, (sxy - sx*sy/n) / sqrt((sxx - sx*sx/n) * (syy - sy*sy/n)))) END AS r FROM lm), "
            f"pk AS (SELECT {keys}, arg_min(lag, {{'m': -abs(r), 'l': lag}}) FILTER (r IS NOT NULL) AS lag, arg_min(r, {{'m': -abs(r), 'l': lag}}) FILTER (r IS NOT NULL) AS r, max(r) FILTER (lag = 0) AS r0 FROM lc GROUP BY {keys})")


@query("lagged_corr", sql("pair", lc_sql("pair", 6, 50) + f" SELECT clip, lag, n, {rr('r')} AS r FROM lc"))
def _(spark, sf):
    return L.lagged_corr(V.pair(spark, sf), C, max_lag=6).select("clip", "lag", "n", r("r").alias("r"))


@query("peak", sql("pair", lc_sql("pair", 6, 50) + f" SELECT clip, {rr('lag / 1.0::DOUBLE')} AS peak_lag_s, {rr('r')} AS peak_r, {rr('r0')} AS r_lag0 FROM pk"))
def _(spark, sf):
    p = L.peak(L.lagged_corr(V.pair(spark, sf), C, max_lag=6), C, 1.0)
    return p.select("clip", r("peak_lag_s").alias("peak_lag_s"), r("peak_r").alias("peak_r"), r("r_lag0").alias("r_lag0"))


@query("peak_hourly", sql("hourly", lc_sql("hourly", 24, 50) + f" SELECT clip, {rr('lag / 1.0::DOUBLE')} AS peak_lag_h, {rr('r')} AS peak_r, {rr('r0')} AS r_lag0 FROM pk"))
def _(spark, sf):
    """Do the click and view series move together, and at which lag?"""
    p = L.peak(L.lagged_corr(V.hourly_long(spark, sf), C, max_lag=24), C, 1.0)
    return p.select("clip", r("peak_lag_s").alias("peak_lag_h"), r("peak_r").alias("peak_r"), r("r_lag0").alias("r_lag0"))


XC = """v AS (SELECT clip, CAST(row_number() OVER (PARTITION BY clip ORDER BY frame) AS INT) AS frame, (a - avg(a) OVER p) / stddev_pop(a) OVER p AS a, (b - avg(b) OVER p) / stddev_pop(b) OVER p AS b, count(*) OVER p AS n FROM pair WHERE a IS NOT NULL AND b IS NOT NULL WINDOW p AS (PARTITION BY clip)),
 xc AS (SELECT x.clip, y.frame - x.frame AS lag, sum(x.a * y.b) / any_value(x.n) AS r FROM v x JOIN v y ON x.clip = y.clip AND y.frame BETWEEN x.frame - 6 AND x.frame + 6 WHERE x.n >= 30 GROUP BY 1, 2)"""


@query("xcorr_dropna", sql("pair", XC + f" SELECT clip, lag, {rr('r')} AS r FROM xc"))
def _(spark, sf):
    return L.xcorr_dropna(V.pair(spark, sf), C, 6, 30).select("clip", "lag", r("r").alias("r"))


@query("rolling_xcorr", sql("pair", """w AS (SELECT clip, frame, a, b, unnest(range(CAST(greatest(0, ceil((frame - 99) / 25.0::DOUBLE)) AS BIGINT), CAST(floor(frame / 25) AS BIGINT) + 1)) AS wid FROM pair WHERE a IS NOT NULL AND b IS NOT NULL),
 v AS (SELECT clip, wid, row_number() OVER (PARTITION BY clip, wid ORDER BY frame) AS i, (a - avg(a) OVER p) / stddev_pop(a) OVER p AS a, (b - avg(b) OVER p) / stddev_pop(b) OVER p AS b, count(*) OVER p AS n FROM w WINDOW p AS (PARTITION BY clip, wid)),
 xc AS (SELECT x.clip, x.wid, y.i - x.i AS lag, sum(x.a * y.b) / any_value(x.n) AS r FROM v x JOIN v y ON x.clip = y.clip AND x.wid = y.wid AND y.i BETWEEN x.i - 4 AND x.i + 4 WHERE x.n >= 20 GROUP BY 1, 2, 3)
 SELECT clip, wid, arg_min(lag, {'m': -abs(r), 'l': lag}) AS peak_lag, """ + rr("arg_min(r, {'m': -abs(r), 'l': lag})") + " AS peak_r FROM xc GROUP BY 1, 2"))
def _(spark, sf):
    """Peak lag and r per overlapping window, gaps closed up inside the window."""
    d = window_rows(V.pair(spark, sf), 100, 25)
    x = L.xcorr_dropna(d, ["clip", "wid"], 4, 20).where(F.col("r") != 0.0)
    p = x.groupBy("clip", "wid").agg(F.min(F.struct((-F.abs("r")).alias("m"), F.col("lag").cast("long").alias("lag"), "r")).alias("p"))
    return p.select("clip", "wid", F.col("p.lag").alias("peak_lag"), r("p.r").alias("peak_r"))


def null_sql(src, shifts, max_lag, min_n, keys="clip"):
    """CTEs: peaks per (keys, k) for B rolled by each shift, then null summary `ns`.  `src` has a, b, mask."""
    ks = ", ".join(f"({k})" for k in [0, *shifts])
    pre = lambda a: ", ".join(f"{a}.{c}" for c in keys.split(", "))
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys.split(", "))
    return (f"sh(k) AS (VALUES {ks}), tt AS (SELECT {keys}, max(frame) + 1 AS t FROM {src} GROUP BY {keys}), "
            f"rb AS (SELECT {pre('s')}, k, ((s.frame + k) % t + t) % t AS frame, b FROM {src} s JOIN tt ON {on('s', 'tt')}, sh WHERE b IS NOT NULL), "
            f"ra AS (SELECT {keys}, frame, a FROM {src} WHERE mask AND a IS NOT NULL), rm AS (SELECT {pre('rb')}, k, rb.frame, rb.b FROM rb JOIN {src} m ON {on('rb', 'm')} AND rb.frame = m.frame AND m.mask), "
            f"yl AS (SELECT rm.*, l.range - {max_lag} AS lag, frame - (l.range - {max_lag}) AS at FROM rm, range({2 * max_lag + 1}) l), "
            f"lm AS (SELECT {pre('x')}, y.k, y.lag, count(*) AS n, sum(x.a) AS sx, sum(y.b) AS sy, sum(x.a*x.a) AS sxx, sum(y.b*y.b) AS syy, sum(x.a*y.b) AS sxy FROM yl y JOIN ra x ON {on('x', 'y')} AND x.frame = y.at GROUP BY ALL), "
            f"lc AS (SELECT {keys}, k, lag, CASE WHEN n >= {min_n} THEN (sxy - sx*sy/n) / sqrt((sxx - sx*sx/n) * (syy - sy*sy/n)) END AS r FROM lm), "
            f"pk AS (SELECT {keys}, k, arg_min(r, {{'m': -abs(r), 'l': lag}}) FILTER (r IS NOT NULL) AS r, arg_min(lag, {{'m': -abs(r), 'l': lag}}) FILTER (r IS NOT NULL) AS lag FROM lc GROUP BY ALL), "
            f"ns AS (SELECT {pre('o')}, any_value(o.r) AS r_obs, any_value(o.lag) AS lag_obs, count(*) AS n_null, CASE WHEN count(*) >= 10 THEN (count(*) FILTER (abs(p.r) >= abs(o.r)) + 1) / (count(*) + 1) END AS p, CASE WHEN count(*) >= 10 THEN (any_value(abs(o.r)) - avg(abs(p.r))) / (stddev_pop(abs(p.r)) + 1e-12::DOUBLE) END AS z, CASE WHEN count(*) >= 10 THEN quantile_cont(abs(p.r), 0.95) END AS null_95 "
            f"FROM pk o JOIN pk p ON {on('o', 'p')} WHERE o.k = 0 AND p.k <> 0 AND p.r IS NOT NULL AND o.r IS NOT NULL GROUP BY {pre('o')})")


NS_COLS = f"n_null, {rr('r_obs')} AS r_obs, {rr('p')} AS p, {rr('z', 5)} AS z, {rr('null_95')} AS null_95"


def ns_out(s, keys):
    return s.where(F.col("r_obs").isNotNull()).select(*keys, "n_null", r("r_obs").alias("r_obs"), r("p").alias("p"), r("z", 5).alias("z"), r("null_95").alias("null_95"))


def masked_pair(spark, sf):
    return V.pair(spark, sf).withColumn("mask", F.lit(True))


@query("shift_null", sql("pair", "mp AS (SELECT *, true AS mask FROM pair), " + null_sql("mp", SHIFTS, 3, 50) + f" SELECT clip, {NS_COLS} FROM ns"))
def _(spark, sf):
    return ns_out(L.shift_summary(masked_pair(spark, sf), C, 1.0, 3, SHIFTS), C)


@query("surrogate_circ", sql("pair", "mp AS (SELECT clip, CAST(row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS INT) AS frame, a, b, true AS mask FROM pair WHERE a IS NOT NULL AND b IS NOT NULL), " + null_sql("mp", CIRC, 3, 30) + f" SELECT clip, {NS_COLS} FROM ns"))
def _(spark, sf):
    """Circular shifts of the gap-dropped series."""
    from pairlane.operators.ordered import running
    d = V.pair(spark, sf).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    d = running(d, C, {"_i": ("sum", F.lit(1))}).select("clip", (F.col("_i") - 1).cast("int").alias("frame"), "a", "b", F.lit(True).alias("mask"))
    return ns_out(L.shift_summary(d, C, 1.0, 3, CIRC, 30), C)


BAT = """t0 AS (SELECT *, a - avg(a) OVER w AS la, b - avg(b) OVER w AS lb, abs(a - b) AS dd FROM pair WINDOW w AS (PARTITION BY clip ORDER BY frame RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
 rg AS (SELECT clip, regr_slope(a, frame) AS sa, regr_slope(b, frame) AS sb, avg(a) FILTER (a IS NOT NULL) AS ma, avg(frame) FILTER (a IS NOT NULL) AS fa, avg(b) AS mb, avg(frame) FILTER (b IS NOT NULL) AS fb FROM pair GROUP BY clip),
 bt AS (SELECT clip, 'circ' AS test, frame, a, b, true AS mask FROM pair UNION ALL SELECT clip, 'local_units', frame, la, lb, true FROM t0 UNION ALL SELECT clip, 'near', frame, a, b, coalesce(dd < 30, false) FROM t0 UNION ALL SELECT clip, 'far', frame, a, b, coalesce(dd >= 15, false) FROM t0
 UNION ALL SELECT clip, 'time_partial', frame, a - ma - sa * (frame - fa), b - mb - sb * (frame - fb), true FROM pair JOIN rg USING (clip))"""


def battery(spark, sf):
    """All tests of a clip as rows of one long table: clip, test, frame, a, b, mask."""
    p = V.pair(spark, sf)
    w = lambda c: lambda w: F.col(c) - F.avg(c).over(w.rangeBetween(-5, 5))
    t0 = over_neighbours(p, C, {"la": w("a"), "lb": w("b")}, 5, 5).withColumn("dd", F.abs(F.col("a") - F.col("b")))
    t0 = S.partial_out(t0, C, "a", ["frame"], "pa")
    t0 = S.partial_out(t0, C, "b", ["frame"], "pb")
    no = F.lit(False)
    test = lambda n, a, b, m: F.struct(F.lit(n).alias("test"), F.col(a).alias("a"), F.col(b).alias("b"), m.alias("mask"))
    tests = F.array(test("circ", "a", "b", F.lit(True)), test("local_units", "la", "lb", F.lit(True)), test("near", "a", "b", F.coalesce(F.col("dd") < 30, no)),
                    test("far", "a", "b", F.coalesce(F.col("dd") >= 15, no)), test("time_partial", "pa", "pb", F.lit(True)))
    return t0.select("clip", "frame", F.explode(tests).alias("t")).select("clip", "t.test", "frame", "t.a", "t.b", "t.mask")


def battery_p(spark, sf):
    k = ["clip", "test"]
    b = battery(spark, sf)
    s = L.shift_summary(b, k, 1.0, 3, SHIFTS, 30)
    loc = masked_pair(spark, sf).withColumn("test", F.lit("local"))
    return s.unionByName(L.shift_summary(loc, k, 1.0, 3, LOCAL, 30))


BATQ = "a_ AS (WITH " + BAT + ", " + null_sql("bt", SHIFTS, 3, 30, "clip, test") + " SELECT * FROM ns), b_ AS (WITH bt AS (SELECT clip, 'local' AS test, frame, a, b, true AS mask FROM pair), " + null_sql("bt", LOCAL, 3, 30, "clip, test") + " SELECT * FROM ns), bat AS (SELECT * FROM a_ UNION ALL SELECT * FROM b_)"


@query("coupling_battery", sql("pair", BATQ + f" SELECT clip, test, {NS_COLS} FROM bat"))
def _(spark, sf):
    return ns_out(battery_p(spark, sf), ["clip", "test"])


@query("coupling_by_state", sql("pair", "mp AS (SELECT clip, CASE WHEN a > b THEN 'up' ELSE 'down' END AS state, frame, a, b, true AS mask FROM pair WHERE a IS NOT NULL AND b IS NOT NULL), mr AS (SELECT clip, state, CAST(row_number() OVER (PARTITION BY clip, state ORDER BY frame) - 1 AS INT) AS frame, a, b, mask FROM mp), "
             + null_sql("mr", STATE_SHIFTS, 2, 30, "clip, state") + f", n AS (SELECT clip, state, count(*) AS n_frames FROM mr GROUP BY 1, 2) SELECT n.clip, n.state, n_frames, {NS_COLS} FROM ns JOIN n USING (clip, state) WHERE n_frames >= 40"))
def _(spark, sf):
    """Coupling and null restricted to each state, frames dropped jointly."""
    from pairlane.operators.ordered import running
    k = ["clip", "state"]
    d = V.pair(spark, sf).where(F.col("a").isNotNull() & F.col("b").isNotNull()).withColumn("state", F.when(F.col("a") > F.col("b"), "up").otherwise("down"))
    d = running(d, k, {"_i": ("sum", F.lit(1))}).select(*k, (F.col("_i") - 1).cast("int").alias("frame"), "a", "b", F.lit(True).alias("mask"))
    n = d.groupBy(*k).agg(F.count("*").alias("n_frames")).where(F.col("n_frames") >= 40)
    s = L.shift_summary(d, k, 1.0, 2, STATE_SHIFTS, 30)
    return ns_out(s, k).join(n, k)


@query("pseudo_pairs", sql("pair", PSEUDO + f" SELECT ca AS clip_a, count(*) AS n, {rr('max(r)')} AS max_abs_r, {rr('avg(r0)')} AS mean_r0 FROM pr WHERE ca <> cb GROUP BY ca"))
def _(spark, sf):
    """Each clip's A against B of the clips of other groups."""
    return pseudo(spark, sf, roles=(0,)).where("pairs_a > 0").select(F.col("clip").alias("clip_a"), F.col("pairs_a").alias("n"), r("max_abs_r_a").alias("max_abs_r"), r("mean_r0_a").alias("mean_r0"))


#: Hand-off: lags, window, step and threshold of the windowed r; sides of the tests.
HAND_LAG, HAND_WIN, HAND_STEP, HAND_THR = 3, 8, 2, 0.5
HAND_SETS, SIDES = {"shift": R.Spread(200, 60)}, {"r0": "two", "rmin": "less", "frac_neg": "greater", "frac_pos": "greater"}


def spread_sql(name, spread, t="t"):
    return f"SELECT DISTINCT clip, '{name}' AS nul, {spread.margin} + (({t} - {2 * spread.margin}) * (2 * i.range + 1)) // {2 * spread.n} AS k FROM tt, range({spread.n}) i WHERE {t} > {2 * spread.margin}"


def hand_sql():
    lags, w = range(-HAND_LAG, HAND_LAG + 1), HAND_WIN
    move = lambda l: f"lead(b, {l}) OVER s" if l >= 0 else f"lag(b, {-l}) OVER s"
    beyond = {"two": "abs(p.{c} - m_{c}) >= abs(o.{c} - m_{c})", "less": "p.{c} <= o.{c}", "greater": "p.{c} >= o.{c}"}
    ok = "any_value(o.n) >= 60 AND count(p.{c}) >= 20 AND any_value(o.{c}) IS NOT NULL"
    tests = ", ".join(x for c, side in SIDES.items() for x in (
        rr(f"any_value(o.{c})") + f" AS {c}", rr(f"CASE WHEN {ok.format(c=c)} THEN any_value(m_{c}) END") + f" AS {c}_null_mean",
        rr(f"CASE WHEN {ok.format(c=c)} THEN (count(*) FILTER ({beyond[side].format(c=c)}) + 1) / (count(p.{c}) + 1) END") + f" AS {c}_p"))
    return f"""tt AS (SELECT clip, max(frame) + 1 AS t FROM duet GROUP BY clip), sh AS (SELECT clip, 'observed' AS nul, 0 AS k FROM tt UNION ALL {spread_sql('shift', HAND_SETS['shift'])}),
 mm AS (SELECT clip, frame, ax - avg(ax) OVER c AS a, bx - avg(bx) OVER c AS b, m00 IS NOT NULL AS mask FROM duet WINDOW c AS (PARTITION BY clip)),
 rb AS (SELECT x.clip, nul, k, x.frame, t, CASE WHEN x.mask THEN x.a END AS a, CASE WHEN x.mask THEN y.b END AS b FROM mm x JOIN tt USING (clip) JOIN sh USING (clip) JOIN mm y ON y.clip = x.clip AND y.frame = ((x.frame - k) % t + t) % t),
 wd AS (SELECT *, {', '.join(f'{move(l)} AS b{l + HAND_LAG}' for l in lags)}, count(a + b) OVER n AS wn, sum(a) OVER n AS sa, sum(b) OVER n AS sb, sum(a * a) OVER n AS saa, sum(b * b) OVER n AS sbb, sum(a * b) OVER n AS sab FROM rb
   WINDOW s AS (PARTITION BY clip, nul, k ORDER BY frame), n AS (PARTITION BY clip, nul, k ORDER BY frame ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)),
 wr AS (SELECT *, CASE WHEN frame % {HAND_STEP} = 0 AND frame + {w} <= t AND wn = {w} AND sqrt(greatest((saa - sa * sa / {w}) * (sbb - sb * sb / {w}), 0)) > 1e-12 THEN (sab - sa * sb / {w}) / sqrt((saa - sa * sa / {w}) * (sbb - sb * sb / {w})) END AS r FROM wd),
 st AS (SELECT clip, nul, k, count(a + b{HAND_LAG}) AS n, CASE WHEN count(a + b{HAND_LAG}) >= 30 THEN corr(a, b{HAND_LAG}) END AS r0, least({', '.join(f'CASE WHEN count(a + b{i}) >= 30 THEN corr(a, b{i}) END' for i in range(len(lags)))}) AS rmin,
   count(r) AS n_win, count(*) FILTER (r < -{HAND_THR}) / nullif(count(r), 0) AS frac_neg, count(*) FILTER (r > {HAND_THR}) / nullif(count(r), 0) AS frac_pos FROM wr GROUP BY ALL),
 mu AS (SELECT clip, {', '.join(f'avg({c}) AS m_{c}' for c in SIDES)} FROM st WHERE nul <> 'observed' GROUP BY clip)
 SELECT o.clip, any_value(o.n) AS n_frames, any_value(o.n_win) AS n_win, {tests} FROM st o JOIN st p ON o.clip = p.clip AND o.nul = 'observed' AND p.nul <> 'observed' JOIN mu ON mu.clip = o.clip GROUP BY o.clip"""


@query("handoff_test", sql("duet", hand_sql()))
def _(spark, sf):
    """Lag-0 r, smallest r over the lags and shares of windows with opposed or joint movement against 200 shifts of B under a fixed mask."""
    d = V.duet(spark, sf).select("clip", "frame", F.col("ax").alias("a"), F.col("bx").alias("b"), F.col("m00").isNotNull().alias("mask"))
    t = R.window_tests(d, C, HAND_SETS, HAND_LAG, HAND_WIN, HAND_STEP, HAND_THR, 30, SIDES)
    return t.select("clip", "n_frames", "n_win", *[r(c).alias(c) for c in t.columns[3:]])


ZD = """q AS (SELECT clip, """ + ", ".join(f"quantile_cont({c}, 0.5) AS m{i}, (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 1.35::DOUBLE AS s{i}" for i, c in enumerate(["ax", "ay", "bx", '"by"'])) + """ FROM duet GROUP BY clip),
 z AS (SELECT clip, frame, present_a AND present_b AS both_, """ + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN greatest(-3, least(3, ({c} - m{i}) / s{i})) END AS z{i}" for i, c in enumerate(["ax", "ay", "bx", '"by"'])) + " FROM duet JOIN q USING (clip))"


#: Frame masks of the similarity nulls, by bits: all, contact, apart; both low, not both low.  Distances in units of the table.
NEAR, FAR, LOW, MIN_FRAMES = 12.0, 40.0, 25.0, 30
SIM_MASKS, GRID_MASKS = ["all", "contact", "apart"], ["all", "apart", "floor_state", "not_floor"]
SIM_SETS, GRID_SETS = {"shift": R.Spread(200, 60)}, {"shift": R.Spread(200, 60), "local": R.Fixed(L.shift_table(200, 12, 212))}
GAP = "sqrt(power(ax - bx, 2) + power(ay - {by}, 2))"


def sim_sql(sets, masks):
    cond = {"all": "true", "contact": f"coalesce({GAP.format(by='d.by')} < {NEAR}, false)", "apart": f"coalesce({GAP.format(by='d.by')} > {FAR}, false)",
            "floor_state": f"coalesce(ay < {LOW} AND d.by < {LOW}, false)", "not_floor": f"NOT coalesce(ay < {LOW} AND d.by < {LOW}, false)"}
    shifts = [spread_sql(n, s) if isinstance(s, R.Spread) else f"SELECT clip, '{n}', k.k FROM tt, (VALUES {', '.join(f'({k})' for k in s.shifts)}) k(k)" for n, s in sets.items()]
    term = lambda i, j: f"coalesce(abs(m.z{i} - rb.z{j}), 0)"
    n = "((CASE WHEN m.z0 - rb.z2 IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN m.z1 - rb.z3 IS NOT NULL THEN 1 ELSE 0 END))"
    return ZD + f""", tt AS (SELECT clip, max(frame) + 1 AS t FROM duet GROUP BY clip), sh AS (SELECT clip, 'observed' AS nul, 0 AS k FROM tt UNION ALL {' UNION ALL '.join(shifts)}),
 mk_ AS (SELECT z.clip, z.frame, t, z0, z1, unnest([{', '.join(f"CASE WHEN {cond[m]} THEN '{m}' END" for m in masks)}]) AS frames FROM z JOIN duet d USING (clip, frame) JOIN tt USING (clip) WHERE both_ AND (z0 - z2 IS NOT NULL OR z1 - z3 IS NOT NULL)),
 sm AS (SELECT m.clip, m.frames, nul, k, CASE WHEN {n} >= 1 THEN -({term(0, 2)} + {term(1, 3)}) / {n} END AS s FROM mk_ m JOIN sh USING (clip) JOIN z rb ON rb.clip = m.clip AND rb.frame = ((m.frame - k) % t + t) % t WHERE m.frames IS NOT NULL),
 ms AS (SELECT clip, frames, nul, k, avg(s) AS s, count(*) AS n FROM sm GROUP BY ALL)"""


def posture_rows(spark, sf, masks):
    """Robust-z positions of both bodies with the masks as bits: clip, frame, a, b, mask."""
    d = V.duet(spark, sf).select("clip", "frame", "present_a", "present_b", "ax", "ay", "bx", "by")
    z = S.robust_z(d, C, ["ax", "ay", "bx", "by"])
    za, zb = [F.col("z_ax"), F.col("z_ay")], [F.col("z_bx"), F.col("z_by")]
    seen = F.col("present_a") & F.col("present_b") & G.posture_similarity(za, zb, 1).isNotNull()
    gap, low = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2)), F.coalesce((F.col("ay") < LOW) & (F.col("by") < LOW), F.lit(False))
    cond = {"all": F.lit(True), "contact": gap < NEAR, "apart": gap > FAR, "floor_state": low, "not_floor": ~low}
    bits = sum((F.when(F.coalesce(seen & cond[m], F.lit(False)), 1 << j).otherwise(0) for j, m in enumerate(masks)), F.lit(0))
    nan = lambda cs: F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in cs])
    return z.select("clip", "frame", nan(za).alias("a"), nan(zb).alias("b"), bits.alias("mask"))


def excess(rows, sets, masks):
    e = R.similarity_excess(rows, C, sets, len(masks)).where(f"n >= {MIN_FRAMES}")
    return e.withColumn("frames", F.get(F.array(*[F.lit(m) for m in masks]), F.col("mask")))


EX = f"""ex AS (SELECT o.clip, o.frames, p.nul, any_value(o.n) AS n_frames, any_value(o.s) AS s_obs, any_value(o.s) - avg(p.s) AS excess, (any_value(o.s) - avg(p.s)) / nullif(stddev_pop(p.s), 0) AS z, avg(CASE WHEN p.s >= o.s THEN 1 ELSE 0 END) AS p
 FROM ms o JOIN ms p ON o.clip = p.clip AND o.frames = p.frames AND o.nul = 'observed' AND p.nul <> 'observed' WHERE o.n >= {MIN_FRAMES} GROUP BY ALL)"""
PS = """g AS (SELECT s_suppkey AS clip, s_nationkey AS grp FROM supplier),
 m0 AS (SELECT clip, frame, z0, z1, {flags} FROM mk_ WHERE frames IS NOT NULL GROUP BY ALL),
 lw AS MATERIALIZED (SELECT m0.*, g2.clip AS other, off.range AS q, ((m0.frame - (ot.t * (2 * off.range + 1)) // 10) % ot.t + ot.t) % ot.t AS src FROM m0 JOIN g g1 ON g1.clip = m0.clip JOIN g g2 ON g2.grp <> g1.grp JOIN tt ot ON ot.clip = g2.clip, range(5) off WHERE m0.frame < ot.t),
 pv AS (SELECT m0.* EXCLUDE (z0, z1), {sim} AS s FROM lw m0 JOIN z rb ON rb.clip = m0.other AND rb.frame = m0.src),
 pw AS (SELECT clip, other, q, {masks} FROM pv GROUP BY clip, other, q),
 pp AS (SELECT clip, other, q, unnest([{names}]) AS frames, unnest([{means}]) AS s, unnest([{counts}]) AS n FROM pw),
 ps AS (SELECT pp.clip, pp.frames, count(*) AS n_pseudo, avg(pp.s) AS pseudo_mean, avg(CASE WHEN pp.s >= ex.s_obs THEN 1 ELSE 0 END) AS p_pseudo FROM pp JOIN ex USING (clip, frames) WHERE pp.n >= {least} GROUP BY ALL)"""
_N2 = "((CASE WHEN m0.z0 - rb.z2 IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN m0.z1 - rb.z3 IS NOT NULL THEN 1 ELSE 0 END))"
_S2 = f"CASE WHEN {_N2} >= 1 THEN -(coalesce(abs(m0.z0 - rb.z2), 0) + coalesce(abs(m0.z1 - rb.z3), 0)) / {_N2} END"
PS = PS.format(flags=", ".join(f"bool_or(frames = '{m}') AS f_{m}" for m in SIM_MASKS), sim=_S2, masks=", ".join(f"avg(s) FILTER (f_{m}) AS s_{m}, count(s) FILTER (f_{m}) AS n_{m}" for m in SIM_MASKS), least=MIN_FRAMES,
               names=", ".join(f"'{m}'" for m in SIM_MASKS), means=", ".join(f"s_{m}" for m in SIM_MASKS), counts=", ".join(f"n_{m}" for m in SIM_MASKS))


@query("similarity_excess", sql("duet", sim_sql(SIM_SETS, SIM_MASKS) + f", {EX}, {PS} SELECT clip, frames, n_frames, {rr('s_obs')} AS s_obs, {rr('excess')} AS excess, {rr('z', 4)} AS z, {rr('p')} AS p, coalesce(n_pseudo, 0) AS n_pseudo, {rr('s_obs - pseudo_mean')} AS excess_pseudo, {rr('p_pseudo')} AS p_pseudo FROM ex LEFT JOIN ps USING (clip, frames)"))
def _(spark, sf):
    """Similarity of partners against 200 shifts of B and against strangers' B at five offsets, over all, contact and apart frames."""
    rows = staged(posture_rows(spark, sf, SIM_MASKS), "posture")
    e = staged(excess(rows, SIM_SETS, SIM_MASKS), "excess")
    grp = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("clip"), F.col("s_nationkey").alias("grp"))
    ps = pseudo_similarity(rows, grp, e.select("clip", "mask", F.col("s_obs").alias("true")), len(SIM_MASKS), 5, MIN_FRAMES)
    return e.join(ps, ["clip", "mask"], "left").select("clip", "frames", F.col("n").alias("n_frames"), r("s_obs").alias("s_obs"), r("excess").alias("excess"), r("z", 4).alias("z"), r("p").alias("p"),
                                                       F.coalesce("n_pseudo", F.lit(0)).alias("n_pseudo"), r(F.col("s_obs") - F.col("pseudo_mean")).alias("excess_pseudo"), r("p_pseudo").alias("p_pseudo"))


@query("local_null_excess", sql("duet", sim_sql(GRID_SETS, GRID_MASKS) + f", {EX} SELECT clip, frames, nul AS \"null\", n_frames, {rr('s_obs')} AS s_obs, {rr('excess')} AS excess, {rr('z', 4)} AS z, {rr('p')} AS p FROM ex"))
def _(spark, sf):
    """Controls grid: frame masks by far and by near shifts, which keep the phase and break the moment."""
    e = excess(posture_rows(spark, sf, GRID_MASKS), GRID_SETS, GRID_MASKS)
    return e.select("clip", "frames", F.col("set").alias("null"), F.col("n").alias("n_frames"), r("s_obs").alias("s_obs"), r("excess").alias("excess"), r("z", 4).alias("z"), r("p").alias("p"))


@query("posture_similarity", sql("duet", ZD + f" SELECT clip, frame, {rr('CASE WHEN z0 - z2 IS NOT NULL AND z1 - z3 IS NOT NULL THEN -(abs(z0 - z2) + abs(z1 - z3)) / 2 END')} AS s FROM z"))
def _(spark, sf):
    z = S.robust_z(V.duet(spark, sf).select("clip", "frame", "ax", "ay", "bx", "by"), C, ["ax", "ay", "bx", "by"])
    return z.select("clip", "frame", r(G.posture_similarity([F.col("z_ax"), F.col("z_ay")], [F.col("z_bx"), F.col("z_by")], 2)).alias("s"))


FS = [0, *L.shift_table(100, 60, 480)]
FSQ = "sh(k) AS (VALUES " + ", ".join(f"({k})" for k in FS) + """), tt AS (SELECT clip, max(frame) + 1 AS t FROM duet GROUP BY clip), f AS (SELECT clip, 'x' AS feature, frame, ax AS a, bx AS b FROM duet UNION ALL SELECT clip, 'y', frame, ay, "by" FROM duet),
 pv AS (SELECT f.clip, f.feature, k, f.a, g.b FROM f JOIN tt USING (clip), sh, f g WHERE g.clip = f.clip AND g.feature = f.feature AND g.frame = ((f.frame - k) % t + t) % t AND f.a IS NOT NULL AND g.b IS NOT NULL),
 rk AS (SELECT clip, feature, k, rank() OVER (PARTITION BY clip, feature, k ORDER BY a) + (count(*) OVER (PARTITION BY clip, feature, k, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY clip, feature, k ORDER BY b) + (count(*) OVER (PARTITION BY clip, feature, k, b) - 1) / 2 AS rb FROM pv),
 c AS (SELECT clip, feature, k, corr(ra, rb) AS r FROM rk GROUP BY 1, 2, 3)"""


@query("feature_spearman", sql("duet", FSQ + f" SELECT o.clip, o.feature, {rr('any_value(o.r)')} AS r, {rr('avg(p.r)')} AS null_mean, {rr('(any_value(o.r) - avg(p.r)) / stddev_pop(p.r)', 4)} AS z FROM c o JOIN c p ON o.clip = p.clip AND o.feature = p.feature AND o.k = 0 AND p.k <> 0 GROUP BY 1, 2"))
def _(spark, sf):
    d = V.duet(spark, sf)
    f = d.select("clip", "frame", F.explode(F.array(F.struct(F.lit("x").alias("feature"), F.col("ax").alias("a"), F.col("bx").alias("b")), F.struct(F.lit("y").alias("feature"), F.col("ay").alias("a"), F.col("by").alias("b")))).alias("s")).select("clip", "frame", "s.*")
    k = ["clip", "feature"]
    c = staged(R.rolled_spearman(f, k, FS, 50), "spearman-shifts")
    o, n = c.where(F.col("shift") == 0).select(*k, F.col("r").alias("o")), c.where(F.col("shift") != 0)
    return n.join(o, k).groupBy(*k).agg(r(F.first("o")).alias("r"), r(F.avg("r")).alias("null_mean"), r((F.first("o") - F.avg("r")) / F.stddev_pop("r"), 4).alias("z"))


SOURCE_SHIFTS = L.shift_table(200, 20, 300)


@query("verify_2d_3d", sql("pair", f"""s AS (SELECT clip, frame, avg(a) OVER w AS a, avg(b) OVER w AS b FROM pair WINDOW w AS (PARTITION BY clip ORDER BY frame RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)), sh(k) AS (VALUES (0), {', '.join(f'({k})' for k in SOURCE_SHIFTS)}), tt AS (SELECT clip, max(frame) + 1 AS t FROM pair GROUP BY clip), pv AS (SELECT x.clip, k, x.a, y.b FROM s x JOIN tt USING (clip), sh, s y WHERE y.clip = x.clip AND y.frame = ((x.frame - k) % t + t) % t AND x.a IS NOT NULL AND y.b IS NOT NULL),
 rk AS (SELECT clip, k, rank() OVER (PARTITION BY clip, k ORDER BY a) + (count(*) OVER (PARTITION BY clip, k, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY clip, k ORDER BY b) + (count(*) OVER (PARTITION BY clip, k, b) - 1) / 2 AS rb FROM pv), c AS (SELECT clip, k, corr(ra, rb) AS r, count(*) AS n FROM rk GROUP BY 1, 2)
 SELECT o.clip, any_value(o.n) AS n, {rr('any_value(o.r)', 5)} AS r, {rr('avg(p.r)', 5)} AS null_mean, {rr('avg(CASE WHEN p.r >= o.r THEN 1 ELSE 0 END)')} AS p FROM c o JOIN c p ON o.clip = p.clip AND o.k = 0 AND p.k <> 0 GROUP BY 1"""))
def _(spark, sf):
    """Smoothed series of two sources against each other, Spearman with shift null."""
    w = lambda c: lambda w: F.avg(c).over(w.rangeBetween(-3, 3))
    s = over_neighbours(V.pair(spark, sf), C, {"sa": w("a"), "sb": w("b")}, 3, 3).select("clip", "frame", F.round("sa", 9).alias("a"), F.round("sb", 9).alias("b"))
    c = staged(R.rolled_spearman(s, C, [0, *SOURCE_SHIFTS], 2), "spearman-shifts")
    o, n = c.where(F.col("shift") == 0).select("clip", F.col("r").alias("o"), "n"), c.where(F.col("shift") != 0).drop("n")
    return n.join(o, "clip").groupBy("clip").agg(F.first("n").alias("n"), r(F.first("o"), 5).alias("r"), r(F.avg("r"), 5).alias("null_mean"), r(F.avg(F.when(F.col("r") >= F.col("o"), 1).otherwise(0))).alias("p"))


LAGS = range(-2, 3)
SEG_SETS = {"null": R.Spread(100, 5), "pool_far": R.Spread(20, 2)}
SEGQ = ANG + ", tt AS (SELECT clip, max(frame) + 1 AS t FROM ga GROUP BY clip), sh AS ({shifts}), dd AS (SELECT x.clip, x.frame, nul, k, {S} AS d FROM ga x JOIN tt USING (clip) JOIN sh USING (clip), (VALUES " + ", ".join(f"({l})" for l in LAGS) + """) sl(l), ga y WHERE y.clip = x.clip AND y.frame = ((x.frame - k - l) % t + t) % t), bl AS (SELECT clip, nul, k, frame, min(d) AS d FROM dd GROUP BY ALL)"""


def seg_sql(mirror, shifts="SELECT clip, 'observed' AS nul, 0 AS k FROM tt"):
    e = angd_sql([4, 5, 6, 7, 0, 1, 2, 3, 8] if mirror else list(range(9)), -1 if mirror else 1)
    return SEGQ.replace("{shifts}", shifts).replace("{S}", e.replace("ga[", "x.ga[").replace("gb[", "y.gb["))


def limb_rows(spark, sf):
    """Limb angles of both bodies for `rolls`: clip, frame, a, b, mask."""
    nan = lambda m: F.transform(G.limb_angles(F.col(m)), lambda x: F.coalesce(x, F.lit(float("nan"))))
    return pairs(spark, sf).select("clip", "frame", nan("ma").alias("a"), nan("mb").alias("b"), F.lit(1).alias("mask"))


def best_lag(spark, sf, mirror=False):
    """Smallest posture distance over +-2 rows of B (circular): clip, frame, d."""
    g = pairs(spark, sf).select("clip", "frame", G.limb_angles(F.col("ma")).alias("ga"), G.limb_angles(F.col("mb")).alias("gb"))
    b = g.join(g.groupBy("clip").agg((F.max("frame") + 1).alias("t")), "clip")
    b = b.select("clip", F.explode(F.array(*[F.pmod(F.col("frame") + l, F.col("t")).cast("int") for l in LAGS])).alias("frame"), "gb")
    d = g.select("clip", "frame", "ga").join(b, ["clip", "frame"])
    return d.groupBy("clip", "frame").agg(F.min(G.angular_distance(F.col("ga"), F.col("gb"), mirror)).alias("d"))


@query("best_lag", sql("posep", seg_sql(False) + f" SELECT clip, CAST(frame AS INT) AS frame, {rr('d')} AS d FROM bl WHERE d IS NOT NULL"))
def _(spark, sf):
    return best_lag(spark, sf).where(F.col("d").isNotNull()).select("clip", "frame", r("d").alias("d"))


def segment_sql(mode):
    shifts = "SELECT clip, 'observed' AS nul, 0 AS k FROM tt UNION ALL " + " UNION ALL ".join(spread_sql(n, s) for n, s in SEG_SETS.items())
    return f"""SELECT * FROM (WITH {seg_sql(mode == 'mirror', shifts).lstrip(', ')}, mk_ AS (SELECT clip, frame FROM bl WHERE nul = 'observed' AND d IS NOT NULL), fr AS (SELECT bl.* FROM bl JOIN mk_ USING (clip, frame)),
 ms AS (SELECT clip, nul, k, avg(d) AS d, count(*) AS n FROM fr GROUP BY ALL), q AS (SELECT clip, quantile_cont(d, 0.5) FILTER (nul = 'observed') AS md, quantile_cont(d, 0.1) FILTER (nul = 'observed') AS p10, quantile_cont(d, 0.5) FILTER (nul = 'pool_far') AS far FROM fr GROUP BY clip)
 SELECT o.clip, '{mode}' AS mode, any_value(o.n) AS n, {rr('any_value(o.d)')} AS mean_deg, {rr('avg(p.d) - any_value(o.d)')} AS excess_deg, {rr('avg(CASE WHEN p.d <= o.d THEN 1 ELSE 0 END)')} AS p, {rr('CASE WHEN any_value(far) > any_value(p10) THEN 100 * (any_value(far) - any_value(md)) / (any_value(far) - any_value(p10)) END', 4)} AS score
 FROM ms o JOIN ms p ON o.clip = p.clip AND o.nul = 'observed' AND p.nul = 'null' AND p.d IS NOT NULL JOIN q ON q.clip = o.clip GROUP BY o.clip)"""


@query("segment_excess", sql("posep", "SELECT 1")[:-len("SELECT 1")] + " " + " UNION ALL ".join(segment_sql(m) for m in ("same-side", "mirror")))
def _(spark, sf):
    """Limb-angle distance of partners, same-side and mirrored, against 100 shifts, and a score from 0 (distance at other times) to 100 (the clip's 10th percentile)."""
    rows, out = staged(limb_rows(spark, sf), "limbs"), None
    for mode in ("same-side", "mirror"):
        means, q = R.rolled_distances(rows, C, SEG_SETS, functools.partial(G.angular_distances, mirror=mode == "mirror"), (0.0, 180.0), {"md": 0.5, "p10": 0.1}, reach=2)
        o = means.where("set = 'observed'").select("clip", F.col("d").alias("o"), "n")
        null = means.where("set = 'null' AND d IS NOT NULL").select("clip", "d").join(o, "clip").groupBy("clip").agg(F.first("n").alias("n"), F.first("o").alias("o"), F.avg("d").alias("mean"), F.avg(F.when(F.col("d") <= F.col("o"), 1).otherwise(0)).alias("p"))
        mine, far = q.where("pool = 'observed'").drop("pool"), q.where("pool = 'pool_far'").select("clip", F.col("md").alias("far"))
        part = null.join(mine, "clip", "left").join(far, "clip", "left").select(
            "clip", F.lit(mode).alias("mode"), "n", r("o").alias("mean_deg"), r(F.col("mean") - F.col("o")).alias("excess_deg"), r("p").alias("p"),
            r(F.when(F.col("far") > F.col("p10"), 100 * (F.col("far") - F.col("md")) / (F.col("far") - F.col("p10"))), 4).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


@query("lead_index", sql("pair", lc_sql("pair", 6, 50) + f" SELECT clip, {rr('avg(r) FILTER (lag BETWEEN 1 AND 3) - avg(r) FILTER (lag BETWEEN -3 AND -1)')} AS lead_index FROM lc GROUP BY clip"))
def _(spark, sf):
    c = L.lagged_corr(V.pair(spark, sf), C, max_lag=6)
    return c.groupBy("clip").agg(r(F.avg(F.when(F.col("lag").between(1, 3), F.col("r"))) - F.avg(F.when(F.col("lag").between(-3, -1), F.col("r")))).alias("lead_index"))


@query("top_moments", sql("duet", ZD + """, s AS (SELECT clip, frame, -(abs(z0 - z2) + abs(z1 - z3)) / 2 AS s FROM z WHERE z0 - z2 IS NOT NULL AND z1 - z3 IS NOT NULL), k(kind, sg) AS (VALUES ('high', -1), ('low', 1)),
 f1 AS (SELECT clip, kind, sg, arg_min({'f': frame, 's': s}, {'v': round(s * sg, 9), 'f': frame}) AS b FROM s, k GROUP BY 1, 2, 3), f2 AS (SELECT f1.clip, kind, arg_min({'f': s.frame, 's': s.s}, {'v': round(s.s * sg, 9), 'f': s.frame}) AS b FROM f1 JOIN s ON s.clip = f1.clip AND abs(s.frame - f1.b.f) > 30 GROUP BY 1, 2)
 SELECT clip, kind, 1 AS ord, b.f AS frame, """ + rr("b.s") + " AS s FROM f1 UNION ALL SELECT clip, kind, 2, b.f, " + rr("b.s") + " FROM f2"))
def _(spark, sf):
    """Two best and two worst moments per clip more than 30 frames apart: greedy selection as one
    aggregate per pick."""
    z = S.robust_z(V.duet(spark, sf).select("clip", "frame", "ax", "ay", "bx", "by"), C, ["ax", "ay", "bx", "by"])
    s = z.select("clip", "frame", G.posture_similarity([F.col("z_ax"), F.col("z_ay")], [F.col("z_bx"), F.col("z_by")], 2).alias("s"))
    s = staged(s, "similarity").where(F.col("s").isNotNull())                 # read once a pick
    s = s.select("clip", "frame", "s", F.explode(F.array(F.struct(F.lit("high").alias("kind"), F.lit(-1).alias("sg")), F.struct(F.lit("low").alias("kind"), F.lit(1).alias("sg")))).alias("k")).select("clip", "frame", "s", "k.*")
    best = F.min(F.struct(F.round(F.col("s") * F.col("sg"), 9).alias("v"), "frame", "s")).alias("b")
    f1 = s.groupBy("clip", "kind").agg(best)
    f2 = s.join(f1.select("clip", "kind", F.col("b.frame").alias("f")), ["clip", "kind"]).where(F.abs(F.col("frame") - F.col("f")) > 30).groupBy("clip", "kind").agg(best)
    out = lambda d, i: d.select("clip", "kind", F.lit(i).alias("ord"), F.col("b.frame").alias("frame"), r("b.s").alias("s"))
    return out(f1, 1).unionByName(out(f2, 2))


RS = lambda src, key, val, grp, a, b: f"""d_ AS (SELECT {key}, {val} AS v, {grp} AS g FROM {src} WHERE {grp} IN ('{a}', '{b}') AND {val} IS NOT NULL), r_ AS (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY v) + (count(*) OVER (PARTITION BY {key}, v) - 1) / 2 AS rk, count(*) OVER (PARTITION BY {key}, v) AS t FROM d_),
 u_ AS (SELECT {key}, count(*) FILTER (g = '{a}') AS na, count(*) FILTER (g = '{b}') AS nb, sum(rk) FILTER (g = '{a}') - count(*) FILTER (g = '{a}') * (count(*) FILTER (g = '{a}') + 1) / 2 AS u, sum(t * t - 1)::DOUBLE AS tt, count(*) AS n FROM r_ GROUP BY {key})"""


@query("mann_whitney", "WITH " + RS("orders", "o_orderpriority", "o_totalprice", "o_orderstatus", "F", "O") + f" SELECT o_orderpriority, na AS n_a, nb AS n_b, {rr('u', 1)} AS u, {rr('(u - na::DOUBLE * nb / 2) / sqrt(na::DOUBLE * nb / 12 * (n + 1 - tt / (n::DOUBLE * (n - 1))))')} AS z FROM u_")
def _(spark, sf):
    u = I.rank_sum(V.table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderstatus", "F", "O")
    return u.select("o_orderpriority", "n_a", "n_b", r("u", 1).alias("u"), r("z").alias("z"))


@query("cliffs_delta", "WITH " + RS("lineitem", "l_linestatus", "l_extendedprice", "l_returnflag", "A", "R") + f" SELECT l_linestatus, na AS n_a, nb AS n_b, {rr('2 * u / (na::DOUBLE * nb) - 1')} AS delta FROM u_")
def _(spark, sf):
    u = I.rank_sum(V.table(spark, sf, "lineitem"), ["l_linestatus"], "l_extendedprice", "l_returnflag", "A", "R")
    return u.select("l_linestatus", "n_a", "n_b", r("delta").alias("delta"))


PVC = WIN_SQL + """, wt AS (SELECT clip, wid, avg(sa) AS ma, avg(sb) AS mb, avg(CASE WHEN d < 0.8 THEN 1.0::DOUBLE WHEN d IS NOT NULL THEN 0.0::DOUBLE END) AS c FROM wr GROUP BY clip, wid HAVING count(*) = 40), lw AS (SELECT clip, body, v, c FROM (SELECT clip, 'A' AS body, ma AS v, c FROM wt UNION ALL SELECT clip, 'B', mb, c FROM wt) WHERE v IS NOT NULL AND c IS NOT NULL)"""


def window_long(spark, sf):
    """Window metric of both bodies under each other with the contact fraction: clip, body, v, c."""
    d = WN.window_rows(frames(spark, sf).select("clip", "frame", (F.col("a_speed") / 40).alias("a"), (F.col("b_speed") / 40).alias("b"), (F.col("dist") / 40 < 0.8).cast("double").alias("c")), LEN, 10)
    g = d.groupBy("clip", "wid").agg(F.count("*").alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.avg("c").alias("c")).where(F.col("n") == LEN)
    return g.select("clip", "c", F.explode(F.array(F.struct(F.lit("A").alias("body"), F.col("ma").alias("v")), F.struct(F.lit("B").alias("body"), F.col("mb").alias("v")))).alias("s")).select("clip", "s.body", "s.v", "c").where(F.col("v").isNotNull() & F.col("c").isNotNull())


PC = PVC + """, pc AS (SELECT clip, count(*) FILTER (c >= 0.45) AS nc, count(*) FILTER (c <= 0.32) AS nf, quantile_cont(v, 0.5) FILTER (c >= 0.45) - quantile_cont(v, 0.5) FILTER (c <= 0.32) AS diff FROM lw GROUP BY clip HAVING count(*) FILTER (c >= 0.45) >= 5 AND count(*) FILTER (c <= 0.32) >= 5)"""


def contrast(spark, sf):
    """Median in contact windows minus median in free windows per clip, both bodies pooled."""
    w = window_long(spark, sf).withColumn("g", F.when(F.col("c") >= 0.45, "c").when(F.col("c") <= 0.32, "f")).where(F.col("g").isNotNull())
    w = staged(w.select("clip", "v", "g"), "windows")     # read by medians and ranks
    q = quantiles(w, ["clip", "g"], "v", {"m": 0.5})
    d = q.groupBy("clip").agg(*[F.max(F.when(F.col("g") == g, F.col(c))).alias(f"{c}_{g}") for g in "cf" for c in ("n", "m")])
    d = d.where((F.col("n_c") >= 5) & (F.col("n_f") >= 5)).withColumn("diff", F.col("m_c") - F.col("m_f"))
    return d, I.rank_sum(w, C, "v", "g", "c", "f", split=None).select("clip", "delta")


@query("per_clip_contrast", sql("duet track", PC + """, dl AS (SELECT clip, v, CASE WHEN c >= 0.45 THEN 'c' WHEN c <= 0.32 THEN 'f' END AS g FROM lw), """ + RS("dl", "clip", "v", "g", "c", "f") + f" SELECT pc.clip, nc AS n_contact, nf AS n_free, {rr('diff', 5)} AS diff, {rr('2 * u / (na::DOUBLE * nb) - 1', 5)} AS delta FROM pc JOIN u_ USING (clip)"))
def _(spark, sf):
    d, e = contrast(spark, sf)
    return d.join(e, "clip").select("clip", F.col("n_c").alias("n_contact"), F.col("n_f").alias("n_free"), r("diff", 5).alias("diff"), r("delta", 5).alias("delta"))


@query("combine_sign_wilcoxon", sql("duet track", PC + f", w AS (SELECT diff, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2 AS rk FROM pc WHERE diff <> 0) SELECT count(*) AS n, count(*) FILTER (diff > 0) AS n_pos, count(*) FILTER (diff < 0) AS n_neg, {rr('coalesce(sum(rk) FILTER (diff > 0), 0)', 1)} AS w_plus, {rr('coalesce(sum(rk) FILTER (diff < 0), 0)', 1)} AS w_minus FROM w"))
def _(spark, sf):
    d, _ = contrast(spark, sf)
    w = I.signed_rank(d.withColumn("k", F.lit(0)), ["k"], "diff")
    return w.select("n", "n_pos", "n_neg", r("w_plus", 1).alias("w_plus"), r("w_minus", 1).alias("w_minus"))


@query("fe_ols_cluster", f"""WITH d AS (SELECT l_suppkey AS g, CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x, l_extendedprice / 997.0::DOUBLE AS y FROM lineitem), m AS (SELECT *, x - avg(x) OVER (PARTITION BY g) AS xd, y - avg(y) OVER (PARTITION BY g) AS yd FROM d QUALIFY min(x) OVER (PARTITION BY g) < max(x) OVER (PARTITION BY g)), b AS (SELECT sum(xd * yd) / sum(xd * xd) AS b, sum(xd * xd) AS sxx FROM m),
 s AS (SELECT g, sum(xd * (yd - b * xd)) AS s FROM m, b GROUP BY g) SELECT (SELECT count(*) FROM m) AS n_obs, count(*) AS n_groups, {rr('(SELECT avg(y) FROM m)')} AS grand_mean, {rr('(SELECT b FROM b)')} AS beta, {rr('sqrt(sum(s * s) * count(*) / (count(*) - 1)) / (SELECT sxx FROM b)')} AS se FROM s""")
def _(spark, sf):
    li = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0).alias("x"), (F.col("l_extendedprice") / 997.0).alias("y"))
    return I.fe_ols(li, "g", "x", "y").select("n_obs", "n_groups", r("grand_mean").alias("grand_mean"), r("beta").alias("beta"), r("se").alias("se"))


@query("noise_floor_table")
def _(spark, sf):
    """Median jerk over the jerk that the estimated jitter alone would give."""
    from .ordered import K, track
    d = S.sg_derivatives(track(spark, sf), K).select(*K, "residual", dist(F.col("jx"), F.col("jy")).alias("jerk"))
    d = staged(d, "derivatives")                          # read by both medians
    j = S.jitter_sigma(d, K).select(*K, (F.col("sigma") * S.jerk_floor_factor(30.0)).alias("floor"))
    q = quantiles(d, K, "jerk", {"m": 0.5})
    return q.join(j, K).select(*K, r("m", 3).alias("median_jerk"), r("floor", 3).alias("noise_floor"), r(F.col("m") / F.col("floor"), 4).alias("ratio"))


@query("ke_transfer_summary", sql("duet", """w AS (SELECT clip, wid, corr(ax, bx) AS r, avg(CASE WHEN abs(ay - "by") < 20 THEN 1 ELSE 0 END) AS c FROM (SELECT *, unnest(range(CAST(greatest(0, ceil((frame - 19) / 5.0::DOUBLE)) AS BIGINT), CAST(floor(frame / 5) AS BIGINT) + 1)) AS wid FROM duet WHERE ax IS NOT NULL AND bx IS NOT NULL) GROUP BY 1, 2 HAVING count(*) >= 15), q AS (SELECT *, CASE WHEN c >= 0.7 THEN 'c' WHEN c <= 0.6 THEN 'f' END AS g FROM w WHERE r IS NOT NULL)
 SELECT clip, count(*) FILTER (g = 'c') AS n_contact, count(*) FILTER (g = 'f') AS n_free, """ + rr("quantile_cont(r, 0.5) FILTER (g = 'c')") + " AS median_contact, " + rr("quantile_cont(r, 0.5) FILTER (g = 'f')") + " AS median_free, " + rr("avg(CASE WHEN r < -0.2 THEN 1 ELSE 0 END) FILTER (g = 'c')") + " AS neg_contact FROM q GROUP BY clip HAVING count(*) FILTER (g = 'c') >= 5 AND count(*) FILTER (g = 'f') >= 5"))
def _(spark, sf):
    d = V.duet(spark, sf).where(F.col("ax").isNotNull() & F.col("bx").isNotNull()).select("clip", "frame", "ax", "bx", F.when(F.abs(F.col("ay") - F.col("by")) < 20, 1).otherwise(0).alias("c"))
    m = WN.window_rows(d, 20, 5).groupBy("clip", "wid").agg(*L.moments("ax", "bx"), F.avg("c").alias("c")).where(F.col("n") >= 15)
    m = m.select("clip", L.corr_of(2).alias("r"), F.when(F.col("c") >= 0.7, "c").when(F.col("c") <= 0.6, "f").alias("g")).where(F.col("r").isNotNull() & F.col("g").isNotNull())
    q = quantiles(m, ["clip", "g"], "r", {"m": 0.5}).join(m.groupBy("clip", "g").agg(F.avg(F.when(F.col("r") < -0.2, 1).otherwise(0)).alias("neg")), ["clip", "g"])
    p = lambda g, c: F.max(F.when(F.col("g") == g, F.col(c)))
    return q.groupBy("clip").agg(p("c", "n").alias("n_contact"), p("f", "n").alias("n_free"), r(p("c", "m")).alias("median_contact"), r(p("f", "m")).alias("median_free"), r(p("c", "neg")).alias("neg_contact")).where((F.col("n_contact") >= 5) & (F.col("n_free") >= 5))


@query("stouffer_by_source", sql("pair", BATQ + f", zz AS (SELECT test, s_nationkey AS g, r_obs, -({probit_sql('greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, p))')}) AS z FROM bat JOIN supplier ON s_suppkey = clip WHERE p IS NOT NULL), gg AS (SELECT test, g, sum(z) / sqrt(count(*)) AS z, count(*) AS n FROM zz GROUP BY 1, 2) SELECT test, CAST(sum(n) AS BIGINT) AS n_clips, count(*) AS n_groups, count(*) FILTER (z > 1.6448536269514722::DOUBLE) AS groups_sig, {rr('sum(z) / sqrt(count(*))', 5)} AS stouffer_z FROM gg GROUP BY test"))
def _(spark, sf):
    """z per clip from its p, combined within a source, then across sources."""
    b = battery_p(spark, sf).where(F.col("p").isNotNull())
    sup = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("clip"), F.col("s_nationkey").alias("g"))
    z = b.join(sup, "clip").select("test", "g", (-probit(F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("p"))))).alias("z"))
    g = z.groupBy("test", "g").agg((F.sum("z") / F.sqrt(F.count("*"))).alias("z"), F.count("*").alias("n"))
    return g.groupBy("test").agg(F.sum("n").alias("n_clips"), F.count("*").alias("n_groups"), F.count_if(F.col("z") > 1.6448536269514722).alias("groups_sig"), r(F.sum("z") / F.sqrt(F.count("*")), 5).alias("stouffer_z"))


SETS = [("primary", ["BUILDING"]), ("secondary", ["BUILDING", "MACHINERY"]), ("failed", ["HOUSEHOLD"]), ("all", None)]


@query("set_summaries", "WITH s(name, seg) AS (VALUES " + ", ".join(f"('{n}', '{g}')" for n, gs in SETS if gs for g in gs) + f"), m AS (SELECT name, c.* FROM s JOIN customer c ON seg = c_mktsegment UNION ALL SELECT 'all', c.* FROM customer c) SELECT name, count(*) AS n, count(DISTINCT c_nationkey) AS n_groups, {rr('avg(c_acctbal)')} AS mean, CAST(count(*) FILTER (c_acctbal < 0) AS BIGINT) AS n_neg FROM m GROUP BY name")
def _(spark, sf):
    """Overlapping subsets as an exploded membership array."""
    m = F.array_compact(F.array(*[F.when(F.col("c_mktsegment").isin(gs) if gs else F.lit(True), n) for n, gs in SETS]))
    c = V.table(spark, sf, "customer").select("c_nationkey", "c_acctbal", F.explode(m).alias("name"))
    return c.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("n_groups"), r(F.avg("c_acctbal")).alias("mean"), F.count_if(F.col("c_acctbal") < 0).alias("n_neg"))


@query("condition_contrast", f"""WITH d AS (SELECT l_suppkey AS dyad, avg(l_extendedprice) FILTER (l_returnflag = 'A' AND l_linestatus = 'O') - avg(l_extendedprice) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS d FROM lineitem GROUP BY 1), w AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS rk FROM d WHERE d IS NOT NULL) SELECT count(*) AS n, {rr('avg(d)', 4)} AS mean_diff, {rr('stddev_samp(d)', 4)} AS sd_diff, count(*) FILTER (d > 0) AS positive, {rr('sum(rk) FILTER (d > 0)', 1)} AS w_plus FROM w""")
def _(spark, sf):
    c = lambda a, b: F.avg(F.when((F.col("l_returnflag") == a) & (F.col("l_linestatus") == b), F.col("l_extendedprice")))
    d = V.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("dyad")).agg((c("A", "O") - c("N", "F")).alias("d")).where(F.col("d").isNotNull())
    d = staged(d, "differences")               # read by counts and ranks, which meet by value: sums made twice differ in their last digits
    size = d.groupBy(F.abs("d").alias("size")).agg(F.count_if(F.col("d") > 0).alias("p"))              # zeros take ranks too
    rk = average_ranks(d.select(F.lit(0).alias("k"), F.abs("d").alias("size")), ["k"], "size", "rank")
    w = size.join(rk, "size").agg(r(F.sum(F.when(F.col("p") > 0, F.col("p") * F.col("rank"))), 1).alias("w_plus"))
    a = d.agg(F.count("*").alias("n"), r(F.avg("d"), 4).alias("mean_diff"), r(F.stddev_samp("d"), 4).alias("sd_diff"), F.count_if(F.col("d") > 0).alias("positive"))
    return a.crossJoin(w)                                                                              # one row each


@query("false_positive_rate", sql("pair", BATQ + f" SELECT test, count(*) AS n, {rr('avg(CASE WHEN p < 0.1 THEN 1 ELSE 0 END)')} AS rate FROM bat WHERE p IS NOT NULL GROUP BY test"))
def _(spark, sf):
    return battery_p(spark, sf).where(F.col("p").isNotNull()).groupBy("test").agg(F.count("*").alias("n"), r(F.avg(F.when(F.col("p") < 0.1, 1).otherwise(0))).alias("rate"))


@query("fisher_2x2", sql("rat", f"t AS (SELECT count(*) FILTER (r1 = 1 AND r2 = 1) AS a, count(*) FILTER (r1 = 1 AND r2 = 0) AS b, count(*) FILTER (r1 = 0 AND r2 = 1) AS c, count(*) FILTER (r1 = 0 AND r2 = 0) AS d FROM rat), i AS (SELECT *, unnest(range(a, least(a + b, a + c) + 1)) AS i FROM t), lc AS (SELECT a, b, c, d, exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) + lgamma(c + d + 1) - lgamma(a + c - i + 1) - lgamma(c + d - a - c + i + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) AS p FROM i) SELECT a, b, c, d, {rr('least(1, sum(p))')} AS p_greater FROM lc GROUP BY ALL"))
def _(spark, sf):
    n = lambda x, y: F.count_if((F.col("r1") == x) & (F.col("r2") == y))
    t = V.raters(spark, sf).agg(n(1, 1).alias("a"), n(1, 0).alias("b"), n(0, 1).alias("c"), n(0, 0).alias("d"))
    return t.select("a", "b", "c", "d", r(I.fisher_greater("a", "b", "c", "d")).alias("p_greater"))


@query("binomial_role", sql("rol", f"c AS (SELECT clip, count(*) AS n, count(*) FILTER (symbol = 'user') AS k FROM rol GROUP BY clip), i AS (SELECT *, unnest(range(0, least(k, n - k) + 1)) AS i FROM c), s AS (SELECT clip, n, k, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) AS t FROM i GROUP BY ALL) SELECT clip, n, k, {rr('k / n')} AS share, {rr('CASE WHEN 2 * least(k, n - k) = n THEN 1 ELSE least(1, 2 * t) END')} AS p FROM s"))
def _(spark, sf):
    c = V.roles(spark, sf).groupBy("clip").agg(F.count("*").alias("n"), F.count_if(F.col("symbol") == "user").alias("k"))
    return c.select("clip", "n", "k", r(F.col("k") / F.col("n")).alias("share"), r(I.binomial_two_sided("k", "n")).alias("p"))


@query("alternation_test", sql("rol", f"""q AS (SELECT clip, symbol = 'user' AS u, lag(symbol = 'user') OVER (PARTITION BY clip ORDER BY pos) AS p FROM rol), c AS (SELECT clip, count(*) AS n, count(*) FILTER (u) AS k, count(*) FILTER (u <> p) AS sw FROM q GROUP BY clip), v AS (SELECT *, n - k AS m FROM c WHERE n >= 3 AND k > 0 AND k < n), r_ AS (SELECT *, unnest(range(2, 2 * least(k, m) + 2)) AS r FROM v), ch AS (SELECT *, r // 2 AS i FROM r_),
 pr AS (SELECT *, CASE WHEN r % 2 = 0 THEN 2 * exp(lgamma(k) - lgamma(i) - lgamma(k - i + 1) + lgamma(m) - lgamma(i) - lgamma(m - i + 1)) ELSE CASE WHEN i <= k - 1 THEN exp(lgamma(k) - lgamma(i + 1) - lgamma(k - i) + lgamma(m) - lgamma(i) - lgamma(m - i + 1)) ELSE 0 END + CASE WHEN i <= m - 1 THEN exp(lgamma(k) - lgamma(i) - lgamma(k - i + 1) + lgamma(m) - lgamma(i + 1) - lgamma(m - i)) ELSE 0 END END / exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(m + 1)) AS p FROM ch)
 SELECT c.clip, c.n, c.k, c.sw, {rr('2.0::DOUBLE * c.k * (c.n - c.k) / c.n')} AS expected, {rr('least(1, sum(p) FILTER (r - 1 >= c.sw))', 5)} AS p_more, {rr('least(1, sum(p) FILTER (r - 1 <= c.sw))', 5)} AS p_less FROM c LEFT JOIN pr ON pr.clip = c.clip GROUP BY 1, 2, 3, 4""".replace("least(1, sum(p) FILTER", "(sum(p) FILTER").replace("c.sw))", "c.sw))")))
def _(spark, sf):
    """Role switches against the exact distribution over all orderings (runs of two kinds)."""
    from pairlane.operators.sequences import previous
    d = previous(V.roles(spark, sf).withColumn("u", F.col("symbol") == "user"), C, "pos", {"p": "u"})
    c = d.groupBy("clip").agg(F.count("*").alias("n"), F.count_if("u").alias("k"), F.count_if(F.col("u") != F.col("p")).alias("sw"))
    c = c.withColumn("t", I.alternation_p("n", "k", "sw"))
    return c.select("clip", "n", "k", "sw", r(2.0 * F.col("k") * (F.col("n") - F.col("k")) / F.col("n")).alias("expected"), r("t.more", 5).alias("p_more"), r("t.less", 5).alias("p_less"))


@query("concentration_test", sql("rol", f"c AS (SELECT clip, count(*) AS n, count(*) FILTER (symbol = 'user') AS k FROM rol GROUP BY clip), j AS (SELECT *, unnest(range(0, n + 1)) AS j FROM c), m AS (SELECT clip, n, k, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) - n * ln(2)) * greatest(j, n - j)) AS e, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) - n * ln(2)) * power(greatest(j, n - j), 2)) AS e2 FROM j GROUP BY ALL) SELECT CAST(sum(greatest(k, n - k)) AS BIGINT) AS obs, {rr('sum(e)', 5)} AS expected, {rr('sqrt(sum(e2 - e * e))', 5)} AS sd FROM m"))
def _(spark, sf):
    """Sum of the larger role count per clip against fair coins: mean and variance add up over clips."""
    c = V.roles(spark, sf).groupBy("clip").agg(F.count("*").alias("n"), F.count_if(F.col("symbol") == "user").alias("k"))
    # lengths repeat, so the binomial tables are made once per length
    t = c.groupBy("n").agg(F.count("*").alias("m"), F.sum(F.greatest("k", F.col("n") - F.col("k"))).alias("o")).withColumn("s", I.max_side_moments("n"))
    return t.agg(F.sum("o").alias("obs"), r(F.sum(F.col("m") * F.col("s.e")), 5).alias("expected"), r(F.sqrt(F.sum(F.col("m") * F.col("s.v"))), 5).alias("sd"))


@query("verdict_union", "SELECT 'rel_' || lpad(doc_id::VARCHAR, 6, '0') AS key, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS verdict FROM labels UNION ALL SELECT 'ws_' || lpad(doc_id::VARCHAR, 6, '0'), CASE WHEN toxic = 1 THEN 'yes' ELSE 'unclear' END FROM labels UNION ALL SELECT 'ev_' || lpad(event_id::VARCHAR, 9, '0'), event_type FROM events")
def _(spark, sf):
    T = lambda n: V.table(spark, sf, n)
    key = lambda p, c, w: F.concat(F.lit(p), F.lpad(F.col(c).cast("string"), w, "0")).alias("key")
    a = T("labels").select(key("rel_", "doc_id", 6), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("verdict"))
    b = T("labels").select(key("ws_", "doc_id", 6), F.when(F.col("toxic") == 1, "yes").otherwise("unclear").alias("verdict"))
    return a.unionByName(b).unionByName(T("events").select(key("ev_", "event_id", 9), F.col("event_type").alias("verdict")))


@query("kappa_agreement", sql("rat", f"t AS (SELECT count(*) AS n, avg(CASE WHEN r1 = r2 THEN 1 ELSE 0 END) AS po, avg(r1) * avg(r2) + (1 - avg(r1)) * (1 - avg(r2)) AS pe FROM rat) SELECT n, {rr('po')} AS agreement, {rr('(po - pe) / (1 - pe)')} AS kappa FROM t"))
def _(spark, sf):
    """Agreement and Cohen's kappa from one confusion count, any number of categories."""
    c = V.raters(spark, sf).groupBy("r1", "r2").agg(F.count("*").alias("c"))
    a, b = c.groupBy(F.col("r1").alias("v")).agg(F.sum("c").alias("x")), c.groupBy(F.col("r2").alias("v")).agg(F.sum("c").alias("y"))
    pe = a.join(b, "v").groupBy(F.lit(0).alias("k")).agg(F.sum(F.col("x") * F.col("y")).alias("e"))
    t = c.groupBy(F.lit(0).alias("k")).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("r1") == F.col("r2"), F.col("c")).otherwise(0)).alias("o")).join(pe, "k")
    po, e = F.col("o") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return t.select("n", r(po).alias("agreement"), r((po - e) / F.nullif(1 - e, F.lit(0.0))).alias("kappa"))


@query("detector_precision", sql("rat", f"SELECT r1 AS decision, count(*) AS n, count(*) FILTER (r2 = 1) AS yes, {rr('avg(CASE WHEN r2 = 1 THEN 1 ELSE 0 END)')} AS precision FROM rat GROUP BY r1"))
def _(spark, sf):
    return V.raters(spark, sf).groupBy(F.col("r1").alias("decision")).agg(F.count("*").alias("n"), F.count_if(F.col("r2") == 1).alias("yes"), r(F.avg(F.when(F.col("r2") == 1, 1).otherwise(0))).alias("precision"))


@query("model_score", f"WITH v AS (SELECT p_brand AS model, p_size % 3 AS verdict, CASE WHEN p_retailprice > 1000 THEN 'hard' ELSE 'ordinary' END AS kind, p_retailprice / 2000.0::DOUBLE AS conf, p_size / 10.0::DOUBLE AS sec FROM part) SELECT model, count(*) FILTER (kind = 'hard' AND verdict = 2) AS hard_ok, count(*) FILTER (kind = 'hard') AS hard_n, count(*) FILTER (kind = 'ordinary' AND verdict = 2) AS ordinary_ok, count(*) FILTER (kind = 'ordinary') AS ordinary_n, {rr('avg(conf)')} AS conf, {rr('min(sec)')} AS s_frame, {rr('min(sec) * 20.7 * 60 * 15 / 3600', 1)} AS hours FROM v GROUP BY model")
def _(spark, sf):
    """Success counts per difficulty, confidence and extrapolated hours per model."""
    p = V.table(spark, sf, "part")
    hard, ok, sec = F.col("p_retailprice") > 1000, F.col("p_size") % 3 == 2, F.col("p_size") / 10.0
    return p.groupBy(F.col("p_brand").alias("model")).agg(F.count_if(hard & ok).alias("hard_ok"), F.count_if(hard).alias("hard_n"), F.count_if(~hard & ok).alias("ordinary_ok"), F.count_if(~hard).alias("ordinary_n"),
                                                           r(F.avg(F.col("p_retailprice") / 2000.0)).alias("conf"), r(F.min(sec)).alias("s_frame"), r(F.min(sec) * 20.7 * 60 * 15 / 3600, 1).alias("hours"))


@query("speed_assignment", sql("duet", f"""c AS (SELECT clip, corr(ax, ay) + corr(bx, "by") AS straight, corr(ax, "by") + corr(bx, ay) AS crossed FROM duet WHERE ax IS NOT NULL AND bx IS NOT NULL GROUP BY clip) SELECT clip, CASE WHEN straight >= crossed THEN 'straight' ELSE 'crossed' END AS assignment, {rr('greatest(straight, crossed) / 2')} AS r FROM c"""))
def _(spark, sf):
    """The better of the two pairings by summed correlation."""
    d = V.duet(spark, sf).where(F.col("ax").isNotNull() & F.col("bx").isNotNull())
    pr = [("ax", "ay", "straight"), ("bx", "by", "straight"), ("ax", "by", "crossed"), ("bx", "ay", "crossed")]
    d = d.select("clip", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m"), F.col(a).alias("a"), F.col(b).alias("b")) for i, (a, b, m) in enumerate(pr)])).alias("s")).select("clip", "s.*")
    c = d.groupBy("clip", "m", "i").agg(*L.moments()).select("clip", "m", L.corr_of().alias("r")).groupBy("clip", "m").agg(F.sum("r").alias("r"))
    best = c.groupBy("clip").agg(F.max(F.struct("r", "m")).alias("b"))                      # 'straight' > 'crossed' breaks ties
    return best.select("clip", F.col("b.m").alias("assignment"), r(F.col("b.r") / 2).alias("r"))


@query("camera_fit_oracle")
def _(spark, sf):
    """Which image track is which 3-D body, per frame, by alternating camera fit and assignment."""
    from .joins import marker_pairs
    m = marker_pairs(spark, sf)
    pick = lambda c, i: F.struct(F.get(c, F.lit(i))["x"].alias("x"), F.get(c, F.lit(i))["y"].alias("y"), F.get(c, F.lit(i))["z"].alias("z"))
    img = lambda c, i, j: F.struct((F.get(c, F.lit(i))["x"] + 0.1 * F.get(c, F.lit(j))["z"]).alias("x"), (F.get(c, F.lit(i))["y"] - 0.1 * F.get(c, F.lit(j))["x"]).alias("y"))
    d = m.select("clip", "frame", pick("a", 13).alias("l"), pick("b", 13).alias("f"), img("a", 13, 13).alias("p"), img("b", 13, 13).alias("q"))
    return I.fit_camera_rounds(d).select("clip", "frame", "lead", r("res", 4).alias("res"), r("res_other", 4).alias("res_other"), "converged")
