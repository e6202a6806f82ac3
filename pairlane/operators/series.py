"""Series operators built from steps and running state."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .ordered import average_ranks, island_start, over_neighbours, quantiles, running
from .steps import Step, apply_steps, dist, fill_small_gaps, remove_teleports, savgol, sg_matrix

RAYLEIGH_MEDIAN = 1.1774            # median of a unit Rayleigh variable, as the reference rounds it


def valid_runs(df, keys, flag: Column, order="frame", size=None):
    from .ordered import islands
    return islands(df, keys, flag, 0, 1, order, size)


def sg_derivatives(df, keys, fps=30.0, window=11, poly=3, max_fill=2, size=None) -> DataFrame:
    """Gap fill, smoothed x/y, velocity, acceleration and jerk, residual, in one shuffle."""
    out = apply_steps(df, keys, *sg_chain(fps, window, poly, max_fill), size=size)
    return out


def sg_chain(fps, window=11, poly=3, max_fill=2, x="x", y="y", p=""):
    """Fill, filter and name the columns of one body: {p}x_s, {p}vx, {p}axx, {p}jx, ..., {p}residual."""
    fx, fy = f"{p}xf", f"{p}yf"
    c = lambda n: F.col(p + n)
    names = {"x_s": f"{fx}_d0", "y_s": f"{fy}_d0", "vx": f"{fx}_d1", "vy": f"{fy}_d1", "axx": f"{fx}_d2", "ayy": f"{fy}_d2", "jx": f"{fx}_d3", "jy": f"{fy}_d3"}
    rename = Step([{p + n: (lambda s: lambda w: F.col(s))(s) for n, s in names.items()}], 0, 0)
    post = Step([{p + "residual": lambda w: dist(F.col(fx) - c("x_s"), F.col(fy) - c("y_s")), p + "filled": lambda w: c("fx") | c("fy")},
                 {p + "valid_deriv": lambda w: c("vx").isNotNull() & c("jx").isNotNull()}], 0, 0)
    return [fill_small_gaps(x, max_fill, fx, p + "fx"), fill_small_gaps(y, max_fill, fy, p + "fy"), savgol([fx, fy], fps, window, poly), rename, post]


def jerk_floor_factor(fps: float, window: int = 11, poly: int = 3) -> float:
    """Mean jerk magnitude that unit position noise produces through the derivative filter."""
    return float(np.linalg.norm(sg_matrix(window, poly, 3, 1.0 / fps)[window // 2]) * math.sqrt(math.pi / 2))


def jitter_sigma(df, keys, col="residual", min_n=50) -> DataFrame:
    q = quantiles(df, keys, col, {"med": 0.5})
    return q.select(*keys, "n", F.when(F.col("n") >= min_n, F.col("med") / RAYLEIGH_MEDIAN).alias("sigma"))


def body_kinematics(df, keys, fps=30.0, scale: Column | float = 1.0, max_jump=1.0, max_speed=15.0, max_fill=2, size=None) -> DataFrame:
    """Teleport removal, derivatives, magnitudes; implausible speeds become NULL."""
    return apply_steps(df, keys, *kinematics_chain(fps, scale, max_jump, max_speed, max_fill), size=size)


def kinematics_chain(fps, scale: Column | float = 1.0, max_jump=1.0, max_speed=15.0, max_fill=2, x="x", y="y", p="") -> list[Step]:
    """Steps of `body_kinematics` for the columns x, y; chains of several bodies can share one shuffle."""
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    c = lambda n: F.col(p + n)
    mag = Step([{p + "speed": lambda w: dist(c("vx"), c("vy")), p + "accel": lambda w: dist(c("axx"), c("ayy")), p + "jerk": lambda w: dist(c("jx"), c("jy"))},
                {p + "implausible": lambda w: F.coalesce(c("speed") > s * max_speed, F.lit(False))},
                {p + n: (lambda n: lambda w: F.when(~c("implausible"), c(n)))(n) for n in ("speed", "accel", "jerk", "vx", "vy")},
                {p + "kinetic_energy": lambda w: c("speed") * c("speed"), p + "valid_deriv": lambda w: c("valid_deriv") & ~c("implausible")}], 0, 0)
    return [remove_teleports(x, y, s * max_jump, p + "teleport"), *sg_chain(fps, max_fill=max_fill, x=x, y=y, p=p), mag]


def compensate_camera(df, keys, size=None) -> DataFrame:
    """Trajectory in a virtual static frame.  Input x, y and the step transform m00..m12 that maps the
    previous frame's coordinates to this frame's.  Output qx, qy (NULL where blocked) and zoom."""
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    bad_m = F.col("m00").isNull()
    d = over_neighbours(df, keys, {
        "_px": lambda w: F.lag("x").over(w), "_py": lambda w: F.lag("y").over(w),
        "_prev_ok": lambda w: F.coalesce(F.lag(ok).over(w), F.lit(False)),
        "_prev_bad": lambda w: F.coalesce(F.lag(ok & bad_m).over(w), F.lit(False))}, back=1, size=size)
    d = d.withColumn("_ok", ok).withColumn("_bad", ok & bad_m).withColumn("_run0", ok & ~F.col("_prev_ok"))
    # a stretch of missing transforms alternates blocked / re-seeded, starting seeded if it opens the run
    d = running(d, keys, {"_st": ("max", F.when(F.col("_bad") & ~(F.col("_prev_bad") & F.col("_prev_ok")), F.col("frame"))),
                          "_rs": ("max", F.when(F.col("_run0"), F.col("frame")))}, size=size)
    odd = (F.col("frame") - F.col("_st")) % 2 == 1
    d = d.withColumn("_blocked", F.coalesce(F.col("_bad") & F.when(F.col("_st") == F.col("_rs"), odd).otherwise(~odd), F.lit(False)))
    d = over_neighbours(d, keys, {"_after": lambda w: F.coalesce(F.lag("_blocked").over(w), F.lit(False))}, back=1, size=size)
    seed = F.col("_ok") & ~F.col("_blocked") & (F.col("_run0") | F.col("_after"))
    step = F.col("_ok") & ~F.col("_blocked") & ~seed
    sx = F.when(step, F.col("x") - (F.col("m00") * F.col("_px") + F.col("m01") * F.col("_py") + F.col("m02"))).otherwise(0.0)
    sy = F.when(step, F.col("y") - (F.col("m10") * F.col("_px") + F.col("m11") * F.col("_py") + F.col("m12"))).otherwise(0.0)
    d = d.withColumn("_seed", seed).withColumn("_step", step).withColumn("_sx", sx).withColumn("_sy", sy)
    d = running(d, keys, {"_cx": ("sum", F.col("_sx")), "_cy": ("sum", F.col("_sy"))}, size=size)
    d = running(d, keys, {"_ox": ("last", F.when(F.col("_seed"), F.col("x") - F.col("_cx"))),
                          "_oy": ("last", F.when(F.col("_seed"), F.col("y") - F.col("_cy")))}, size=size)
    live = F.col("_seed") | F.col("_step")
    zoom = F.when(F.col("_step"), F.sqrt(F.abs(F.col("m00") * F.col("m11") - F.col("m01") * F.col("m10"))))
    out = d.withColumns({"qx": F.when(live, F.col("_cx") + F.col("_ox")), "qy": F.when(live, F.col("_cy") + F.col("_oy")), "zoom": zoom})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def hysteresis(df, keys, enter: Column, leave: Column, out="on", size=None) -> DataFrame:
    """Switch on at `enter`, off at `leave`, hold otherwise; starts off.  Enter wins only while off,
    so the conditions must exclude each other (enter threshold below leave threshold)."""
    d = running(df, keys, {"_sw": ("last", F.when(leave, F.lit(False)).when(enter, F.lit(True)))}, size=size)
    return d.withColumn(out, F.coalesce(F.col("_sw"), F.lit(False))).drop("_sw")


def merge_releases(df, keys, on: str, value: Column, max_value: float, size=None) -> DataFrame:
    """Fill the gaps between two contacts during which `value` (NULL counts 0) never exceeds `max_value`."""
    off = island_start(df, keys, ~F.col(on), 0, "frame", "gap0", size)
    bounds = df.groupBy(*keys).agg(F.min(F.when(F.col(on), F.col("frame"))).alias("_f"), F.max(F.when(F.col(on), F.col("frame"))).alias("_l"))
    gaps = (off.groupBy(*keys, "gap0").agg(F.max(F.coalesce(value, F.lit(0.0))).alias("_mx"))
            .join(bounds, keys).where((F.col("_mx") <= max_value) & (F.col("gap0") > F.col("_f")) & (F.col("gap0") < F.col("_l")))
            .select(*keys, "gap0", F.lit(True).alias("_fill")))
    filled = off.join(gaps, [*keys, "gap0"], "left").withColumn(on, F.coalesce(F.col("_fill"), F.lit(False))).select(*df.columns)
    return df.where(F.col(on)).unionByName(filled)


def interp_inside(df, keys, col, n, out, size=None) -> DataFrame:
    """Linear interpolation between two present values, filling only the first `n` rows of a gap."""
    seen = F.when(F.col(col).isNotNull(), F.struct(F.col("frame").alias("f"), F.col(col).alias("v")))
    d = running(df, keys, {"_nx": ("last", seen)}, size=size, reverse=True)
    d = over_neighbours(d, keys, {"_pv": lambda w: F.last(seen, ignorenulls=True).over(w.rowsBetween(-n, -1))}, back=n, size=size)
    line = F.col("_pv.v") + (F.col("_nx.v") - F.col("_pv.v")) * ((F.col("frame") - F.col("_pv.f")) / (F.col("_nx.f") - F.col("_pv.f")))
    return d.withColumn(out, F.coalesce(F.col(col), line)).drop("_nx", "_pv")


def interp_all_derivative(df, keys, col, fps, out, window=11, poly=3, min_valid=20, size=None) -> DataFrame:
    """Fill every gap linearly (ends held), first derivative on the whole series with fitted edges,
    then NULL where the input was missing; series with too few values give NULL."""
    seen = F.when(F.col(col).isNotNull(), F.struct(F.col("frame").alias("f"), F.col(col).alias("v")))
    d = running(df, keys, {"_pv": ("last", seen)}, size=size)
    d = running(d, keys, {"_nx": ("last", seen)}, size=size, reverse=True)
    span = F.col("_nx.f") - F.col("_pv.f")
    line = F.col("_pv.v") + (F.col("_nx.v") - F.col("_pv.v")) * ((F.col("frame") - F.col("_pv.f")) / F.nullif(span, F.lit(0)))
    d = d.withColumn("_z", F.coalesce(F.col(col), line, F.col("_pv.v"), F.col("_nx.v")))
    m = sg_matrix(window, poly, 1, 1.0 / fps)
    h, reach = window // 2, window - 1
    def stage(w):
        nb, na = F.count("*").over(w.rowsBetween(-h, -1)), F.count("*").over(w.rowsBetween(1, h))
        at = lambda o: F.col("_z") if o == 0 else F.lag("_z", -o).over(w) if o < 0 else F.lead("_z", o).over(w)
        dot = lambda i: sum((at(j - i) * float(v) for j, v in enumerate(m[i])), F.lit(0.0))
        e = F.when((nb >= h) & (na >= h), dot(h))
        for i in range(h):
            e = e.when(nb == i, dot(i)).when(na == i, dot(window - 1 - i))
        return e
    d = over_neighbours(d, keys, {"_dv": stage}, reach, reach, size=size)
    n = d.groupBy(*keys).agg(F.count(col).alias("_n"))
    return d.join(n, keys).withColumn(out, F.when((F.col("_n") > min_valid) & F.col(col).isNotNull(), F.col("_dv"))).drop("_pv", "_nx", "_z", "_dv", "_n")


def normal_scores(df, keys, col, out, min_n=10) -> DataFrame:
    """Rank-based inverse normal transform of present values."""
    from pairlane.functions.mathx import probit
    r = average_ranks(df, keys, col, "_rank").select(*keys, col, "_rank", "n")
    return df.join(r, [*keys, col], "left").withColumn(out, F.when(F.col("n") > min_n, probit((F.col("_rank") - 0.5) / F.col("n")))).drop("_rank", "n")


def robust_z(df, keys, cols, clip=3.0) -> DataFrame:
    """(x - median) / (IQR / 1.35), clipped; NULL where the IQR is 0."""
    lng = df.select(*keys, F.explode(F.create_map(*[v for c in cols for v in (F.lit(c), F.col(c))])).alias("_m", "_v"))
    q = quantiles(lng, [*keys, "_m"], "_v", {"q1": 0.25, "med": 0.5, "q3": 0.75})
    st = q.groupBy(*keys).agg(*[F.max(F.when(F.col("_m") == c, F.struct("q1", "med", "q3"))).alias(f"_q_{c}") for c in cols])
    z = lambda c: F.greatest(F.lit(-clip), F.least(F.lit(clip), (F.col(c) - F.col(f"_q_{c}.med"))
                             / F.nullif((F.col(f"_q_{c}.q3") - F.col(f"_q_{c}.q1")) / 1.35, F.lit(0.0))))
    return df.join(st, keys, "left").withColumns({f"z_{c}": F.when(F.col(c).isNotNull() & (F.col(f"_q_{c}.q3") > F.col(f"_q_{c}.q1")), z(c)) for c in cols}
                                                ).drop(*[f"_q_{c}" for c in cols])


def partial_out(df, keys, y, covariates, out) -> DataFrame:
    """Least-squares residual of y on an intercept and the covariates, on rows where all are present.
    The cross-products are one aggregate per key; the small solve runs on that single row."""
    xs, p = ["_one", *covariates], len(covariates) + 1
    d = df.withColumn("_one", F.lit(1.0))
    full = F.lit(True)
    for c in [y, *covariates]:
        full = full & F.col(c).isNotNull()
    # centre on the mean first so that the normal equations stay well conditioned
    mean = d.where(full).groupBy(*keys).agg(F.count("*").alias("_n"), *[F.avg(c).alias(f"_mu_{c}") for c in [y, *covariates]])
    c0 = d.where(full).join(mean, keys)
    cen = lambda c: F.lit(1.0) if c == "_one" else F.col(c) - F.col(f"_mu_{c}")
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    mom = c0.groupBy(*keys).agg(F.first("_n").alias("_n"),
                                F.array(*[F.sum(cen(xs[i]) * cen(xs[j])) for i, j in pairs]).alias("_xx"),
                                F.array(*[F.sum(cen(xs[i]) * cen(y)) for i in range(p)]).alias("_xy"))

    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, xx: pd.Series, xy: pd.Series) -> pd.Series:
        res = []
        for k, a, b in zip(n, xx, xy):
            if k <= p + 10:
                res.append(None)
                continue
            m = np.zeros((p, p))
            for (i, j), v in zip(pairs, a):
                m[i, j] = m[j, i] = v
            res.append(np.linalg.lstsq(m, np.asarray(b, float), rcond=None)[0].tolist())
        return pd.Series(res)

    beta = mom.select(*keys, solve("_n", "_xx", "_xy").alias("_b")).join(mean, keys)
    fit = sum((F.col("_b")[i] * cen(xs[i]) for i in range(p)), F.lit(0.0))
    return (d.join(beta, keys, "left").withColumn(out, F.when(full & F.col("_b").isNotNull(), cen(y) - fit))
            .drop("_one", "_n", "_b", *[f"_mu_{c}" for c in [y, *covariates]]))


def resample_nearest(df, keys, fps, target_fps, cols) -> DataFrame:
    """Values at the nearest source row on a regular grid; missing values stay missing.  Each source
    row emits the grid points that round (half to even) to it, so no join is needed."""
    n = df.groupBy(*keys).agg((F.max("frame") + 1).alias("_n"))
    d = df.join(n, keys)
    f, ratio = F.col("frame"), target_fps / fps
    lo, hi = F.floor((f - 0.5) * ratio) , F.ceil((f + 0.5) * ratio) + 1
    g = d.select(*keys, "frame", "_n", *cols, F.explode(F.sequence(F.greatest(lo, F.lit(0)), F.when(f == F.col("_n") - 1, F.greatest(hi, F.ceil(F.col("_n") * ratio)))
                                                                   .otherwise(hi))).alias("g"))
    src = F.least(F.rint(F.col("g") / target_fps * fps), (F.col("_n") - 1).cast("double"))
    return g.where((src == F.col("frame")) & (F.col("g") < F.ceil(F.col("_n") / fps * target_fps))).select(
        *keys, F.col("g").cast("int").alias("grid"), "frame", *cols)
