"""Gap-aware lagged correlation and its shift nulls."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from pairlane.functions.mathx import guarded_corr

from pairlane.sources.scratch import staged

from .ordered import CHUNK, _whole, halo
from .whole import dense, field, per_series, plain, whole_series


def lag_pairs(df: DataFrame, keys: list[str], a: str, b: str, max_lag: int, size=None) -> DataFrame:
    """Every pair A(t), B(t+lag), |lag| <= max_lag, both present: keys, frame, lag, a, b.  Missing frames
    are simply missing; one shuffle."""
    whole = _whole(size)
    d = df if whole else halo(df, max_lag, max_lag, "frame", size or CHUNK)
    w = W.partitionBy(*keys, *([] if whole else ["_c"])).orderBy("frame").rangeBetween(-max_lag, max_lag)
    near = F.collect_list(F.when(F.col(b).isNotNull(), F.struct(F.col("frame").alias("f"), F.col(b).alias("b")))).over(w)
    d = d.withColumn("_near", near).where(F.col(a).isNotNull() if whole else F.col("_core") & F.col(a).isNotNull())
    return d.select(*keys, "frame", F.col(a).alias("a"), F.explode("_near").alias("_p")).select(
        *keys, "frame", (F.col("_p.f") - F.col("frame")).alias("lag"), "a", F.col("_p.b").alias("b"))


MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def moments(x="a", y="b"):
    x, y = F.col(x), F.col(y)
    return [F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy")]


def corr_of(min_n=2, eps=1e-12) -> Column:
    return guarded_corr(*[F.col(c) for c in MOMENTS], min_n=min_n, eps=eps)


def lagged_corr(df, keys, a="a", b="b", max_lag=6, min_pairs=50, size=None) -> DataFrame:
    """Pearson r per lag on that lag's own valid pairs; positive lag = A leads."""
    g = lag_pairs(df, keys, a, b, max_lag, size).groupBy(*keys, "lag").agg(*moments())
    return g.select(*keys, "lag", "n", corr_of(min_pairs).alias("r"))


def peak(lc: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """Lag of the largest |r| (first on ties), that r, and r at lag 0."""
    best = F.min(F.when(F.col("r").isNotNull(), F.struct((-F.abs("r")).alias("m"), F.col("lag"), F.col("r")))).alias("_b")
    return lc.groupBy(*keys).agg(best, F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("r_lag0")).select(
        *keys, (F.col("_b.lag") / fps).alias("peak_lag_s"), F.col("_b.r").alias("peak_r"), "r_lag0")


def shift_table(n: int, lo: int, hi: int) -> list[int]:
    """n circular shifts spread evenly over [lo, hi), alternating sign; all distinct, so fewer where the range holds fewer."""
    n = min(n, 2 * (hi - lo))
    return list(dict.fromkeys((-1) ** i * (lo + int((hi - lo) * (i + 0.5) / n)) for i in range(n)))


def rolled(df: DataFrame, keys, shifts: Column, keep=("a", "mask")) -> DataFrame:
    """Series copies with B rolled by each shift on the full timeline: keys, shift, frame, a, b, mask.
    `shifts` is an array column; shift 0 is the observed series."""
    t = df.groupBy(*keys).agg((F.max("frame") + 1).alias("_t"))
    d = df.join(t, keys).withColumn("shift", F.explode(shifts))
    b = d.select(*keys, "shift", F.pmod(F.col("frame") + F.col("shift"), F.col("_t")).cast("int").alias("frame"), "b").where(F.col("b").isNotNull())
    return d.select(*keys, "shift", "frame", *keep).join(b, [*keys, "shift", "frame"], "left")


def shift_null_join(df: DataFrame, keys, fps, max_lag, shifts: list[int], min_pairs=50, size=None) -> DataFrame:
    """Peak |r| for every shift by plain joins; works for series of any length.
    Columns: keys, shift, peak_lag_s, peak_r, r_lag0."""
    arr = F.array(F.lit(0), *[F.lit(int(k)) for k in shifts])
    r = rolled(df, keys, arr)
    m = F.coalesce(F.col("mask"), F.lit(False))
    r = r.select(*keys, "shift", "frame", F.when(m, F.col("a")).alias("a"), F.when(m, F.col("b")).alias("b"))
    return peak(lagged_corr(r, [*keys, "shift"], "a", "b", max_lag, min_pairs, size), [*keys, "shift"], fps)


def null_summary(peaks: DataFrame, keys, min_null=10) -> DataFrame:
    """Observed peak against its null: r_obs, r_lag0, p (with +1), z, null_95, n_null."""
    obs = peaks.where(F.col("shift") == 0).select(*keys, F.col("peak_r").alias("r_obs"), "r_lag0", F.col("peak_lag_s").alias("lag_obs"))
    nul = peaks.where((F.col("shift") != 0) & F.col("peak_r").isNotNull()).select(*keys, F.abs("peak_r").alias("v"))
    j = nul.join(obs, keys)
    g = j.groupBy(*keys).agg(F.first("r_obs").alias("r_obs"), F.first("r_lag0").alias("r_lag0"), F.first("lag_obs").alias("lag_obs"), F.count("*").alias("n_null"),
                             F.count_if(F.col("v") >= F.abs("r_obs")).alias("_k"), F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"),
                             F.percentile("v", F.lit(0.95)).alias("null_95"))     # at most one value per shift
    ok = (F.col("n_null") >= min_null) & F.col("r_obs").isNotNull()
    return g.select(*keys, "r_obs", "r_lag0", "lag_obs", "n_null", F.when(ok, (F.col("_k") + 1) / (F.col("n_null") + 1)).alias("p"),
                    F.when(ok, (F.abs("r_obs") - F.col("_m")) / (F.col("_s") + 1e-12)).alias("z"), F.when(ok, F.col("null_95")).alias("null_95"))


SHIFT_GROUP, FEW_LAGS = 32, 8


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out over all shuffle partitions by `keys`: few bytes, but much work each, which size alone would gather in a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def batched(parts, rows: int = 100_000):
    """The frames of `parts` joined to ones of about `rows` rows, as each costs a fixed time to hand over."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p)
        if n >= rows:
            yield pd.concat(held)
            held, n = [], 0
    if held:
        yield pd.concat(held)


def moment_sums(a: np.ndarray, b: np.ndarray, max_lag: int) -> list[np.ndarray]:
    """MOMENTS of the pairs (a[t], b[s, t + lag]) for each row s of b and each lag, NaN meaning missing: by products where lags are few, else by FFT."""
    if max_lag <= FEW_LAGS:
        n, have_a = a.shape[-1], np.isfinite(a)
        x = np.where(have_a, a, 0.0)
        left = np.stack([have_a.astype(float), x, x * x], axis=-1)
        wide = np.pad(b, [(0, 0), (max_lag, max_lag)], constant_values=np.nan)
        have = np.isfinite(wide)
        y, have = np.where(have, wide, 0.0), have.astype(float)
        at = lambda v, k: v[:, max_lag + k:max_lag + k + n]
        rows = [(at(have, k) @ left, at(y, k) @ left[:, :2], at(y * y, k) @ left[:, 0]) for k in range(-max_lag, max_lag + 1)]
        pick = lambda f: np.stack([f(*r) for r in rows], axis=-1)
        return [np.round(pick(lambda h, y, z: h[:, 0])), pick(lambda h, y, z: h[:, 1]), pick(lambda h, y, z: y[:, 0]), pick(lambda h, y, z: h[:, 2]), pick(lambda h, y, z: z), pick(lambda h, y, z: y[:, 1])]
    size = 1 << int(np.ceil(np.log2(a.shape[-1] + max_lag + 1)))
    have_a, have_b = np.isfinite(a), np.isfinite(b)
    x, y = np.where(have_a, a, 0.0), np.where(have_b, b, 0.0)
    spectrum = lambda v: np.fft.rfft(v, size)
    lags = np.arange(-max_lag, max_lag + 1) % size
    meet = lambda u, v: np.fft.irfft(np.conj(u) * v, size)[..., lags]
    fa, fx, fxx = spectrum(have_a.astype(float)), spectrum(x), spectrum(x * x)
    fb, fy, fyy = spectrum(have_b.astype(float)), spectrum(y), spectrum(y * y)
    return [np.round(meet(fa, fb)), meet(fx, fb), meet(fa, fy), meet(fxx, fb), meet(fa, fyy), meet(fx, fy)]


def shift_null(df: DataFrame, keys, fps, max_lag, shifts: list[int], min_pairs=50, size=None) -> DataFrame:
    """Same result as `shift_null_join`, without copying rows for shifts and lags.  Input: keys, frame, a, b, mask.

    Series are cut into chunks; a task holds one chunk of A with the mask around it, and those chunks of B that a group
    of SHIFT_GROUP shifts rolls onto it.  It takes all shifts and lags of the two by FFT and emits moment sums for
    each (shift, lag), which add up over chunks.  Both series are centred per key first.
    """
    size = size or CHUNK
    span = max(size, 2 * max_lag + 1)
    ks = [0, *map(int, shifts)]
    stats = df.groupBy(*keys).agg((F.max("frame") + 1).alias("_t"), F.avg("a").alias("_ma"), F.avg("b").alias("_mb"))
    d = df.join(stats, keys).select(*keys, "frame", "_t", (F.col("a") - F.col("_ma")).alias("a"), (F.col("b") - F.col("_mb")).alias("b"), F.coalesce("mask", F.lit(False)).alias("mask"))
    d = staged(d, "shifts")
    nan = lambda c: F.coalesce(c, F.lit(float("nan")))
    left = halo(d.drop("b"), max_lag, max_lag, "frame", span).where("mask").groupBy(*keys, "_c", "_t").agg(F.collect_list(F.struct("frame", nan(F.when(F.col("_core"), F.col("a"))).alias("v"))).alias("_a"))
    right = d.where(F.col("b").isNotNull()).groupBy(*keys, F.floor(F.col("frame") / span).alias("_k")).agg(F.collect_list(F.struct("frame", F.col("b").alias("v"))).alias("_b"))

    groups = F.array(*[F.array(*[F.lit(k) for k in ks[i:i + SHIFT_GROUP]]) for i in range(0, len(ks), SHIFT_GROUP)])
    first, last = F.greatest(F.lit(0), F.col("_c") * span - max_lag), F.least(F.col("_t"), (F.col("_c") + 1) * span + max_lag) - 1
    task = left.select(*keys, "_c", "_t", first.alias("_u0"), last.alias("_u1"), F.posexplode(groups).alias("_g", "_ks"))
    wraps = lambda k: F.floor((F.col("_u0") - k) / F.col("_t")) != F.floor((F.col("_u1") - k) / F.col("_t"))
    hit = lambda k: F.concat(F.sequence(F.col("_u0") - k, F.col("_u1") - k, F.lit(span).cast("long")), F.array(F.col("_u1") - k), F.when(wraps(k), F.array(F.lit(0).cast("long"), F.col("_t").cast("long") - 1)).otherwise(F.array().cast("array<long>")))
    need = F.array_distinct(F.flatten(F.transform("_ks", lambda k: F.transform(hit(k), lambda x: F.floor(F.pmod(x, F.col("_t")) / span)))))
    task = task.select(*keys, "_c", "_t", "_u0", "_u1", "_g", "_ks", F.explode(need).alias("_k")).join(right, [*keys, "_k"])
    task = task.groupBy(*keys, "_c", "_g", "_u0", "_u1", "_ks").agg(F.flatten(F.collect_list("_b")).alias("_b")).join(left, [*keys, "_c"])

    part = lambda c, f: F.col(f"{c}.{f}")
    task = task.select(*keys, "_t", "_u0", "_u1", "_ks", part("_a", "frame").alias("_fa"), part("_a", "v").alias("_va"), part("_b", "frame").alias("_fb"), part("_b", "v").alias("_vb"))

    def kernel(frames):
        for pdf in frames:
            for row in pdf.to_dict("records"):
                lo, hi, k = int(row["_u0"]), int(row["_u1"]), np.asarray(row["_ks"])
                a, seen, f, g = np.full(hi - lo + 1, np.nan), np.zeros(hi - lo + 1, bool), np.asarray(row["_fa"]) - lo, np.asarray(row["_fb"])
                a[f], seen[f] = row["_va"], True
                order = np.argsort(g)
                g, w = g[order], np.asarray(row["_vb"], float)[order]
                source = (np.arange(lo, hi + 1)[None] - k[:, None]) % int(row["_t"])
                at = np.minimum(np.searchsorted(g, source), len(g) - 1)
                sums = moment_sums(a, np.where((g[at] == source) & seen[None], w[at], np.nan), max_lag)
                s, lag = np.nonzero(sums[0])
                yield pd.DataFrame({**{c: [row[c]] * len(s) for c in keys}, "shift": k[s], "lag": lag - max_lag, **{m: v[s, lag] for m, v in zip(MOMENTS, sums)}})

    task = spread_out(task, *keys, "_u0", "_ks")
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys) + ", shift int, lag int, " + ", ".join(f"{m} double" for m in MOMENTS)
    sums = task.mapInPandas(lambda frames: batched(kernel(frames)), schema)
    lc = sums.groupBy(*keys, "shift", "lag").agg(*[F.sum(m).alias(m) for m in MOMENTS]).select(*keys, "shift", "lag", "n", corr_of(min_pairs, 1e-9).alias("r"))
    some = df.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(k) for k in ks])).alias("shift"))
    return some.join(peak(lc, [*keys, "shift"], fps), [*keys, "shift"], "left")


def circular_moments(a: np.ndarray, b: np.ndarray, mask: np.ndarray, max_lag: int) -> np.ndarray:
    """MOMENTS of (a[t], B[t + lag]) where mask holds at both, B being b rolled by each shift 0 .. t - 1: [moment, lag, shift].

    Lags end at the ends, shifts go round: per lag the rows of A that count are correlated with b on the circle by FFT.
    """
    t, lags = len(a), np.arange(-max_lag, max_lag + 1)
    wide = np.pad(mask, max_lag)
    left = np.stack([wide[max_lag + k:max_lag + k + t] for k in lags]) & (mask & np.isfinite(a))[None]
    x, have = np.where(left, np.nan_to_num(a)[None], 0.0), np.isfinite(b)
    y = np.where(have, b, 0.0)
    fa, fx, fxx = (np.conj(np.fft.rfft(v)) for v in (left.astype(float), x, x * x))
    fb, fy, fyy = (np.fft.rfft(v)[None] for v in (have.astype(float), y, y * y))
    at = (lags[:, None] - np.arange(t)[None]) % t
    sums = np.stack([np.take_along_axis(np.fft.irfft(u * v, t), at, 1) for u, v in ((fa, fb), (fx, fb), (fa, fy), (fxx, fb), (fa, fyy), (fx, fy))])
    sums[0] = np.round(sums[0])
    return sums


def shift_summary(df: DataFrame, keys, fps, max_lag, shifts: list[int], min_pairs=50, min_null=10, size=None) -> DataFrame:
    """`null_summary` of `shift_null`.  A series that fits a chunk is taken through all shifts and lags in one task, and only its summary leaves it;
    longer ones go through `shift_null`."""
    d = df.select(*keys, F.col("frame").cast("long").alias("frame"), "a", "b", F.coalesce("mask", F.lit(False)).alias("mask"))
    short, long = whole_series(d, keys, {"a": field("a", np.nan), "b": field("b", np.nan), "m": field("mask", 0)}, size, "shifts")
    ks = np.array([int(k) for k in shifts])

    def emit(row):
        t = int(row.t)
        a, b = np.asarray(row.a, float), np.asarray(row.b, float)
        with np.errstate(all="ignore"):
            a, b = a - np.sum(a[np.isfinite(a)]) / np.isfinite(a).sum(), b - np.sum(b[np.isfinite(b)]) / np.isfinite(b).sum()
            n, sx, sy, sxx, syy, sxy = circular_moments(dense(t, row.f, a), dense(t, row.f, b), dense(t, row.f, row.m) > 0, max_lag)
            vx, vy = sxx - sx * sx / n, syy - sy * sy / n
            r = np.where((n >= max(min_pairs, 1)) & (vx > 1e-9) & (vy > 1e-9), np.clip((sxy - sx * sy / n) / np.sqrt(vx * vy), -1, 1), np.nan)
        size_of = np.where(np.isfinite(r), np.abs(r), -1.0)
        best = size_of.argmax(0)                                       # the first lag on ties
        peaks = size_of.max(0)
        null = peaks[ks[ks != 0] % t]
        null, seen = null[null >= 0], peaks[0] >= 0
        if len(null):
            ok, top = len(null) >= min_null and seen, peaks[0]
            yield (plain(r[best[0], 0]) if seen else None, plain(r[max_lag, 0]), (float(best[0]) - max_lag) / fps if seen else None, len(null),
                   (int((null >= top).sum()) + 1) / (len(null) + 1) if ok else None, float((top - null.mean()) / (null.std() + 1e-12)) if ok else None, float(np.quantile(null, 0.95)) if ok else None)

    out = per_series(short, keys, "r_obs double, r_lag0 double, lag_obs double, n_null long, p double, z double, null_95 double", emit)
    return out if long is None else out.unionByName(null_summary(shift_null(long, keys, fps, max_lag, shifts, min_pairs, size), keys, min_null))


def xcorr_dropna(df: DataFrame, keys, max_lag: int, min_n: int, min_std=1e-6) -> DataFrame:
    """Cross-correlation after dropping rows where either side is missing, gaps closed up: the valid rows
    are renumbered, z-scored and summed over n.  Too short or constant series give a single 0 at lag 0."""
    from .ordered import running
    v = df.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    v = running(v, keys, {"_i": ("sum", F.lit(1))}).withColumn("frame", (F.col("_i") - 1).cast("int"))
    st = v.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg("a").alias("_ma"), F.avg("b").alias("_mb"), F.stddev_pop("a").alias("_da"), F.stddev_pop("b").alias("_db"))
    ok = (F.col("_n") >= min_n) & (F.col("_da") >= min_std) & (F.col("_db") >= min_std)
    z = v.join(st.where(ok), keys).select(*keys, "frame", "_n", ((F.col("a") - F.col("_ma")) / F.col("_da")).alias("a"), ((F.col("b") - F.col("_mb")) / F.col("_db")).alias("b"))
    p = lag_pairs(z, [*keys, "_n"], "a", "b", max_lag).groupBy(*keys, "lag").agg((F.sum(F.col("a") * F.col("b")) / F.first("_n")).alias("r"))
    none = st.where(~ok).select(*keys, F.lit(0).alias("lag"), F.lit(0.0).alias("r"))
    return p.unionByName(none)


def rolled_similarity(df: DataFrame, keys, shifts: list[int], min_feats: int) -> DataFrame:
    """Mean of minus the mean absolute difference between feature arrays a and rolled b over the masked
    rows, for every shift: keys, shift, s, n.  Input: keys, frame, a, b (array<double>), mask.  Series that
    fit a chunk are rolled in memory; longer ones by a join on the shifted frame."""
    ks = [0, *shifts]
    if not _whole(None):
        p = rolled(df, keys, F.array(*[F.lit(int(k)) for k in ks]), keep=("a", "mask")).where("mask")
        d = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
        ok = F.filter(d, lambda x: x.isNotNull())
        s = F.when(F.size(ok) >= min_feats, -F.aggregate(ok, F.lit(0.0), lambda t, x: t + x) / F.size(ok))
        return p.groupBy(*keys, "shift").agg(F.avg(s).alias("s"), F.count("*").alias("n"))

    @F.pandas_udf(T.ArrayType(T.StructType().add("shift", T.IntegerType()).add("s", T.DoubleType()).add("n", T.LongType())))
    def kernel(t: pd.Series, f: pd.Series, a: pd.Series, b: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        for n, fr, av, bv, mv in zip(t, f, a, b, m):
            k = len(av) // len(fr)
            A, B, M = np.full((n, k), np.nan), np.full((n, k), np.nan), np.zeros(n, bool)
            A[fr], B[fr], M[fr] = np.asarray(av, float).reshape(-1, k), np.asarray(bv, float).reshape(-1, k), np.asarray(mv, bool)
            rows = []
            for s in ks:
                d = np.abs(A[M] - np.roll(B, s, axis=0)[M])
                c = np.isfinite(d).sum(1)
                v = -np.nansum(d, 1)[c >= max(min_feats, 1)] / c[c >= max(min_feats, 1)]
                rows.append({"shift": int(s), "s": float(v.mean()) if len(v) else None, "n": int(M.sum())})
            out.append(rows)
        return pd.Series(out)

    nn = lambda c: F.transform(c, lambda x: F.coalesce(x, F.lit(float("nan"))))
    g = df.groupBy(*keys).agg(F.collect_list(F.struct("frame", nn("a").alias("a"), nn("b").alias("b"), F.coalesce("mask", F.lit(False)).alias("m"))).alias("_s"), (F.max("frame") + 1).alias("_t"))
    part = lambda c: F.transform("_s", lambda x: x[c])
    g = g.select(*keys, F.explode(kernel("_t", part("frame"), F.flatten(part("a")), F.flatten(part("b")), part("m"))).alias("_p"))
    return g.select(*keys, "_p.shift", "_p.s", "_p.n").where(F.col("n") > 0)
