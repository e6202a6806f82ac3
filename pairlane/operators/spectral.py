"""Recursive filters and spectra.  IIR filters carry state, so they run as numpy on Arrow groups; a
series is cut into chunks with a burn-in halo, long enough that the start-up error is below 1e-9."""
from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .ordered import CHUNK, _whole, halo


def butter2(fps: float, lo: float | None, hi: float | None):
    """Second-order Butterworth (low, high or band pass) by the bilinear transform: (b, a)."""
    warp = lambda f: 2 * math.tan(math.pi * f / fps)
    root = np.exp(1j * np.pi * np.array([3, 5]) / 4)
    if lo and hi:
        w1, w2 = warp(lo), warp(hi)
        bw, w0 = w2 - w1, math.sqrt(w1 * w2)
        r = root * bw / 2
        p = np.concatenate([r + np.sqrt(r ** 2 - w0 ** 2), r - np.sqrt(r ** 2 - w0 ** 2)])
        z, gain = np.zeros(2), bw ** 2
    elif hi:
        w = warp(hi)
        p, z, gain = root * w, np.array([]), w ** 2
    else:
        w = warp(lo)
        p, z, gain = w / root, np.zeros(2), 1.0
    zz = np.concatenate([(2 + z) / (2 - z), -np.ones(len(p) - len(z))])
    pp = (2 + p) / (2 - p)
    k = gain * np.real(np.prod(2 - z) / np.prod(2 - p))
    return np.real(k * np.poly(zz)), np.real(np.poly(pp))


def _recursion(b, a, x, state):
    """Direct form II transposed, sample by sample; only used to tabulate the responses below."""
    y, n, s = np.empty(len(x)), len(a) - 1, state.copy()
    for i, v in enumerate(x):
        y[i] = b[0] * v + s[0]
        for j in range(n - 1):
            s[j] = s[j + 1] + b[j + 1] * v - a[j + 1] * y[i]
        s[n - 1] = b[n] * v - a[n] * y[i]
    return y


def _burn_in(a) -> int:
    """Samples until a start-up error has decayed to 1e-12."""
    r = np.abs(np.roots(a)).max()
    return int(math.ceil(math.log(1e-12) / math.log(r))) if r < 1 else CHUNK


@functools.lru_cache(maxsize=64)
def _responses(b: tuple, a: tuple):
    """Impulse response and response to the step-matched initial state, both until they have decayed."""
    b, a = np.array(b), np.array(a)
    n, k = len(a), _burn_in(a) + 1
    A = np.eye(n - 1) - np.vstack([-a[1:], np.eye(n - 2, n - 1)]).T
    zi = np.linalg.solve(A, b[1:] - a[1:] * b[0])
    impulse = np.zeros(k)
    impulse[0] = 1.0
    return _recursion(b, a, impulse, np.zeros(n - 1)), _recursion(b, a, np.zeros(k), zi)


def _lfilter(b, a, x):
    """Filter started in the steady state of x[0], as a convolution with the tabulated responses."""
    h, g = _responses(tuple(b), tuple(a))
    n = len(x)
    if n * len(h) > 1 << 18:
        m = 1 << int(np.ceil(np.log2(n + len(h))))
        y = np.fft.irfft(np.fft.rfft(x, m) * np.fft.rfft(h, m), m)[:n]
    else:
        y = np.convolve(x, h[:n])[:n]
    k = min(n, len(g))
    y[:k] += x[0] * g[:k]
    return y


def filtfilt(b, a, x):
    """Forward and backward filtering with odd extension and step-matched initial state."""
    pad = min(3 * len(a), len(x) - 1)
    e = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]])
    y = _lfilter(b, a, _lfilter(b, a, e)[::-1])[::-1]
    return y[pad:len(y) - pad]


def filter_runs(df: DataFrame, keys: list[str], cols: list[str], fps: float, lo=None, hi=None, min_run: int = 13, size=None) -> DataFrame:
    """Zero-phase filter of each contiguous run of at least `min_run` rows; shorter runs give NULL.
    Output columns are named {col}_f."""
    return filter_bands(df, keys, cols, fps, {"f": (lo, hi)}, min_run, size).drop(*cols)


def filter_bands(df: DataFrame, keys: list[str], cols: list[str], fps: float, bands: dict[str, tuple], min_run: int = 13, size=None) -> DataFrame:
    """`filter_runs` for several bands, name -> (lo, hi), in one pass: keys, frame, cols and {col}_{name}.

    Each piece of a series is one row of arrays, so many pieces share an Arrow batch.
    """
    coef = [butter2(fps, lo, hi) for lo, hi in bands.values()]
    names = [f"{c}_{n}" for c in cols for n in bands]
    whole = _whole(size)
    h = min(max(min_run, *(_burn_in(a) for _, a in coef)), (size or CHUNK) - 1) if not whole else 0
    d = df.select(*keys, "frame", *cols)
    d = d.withColumns({"_c": F.lit(0).cast("long"), "_core": F.lit(True)}) if whole else halo(d, h, h, "frame", size or CHUNK)

    def filtered(f: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
        step, out = np.diff(f) == 1, []
        for x in columns:
            ok = np.isfinite(x)
            cut = np.flatnonzero(~(ok[1:] & ok[:-1] & step)) + 1
            first, end = np.append(0, cut), np.append(cut, len(x))
            runs = [(i, j) for i, j in zip(first, end) if j - i >= min_run and ok[i]]
            for b, a in coef:
                y = np.full(len(x), np.nan)
                for i, j in runs:
                    y[i:j] = filtfilt(b, a, x[i:j])
                out.append(y)
        return out

    def kernel(frames):
        for pdf in frames:
            rows = []
            for f, *columns in zip(pdf["frame"], *(pdf[c] for c in cols)):
                order = np.argsort(f)
                back = np.argsort(order)
                rows.append([y[back] for y in filtered(np.asarray(f)[order], [np.asarray(x, float)[order] for x in columns])])
            out = pdf[[*keys, "frame", "_core", *cols]].copy()
            for i, n in enumerate(names):
                out[n] = [r[i] for r in rows]
            yield out

    types = {k: df.schema[k].dataType.simpleString() for k in [*keys, "frame", *cols]}
    g = d.groupBy(*keys, "_c").agg(F.collect_list(F.struct("frame", "_core", *cols)).alias("_s"))
    arrays = g.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in ("frame", "_core", *cols)])
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"`{c}` array<{types[c]}>" for c in ("frame",)), "_core array<boolean>", *(f"`{c}` array<{types[c]}>" for c in cols), *(f"`{n}` array<double>" for n in names)])
    rows = arrays.mapInPandas(kernel, schema).select(*keys, F.explode(F.arrays_zip("frame", "_core", *cols, *names)).alias("_r")).where("_r._core")
    value = lambda n: F.when(~F.isnan(f"_r.{n}"), F.col(f"_r.{n}")).alias(n)          # a missing value is NULL, never NaN
    return rows.select(*keys, F.col("_r.frame").alias("frame"), *[value(n) for n in [*cols, *names]])


def phase_difference(df: DataFrame, keys: list[str], a: str, b: str, fps: float, lo=0.2, hi=2.5) -> DataFrame:
    """Wrapped phase difference of two band-passed series (missing counts 0), NULL where either is missing.
    The analytic signal needs the whole series; a longer one is cut into overlapping pieces."""
    bb, aa = butter2(fps, lo, hi)
    whole = _whole(None)
    h = min(4 * _burn_in(aa), CHUNK - 1)
    d = df.select(*keys, "frame", F.col(a).alias("a"), F.col(b).alias("b"))
    d = d.withColumns({"_c": F.lit(0).cast("long"), "_core": F.lit(True)}) if whole else halo(d, h, h)

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("frame", ignore_index=True)
        x, y = p["a"].to_numpy(float), p["b"].to_numpy(float)
        ok = np.isfinite(x) & np.isfinite(y)
        ph = []
        for v in (np.where(ok, x, 0.0), np.where(ok, y, 0.0)):
            f = filtfilt(bb, aa, v) if len(v) > 15 else v
            s = np.fft.fft(f)
            n = len(f)
            g = np.zeros(n)
            g[0] = 1
            g[1:(n + 1) // 2] = 2
            if n % 2 == 0:
                g[n // 2] = 1
            ph.append(np.angle(np.fft.ifft(s * g)))
        r = np.mod(ph[0] - ph[1] + np.pi, 2 * np.pi) - np.pi
        p["dphi"] = pd.Series(np.where(ok, r, np.nan)).astype("Float64").mask(~ok)
        return p.loc[p["_core"], [*keys, "frame", "dphi"]]

    kt = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return d.groupBy(*keys, "_c").applyInPandas(kernel, f"{kt}, frame int, dphi double")


def spectrum_udf(win: int):
    """Magnitudes of the Hann-windowed spectrum of one frame of samples."""
    w = np.hanning(win)

    def kernel(s: pd.Series) -> pd.Series:
        return pd.Series([np.abs(np.fft.rfft(np.asarray(v, float) * w)).tolist() if v is not None and len(v) == win else None for v in s])
    return F.pandas_udf(kernel, "array<double>")


def turn_phases(x: np.ndarray, angles: np.ndarray) -> np.ndarray:
    """Columns of x with each frequency turned by its angle, the same for all columns, so every spectrum and cross-spectrum
    stays; the mean and, for an even number of rows, the highest frequency keep their phase."""
    spectrum = np.fft.rfft(x, axis=0)
    free = slice(1, (len(x) + 1) // 2)
    spectrum[free] *= np.exp(1j * angles[free])[:, None]
    return np.fft.irfft(spectrum, len(x), axis=0)


def redrawn_phases(df: DataFrame, keys: list[str], cols: list[str], min_rows: int, seed: int = 0) -> DataFrame:
    """keys, n, var0, var1 (summed variances before and after) and cells (sign patterns about the medians that occur
    after) of every group of at least `min_rows` rows (a piece of bounded length), its phases turned by angles from a
    generator seeded by the keys."""
    @F.pandas_udf("n long, var0 double, var1 double, cells long")
    def kernel(number: pd.Series, values: pd.Series) -> pd.DataFrame:
        rows = []
        for k, v in zip(number, values):
            x = np.asarray(v, float).reshape(-1, len(cols))
            y = turn_phases(x, np.random.default_rng([seed, int(k) & 0xFFFFFFFF]).uniform(0.0, 2 * np.pi, len(x) // 2 + 1))
            cells = np.unique((y > np.median(y, axis=0)) @ (1 << np.arange(len(cols))))
            rows.append((len(x), x.var(axis=0).sum(), y.var(axis=0).sum(), len(cells)))
        return pd.DataFrame(rows, columns=["n", "var0", "var1", "cells"])
    g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("frame", F.array(*cols).alias("v")))).alias("s")).where(F.size("s") >= min_rows)
    return g.select(*keys, kernel(F.xxhash64(*keys), F.flatten(F.transform("s", lambda x: x["v"]))).alias("r")).select(*keys, "r.*")
