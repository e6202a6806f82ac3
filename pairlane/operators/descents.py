"""Profile metrics of descents: all slices of a batch as one padded matrix."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .spectral import butter2, filtfilt

METRICS = ["drop_bl", "dur_10_90_s", "peak_down_v", "peak_v_per_drop", "t_peak_frac", "end_speed_ratio", "peak_brake", "ldlj"]


def _smooth(h: np.ndarray, coeffs) -> np.ndarray:
    """A slice with its gaps filled along straight lines, low-passed without lag."""
    at, known = np.arange(len(h)), np.isfinite(h)
    return filtfilt(*coeffs, np.interp(at, at[known], h[known]))


def _slope(rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Central differences along each row of n values, one-sided at both ends."""
    at = np.arange(rows.shape[1])
    right, left = np.minimum(at + 1, n[:, None] - 1), np.maximum(at - 1, 0)
    take = lambda i: np.take_along_axis(rows, np.broadcast_to(np.clip(i, 0, None), rows.shape), axis=1)
    return (take(right) - take(left)) / np.maximum(right - left, 1)


def measure(heights: list[np.ndarray], first: np.ndarray, last: np.ndarray, fps: float) -> np.ndarray:
    """One row of METRICS per slice; `first` and `last` are places in the slice where the descent begins and ends.

    With height taken from the descent's first row, the bottom is the lowest row up to a second behind its end and the drop
    its depth (0.3 at least, else no metrics).  The descent proper runs from a tenth to nine tenths of the drop.
    """
    out = np.full((len(heights), len(METRICS)), np.nan)
    known = np.array([np.isfinite(h).sum() >= 14 for h in heights], bool)
    if not known.any():
        return out
    coeffs = butter2(fps, None, 3.0)
    rows = [_smooth(h, coeffs) for h, k in zip(heights, known) if k]
    n, i0, end = np.array([len(x) for x in rows]), first[known], last[known]
    x = np.zeros((len(rows), n.max()))
    for i, v in enumerate(rows):
        x[i, :len(v)] = v - v[i0[i]]
    at = np.arange(x.shape[1])[None]
    span = lambda lo, hi: (at >= lo[:, None]) & (at < hi[:, None])
    lowest = lambda values, mask: np.where(mask, values, np.inf).argmin(axis=1)
    pick = lambda values, i: values[np.arange(len(i)), i]

    fall = span(i0, n)
    bottom = lowest(x, span(i0, np.minimum(n, end + int(fps))))
    drop = -pick(x, bottom)
    reach = lambda share: np.where((hit := fall & (x <= -share * drop[:, None])).any(axis=1), hit.argmax(axis=1), i0)
    begin, finish = reach(0.1), reach(0.9)
    v = _slope(x, n) * fps
    fastest = lowest(v, span(begin, finish + 1))
    speed = -pick(v, fastest)
    late = span(i0, bottom + 1) & (x <= -0.8 * drop[:, None])
    brake = np.where(span(fastest, np.minimum(bottom + fps // 2, n)), _slope(v, n) * fps, -np.inf).max(axis=1)
    with np.errstate(all="ignore"):
        ending = np.where(late, -v, 0).sum(axis=1) / late.sum(axis=1) / speed
        jerk = np.array([_jerkiness(v[i, max(0, a - int(fps) // 2):min(b + 1 + int(fps) // 2, m)], fps) for i, (a, b, m) in enumerate(zip(begin, finish, n))])
        table = np.stack([drop, (finish - begin) / fps, speed, speed / drop, (fastest - begin) / np.maximum(finish - begin, 1), ending, brake, jerk], axis=1)
    table[~(drop > 0.3)] = np.nan
    out[known] = table
    return out


def _jerkiness(v: np.ndarray, fps: float) -> float:
    """Log dimensionless jerk of a stretch of speed: duration cubed over peak speed squared, times summed squared jerk."""
    jerk = np.gradient(np.gradient(v, 1 / fps), 1 / fps)
    return float(-np.log((len(v) / fps) ** 3 * (jerk @ jerk) / fps / np.abs(v).max() ** 2))


def profiles(slices: DataFrame, fps: float) -> DataFrame:
    """clip, f0, f1 and METRICS of slices with `s`, the (frame, h) of a bounded number of rows."""
    def kernel(f0: pd.Series, f1: pd.Series, frames: pd.Series, h: pd.Series) -> pd.DataFrame:
        frames = [np.asarray(f) for f in frames]
        place = lambda s: np.array([np.searchsorted(f, v) for f, v in zip(frames, s)], int)
        table = measure([np.asarray(v, float) for v in h], place(f0), place(f1), fps)
        return pd.DataFrame({m: pd.Series(table[:, i]).astype("Float64").mask(~np.isfinite(table[:, i])) for i, m in enumerate(METRICS)})
    udf = F.pandas_udf(kernel, T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS]))
    return slices.select("clip", "f0", "f1", udf("f0", "f1", F.transform("s", lambda x: x["frame"]), F.transform("s", lambda x: x["h"])).alias("y")).select("clip", "f0", "f1", "y.*")
