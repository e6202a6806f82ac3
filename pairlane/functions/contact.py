"""Contact between two skeletons: all segment pairs of a frame, evaluated on Arrow batches.

As nested array lambdas the 196 segment pairs (and 121 samples per pair) of a row cost about a
hundred times more than the same arithmetic on whole batches, so this is a pandas UDF.  Each row is
independent: no shuffle, any partitioning.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from pairlane.constants import CHART, CONF, REGIONS, SEGMENTS

STEP = 256                                          # rows per numpy block, bounds memory


def flat(k: Column) -> Column:
    """array<struct<x,y,c>> as array<double>, the cheap form to hand to Arrow."""
    return F.flatten(F.transform(k, lambda p: F.array(p["x"], p["y"], p["c"])))


def _segments(k, segs):
    i, j = [s[1] for s in segs], [s[2] for s in segs]
    ok = (k[:, i, 2] >= CONF) & (k[:, j, 2] >= CONF)
    return k[:, i, :2], k[:, j, :2], ok


def _point_to_segments(p, a, b):
    ab = b - a
    t = np.clip(((p - a) * ab).sum(-1) / np.maximum((ab * ab).sum(-1), 1e-9), 0, 1)
    return np.sqrt(((p - (a + t[..., None] * ab)) ** 2).sum(-1))


def _blocks(*cols):
    n = len(cols[0])
    for s in range(0, n, STEP):
        yield slice(s, s + STEP), [np.vstack(c.iloc[s:s + STEP].to_numpy()).astype(float).reshape(-1, 17, 3) for c in cols]


@F.pandas_udf(T.StructType().add("d", T.DoubleType()).add("idx", T.IntegerType()))
def nearest_regions(ka: pd.Series, kb: pd.Series) -> pd.DataFrame:
    """Smallest segment distance and its region pair (6 * a + b); the first pair wins ties."""
    reg = np.array([REGIONS.index(s[0]) for s in SEGMENTS])
    pair = (reg[:, None] * len(REGIONS) + reg[None]).ravel()
    order = np.argsort(pair, kind="stable")
    d_out, i_out = [], []
    for _, (a, b) in _blocks(ka, kb):
        a1, a2, oka = _segments(a, SEGMENTS)
        b1, b2, okb = _segments(b, SEGMENTS)
        A1, A2, B1, B2 = a1[:, :, None], a2[:, :, None], b1[:, None], b2[:, None]
        d = np.minimum(np.minimum(_point_to_segments(A1, B1, B2), _point_to_segments(A2, B1, B2)),
                       np.minimum(_point_to_segments(B1, A1, A2), _point_to_segments(B2, A1, A2)))
        d = np.where(oka[:, :, None] & okb[:, None], d, np.inf).reshape(len(d), -1)[:, order]
        best = d.argmin(1)
        v = d[np.arange(len(d)), best]
        d_out += [None if not np.isfinite(x) else float(x) for x in v]
        i_out += [None if not np.isfinite(x) else int(pair[order[m]]) for x, m in zip(v, best)]
    return pd.DataFrame({"d": pd.array(d_out, "Float64"), "idx": pd.array(i_out, "Int32")})


_SEG = [s for s in SEGMENTS if s[1] != s[2]]
_CONTACT = ["d", "xa", "ya", "xb", "yb", "ra", "rb", "cxa", "cya", "cxb", "cyb", "dra", "drb", "sxa", "sya", "sxb", "syb"]


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType() if c in ("ra", "rb", "dra", "drb") else T.DoubleType()) for c in _CONTACT]))
def contact_location(ka: pd.Series, kb: pd.Series, thr: pd.Series) -> pd.DataFrame:
    """Per frame, from the closest of 11 x 11 samples on every segment pair:
    d, xa..yb, ra, rb: the closest pair of points and its regions (first pair wins ties);
    cxa..cyb, dra, drb: contact centroids weighted by max(0, thr - distance) and dominant regions;
    sxa..syb: the same weighted mean on the canonical chart, left and right folded."""
    reg = np.array([REGIONS.index(s[0]) for s in _SEG])
    chart = np.array(CHART, float)
    c1, c2 = chart[[s[1] for s in _SEG]], chart[[s[2] for s in _SEG]]
    t = np.linspace(0, 1, 11)
    parts = []
    for sl, (a, b) in _blocks(ka, kb):
        n, S = len(a), len(_SEG)
        a1, a2, oka = _segments(a, _SEG)
        b1, b2, okb = _segments(b, _SEG)
        P = a1[:, :, None] + t[None, None, :, None] * (a2 - a1)[:, :, None]                     # n, S, 11, 2
        q1, dq = b1[:, None, :, None], (b2 - b1)[:, None, :, None]                              # n, 1, S, 1, 2
        pp = P[:, :, None]                                                                      # n, S, 1, 11, 2
        l2 = (dq * dq).sum(-1)
        u = np.where(l2 > 0, ((pp - q1) * dq).sum(-1) / np.where(l2 > 0, l2, 1) * 10, 0.0)
        # along the second segment the distance is convex, so only the samples around the foot point count
        j0 = np.clip(np.floor(u), 0, 9).astype(int)
        dist = lambda j: np.sqrt(((pp - (q1 + t[j][..., None] * dq)) ** 2).sum(-1))
        d0, d1 = dist(j0), dist(j0 + 1)
        j = np.where(d0 <= d1, j0, j0 + 1)
        dd = np.minimum(d0, d1)
        i = dd.argmin(-1)                                                                       # n, S, S
        pick = lambda x: np.take_along_axis(x, i[..., None], -1)[..., 0]
        d, j = np.where(oka[:, :, None] & okb[:, None], pick(dd), np.inf), pick(j)
        xa = a1[:, :, None] + t[i][..., None] * (a2 - a1)[:, :, None]
        xb = b1[:, None] + t[j][..., None] * (b2 - b1)[:, None]
        ca = c1[None, :, None] + t[i][..., None] * (c2 - c1)[None, :, None]
        cb = c1[None, None] + t[j][..., None] * (c2 - c1)[None, None]
        w = np.clip(thr.iloc[sl].to_numpy(float)[:, None, None] - d, 0, None)
        w[~np.isfinite(d)] = 0.0
        W = w.sum((1, 2))
        with np.errstate(all="ignore"):
            mean = lambda x: np.where(W[:, None] > 0, (w[..., None] * x).sum((1, 2)) / W[:, None], np.nan)
            mA, mB, sA, sB = mean(xa), mean(xb), mean(ca), mean(cb)
        wa = np.stack([w[:, reg == r].sum((1, 2)) for r in range(len(REGIONS))], 1)
        wb = np.stack([w[:, :, reg == r].sum((1, 2)) for r in range(len(REGIONS))], 1)
        f = d.reshape(n, -1)
        m = f.argmin(1)
        some, row = np.isfinite(f[np.arange(n), m]), np.arange(n)
        pt = lambda x: np.where(some[:, None], x.reshape(n, S * S, 2)[row, m], np.nan)
        pa, pb = pt(xa), pt(xb)
        df = pd.DataFrame({"d": np.where(some, f[row, m], np.nan), "xa": pa[:, 0], "ya": pa[:, 1], "xb": pb[:, 0], "yb": pb[:, 1],
                           "ra": reg[m // S], "rb": reg[m % S], "cxa": mA[:, 0], "cya": mA[:, 1], "cxb": mB[:, 0], "cyb": mB[:, 1],
                           "dra": wa.argmax(1), "drb": wb.argmax(1), "sxa": np.abs(sA[:, 0]), "sya": sA[:, 1], "sxb": np.abs(sB[:, 0]), "syb": sB[:, 1]})
        df = df.astype({c: "Float64" if df[c].dtype.kind == "f" else "Int32" for c in df})
        df.loc[~some, ["ra", "rb"]] = pd.NA
        df.loc[~(W > 0), ["dra", "drb"]] = pd.NA
        for c in df:
            if str(df[c].dtype) == "Float64":
                df[c] = df[c].mask(df[c].isna() | np.isnan(df[c].to_numpy(float, na_value=np.nan)))
        parts.append(df)
    return pd.concat(parts, ignore_index=True)[_CONTACT] if parts else pd.DataFrame({c: [] for c in _CONTACT})


def distinct_bodies(flats: Column) -> Column:
    """How many of a frame's skeletons (17 x, y, c each, one after another, in order of rank) are bodies of their own: a
    skeleton repeats one that counts if they share four or more sure points, on average closer than 0.15 of its size."""
    def kernel(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            q = np.asarray(v, float).reshape(-1, 17, 3)
            sure, xy = q[..., 2] > 0.3, q[..., :2]
            box = np.where(sure[..., None], xy, np.nan)
            size = np.sqrt(np.prod(np.nanmax(box, 1) - np.nanmin(box, 1), axis=1) + 1e-6)
            both = sure[:, None] & sure[None]
            apart = np.where(both, np.linalg.norm(xy[:, None] - xy[None], axis=-1), 0).sum(-1) / np.maximum(both.sum(-1), 1)
            near = (both.sum(-1) >= 4) & (apart < 0.15 * size[:, None])
            own = np.zeros(len(q), bool)
            for i in range(len(q)):
                own[i] = not near[i, own].any()
            out.append(int(own.sum()))
        return pd.Series(out, dtype="int64")
    return F.pandas_udf(kernel, "long")(flats)
