"""Bounded-reach series steps.  A step is a list of window stages plus its reach; `apply_steps`
fuses any chain of them into one halo and one shuffle."""
from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .ordered import over_neighbours


class Step(NamedTuple):
    stages: list
    back: int
    fwd: int


def apply_steps(df: DataFrame, keys: list[str], *steps: Step, order: str = "frame", size: int | None = None) -> DataFrame:
    stages = [s for st in steps for s in st.stages]
    out = over_neighbours(df, keys, stages, sum(s.back for s in steps), sum(s.fwd for s in steps), order, size)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def dist(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def fill_small_gaps(col: str, max_fill: int, out: str | None = None, flag: str | None = None) -> Step:
    """Linear fill of NULL runs of at most `max_fill` rows that have values on both sides."""
    out, t = out or col, f"_{col}"
    c, f = F.col(col), F.col("frame")
    seen = F.when(c.isNotNull(), F.struct(f.alias("f"), c.alias("v")))
    gap_ok = c.isNull() & (F.col(f"{t}_n.f") - F.col(f"{t}_p.f") - 1 <= max_fill)
    line = F.col(f"{t}_p.v") + (F.col(f"{t}_n.v") - F.col(f"{t}_p.v")) * (
        (f - F.col(f"{t}_p.f")) / (F.col(f"{t}_n.f") - F.col(f"{t}_p.f")))
    stages = [{f"{t}_p": lambda w: F.last(seen, ignorenulls=True).over(w.rowsBetween(-max_fill, -1)),
               f"{t}_n": lambda w: F.first(seen, ignorenulls=True).over(w.rowsBetween(1, max_fill))},
              {flag or f"{t}_fl": lambda w: F.coalesce(gap_ok, F.lit(False)),
               out: lambda w: F.when(gap_ok, line).otherwise(c)}]
    return Step(stages, max_fill, max_fill)


def remove_teleports(x: str, y: str, limit, flag: str = "_tele") -> Step:
    """NULL the destination of any one-row jump longer than `limit` (measured on the input series)."""
    far = lambda w: F.coalesce(dist(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) > limit, F.lit(False))
    keep = lambda c: lambda w: F.when(~F.col(flag), F.col(c))
    return Step([{flag: far}, {x: keep(x), y: keep(y)}], 1, 0)


def sg_matrix(window: int, poly: int, deriv: int, dt: float = 1.0) -> np.ndarray:
    """Row i holds the weights that give the derivative at sample i of a least-squares polynomial."""
    j = np.arange(window)
    return np.array([np.linalg.pinv((j - i)[:, None].astype(float) ** np.arange(poly + 1))[deriv]
                     for i in range(window)]) * math.factorial(deriv) / dt ** deriv


def savgol(cols: list[str], fps: float, window: int, poly: int = 3, derivs=(0, 1, 2, 3), run_min: int | None = None,
           out: str = "{c}_d{d}") -> Step:
    """Savitzky-Golay values inside contiguous runs where all `cols` are present.  Derivatives are
    NULL within half a window of a run edge; the smoothed value keeps the edge fit."""
    run_min = max(run_min or window, window)
    half, reach, f = window // 2, run_min - 1, F.col("frame")
    OK, NB, NA = (f"_{n}_{cols[0]}" for n in ("ok", "nb", "na"))
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    hole = F.when(~F.col(OK), f)

    def before(w):
        b = w.rowsBetween(-reach, -1)
        return F.coalesce(f - F.last(hole, ignorenulls=True).over(b) - 1, F.count("*").over(b))

    def after(w):
        b = w.rowsBetween(1, reach)
        return F.coalesce(F.first(hole, ignorenulls=True).over(b) - f - 1, F.count("*").over(b))

    in_run = f"{OK} AND {NB} + {NA} + 1 >= {run_min}"
    centre = f"{in_run} AND {NB} >= {half} AND {NA} >= {half}"
    name = lambda c, o: c if o == 0 else f"_{c}_{'m' if o < 0 else 'p'}{abs(o)}"
    at = lambda c, o: lambda w: F.lag(c, -o).over(w) if o < 0 else F.lead(c, o).over(w)
    near = {name(c, o): at(c, o) for c in cols for o in range(-(window - 1), window)
            if o != 0 and (0 in derivs or abs(o) <= half)}
    dot = lambda c, weights, i: " + ".join(f"{name(c, j - i)} * {float(v)!r}D" for j, v in enumerate(weights))
    res = {}
    for c in cols:
        for d in derivs:
            m = sg_matrix(window, poly, d, 1.0 / fps)
            e = f"CASE WHEN {centre} THEN {dot(c, m[half], half)}"
            if d == 0:
                # edge rows are few: weights by position, neighbours as an array
                arr = "array(" + ", ".join(name(c, o) for o in range(-(window - 1), window)) + ")"
                wts = "array(" + ", ".join("array(" + ", ".join(f"{float(v)!r}D" for v in row) + ")" for row in m) + ")"
                pos = f"CASE WHEN {NB} < {half} THEN {NB} ELSE {window - 1} - {NA} END"
                e += (f" WHEN {in_run} THEN aggregate(zip_with(slice({arr}, {window} - CAST({pos} AS INT), {window}), "
                      f"element_at({wts}, CAST({pos} AS INT) + 1), (a, b) -> a * b), 0D, (s, v) -> s + v)")
            res[out.format(c=c, d=d)] = (lambda e: lambda w: F.expr(e))(e + " END")
    return Step([{OK: lambda w: ok}, {NB: before, NA: after}, near, res], reach, reach)


def rolling(col: str, out: str, kind: str, before: int, after: int, min_periods: int = 1) -> Step:
    """Centred rolling mean or median over present values, NULL below `min_periods`."""
    def stage(w):
        b = w.rowsBetween(-before, after)
        v = F.avg(col).over(b) if kind == "mean" else F.percentile(col, F.lit(0.5)).over(b)
        return F.when(F.count(col).over(b) >= min_periods, v)
    return Step([{out: stage}], before, after)


def majority5(flag: str, out: str | None = None) -> Step:
    """Binary median of 5 rows, series ends mirrored about the half-sample."""
    v = F.col(flag).cast("int")

    def stage(w):
        inner = F.sum(v).over(w.rowsBetween(-2, 2))
        edge = lambda o1, o2: (
            F.when(o1(flag, 1).over(w).isNull(), v + F.coalesce((F.lead if o1 is F.lag else F.lag)(v, 1).over(w), v))
            .when(o2(flag, 2).over(w).isNull(), o1(v, 1).over(w)).otherwise(F.lit(0)))
        return inner + edge(F.lag, F.lag) + edge(F.lead, F.lead) >= 3
    return Step([{out or flag: stage}], 2, 2)


def ffill(col: str, n: int, out: str | None = None) -> Step:
    """Carry the last value forward over at most `n` rows."""
    return Step([{out or col: lambda w: F.coalesce(F.col(col), F.last(col, ignorenulls=True).over(w.rowsBetween(-n, -1)))}], n, 0)


def sustained(flag: str, n: int, out: str | None = None) -> Step:
    """Keep only True rows that belong to a run of at least `n`."""
    f, hole = F.col("frame"), F.when(~F.col(flag), F.col("frame"))

    def stage(w):
        b, a = w.rowsBetween(-(n - 1), -1), w.rowsBetween(1, n - 1)
        nb = F.coalesce(f - F.last(hole, ignorenulls=True).over(b) - 1, F.count("*").over(b))
        na = F.coalesce(F.first(hole, ignorenulls=True).over(a) - f - 1, F.count("*").over(a))
        return F.col(flag) & (nb + na + 1 >= n)
    return Step([{out or flag: stage}], n - 1, n - 1) if n > 1 else Step([{out or flag: lambda w: F.col(flag)}], 0, 0)


def gradient(col: str, out: str, dt: float) -> Step:
    """Central difference, one-sided at series ends."""
    def stage(w):
        p, n = F.lag(col).over(w), F.lead(col).over(w)
        first, last = F.lag("frame").over(w).isNull(), F.lead("frame").over(w).isNull()
        return F.when(first, (n - F.col(col)) / dt).when(last, (F.col(col) - p) / dt).otherwise((n - p) / (2 * dt))
    return Step([{out: stage}], 1, 1)


def shifted(out: str, col: str, k: int) -> Step:
    """Value `k` rows ahead (negative: behind)."""
    return Step([{out: lambda w: F.lead(col, k).over(w) if k > 0 else F.lag(col, -k).over(w)}], max(-k, 0), max(k, 0))
