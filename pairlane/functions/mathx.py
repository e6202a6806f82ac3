"""Scalar math as Column expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# fixed values: coefficients of Acklam's rational approximation of the normal quantile
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0)


def _poly(cs, x):
    e = F.lit(cs[0])
    for c in cs[1:]:
        e = e * x + F.lit(c)
    return e


def probit(p: Column) -> Column:
    """Standard normal quantile; relative error below 1.2e-9."""
    q = p - 0.5
    s = q * q
    tail = lambda t: _poly(_C, t) / _poly(_D, t)
    return (F.when(p < 0.02425, tail(F.sqrt(-2 * F.ln(p))))
            .when(p > 1 - 0.02425, -tail(F.sqrt(-2 * F.ln(1 - p))))
            .otherwise(_poly(_A, s) * q / _poly(_B, s)))


def probit_sql(p: str) -> str:
    def poly(cs, x):
        e = f"({cs[0]!r}::DOUBLE)"
        for c in cs[1:]:
            e = f"({e} * {x} + ({c!r}::DOUBLE))"
        return e
    tail = lambda t: f"{poly(_C, t)} / {poly(_D, t)}"
    lo, hi = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))"
    s = f"((({p}) - 0.5) * (({p}) - 0.5))"
    return (f"CASE WHEN ({p}) < 0.02425 THEN {tail(lo)} WHEN ({p}) > 1 - 0.02425 THEN -({tail(hi)}) "
            f"ELSE {poly(_A, s)} * (({p}) - 0.5) / {poly(_B, s)} END")


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal (rational approximation, absolute error below 7.5e-8)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    phi = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    up = phi * t * _poly((1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530), t)
    return F.when(z >= 0, up).otherwise(1 - up)


def wrap_deg(a: Column) -> Column:
    """Angle difference into [-180, 180)."""
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


def wrap_rad(a: Column) -> Column:
    return F.pmod(a + math.pi, F.lit(2 * math.pi)) - math.pi


def ln_factorial_sum(n: Column) -> Column:
    """ln n! as a sum over a sequence; n must be small (counts of a contingency table)."""
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(2).cast("long"), F.greatest(n.cast("long"), F.lit(2).cast("long"))), F.lit(0.0), lambda s, i: s + F.ln(i.cast("double"))))


def guarded_corr(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column, min_n: int = 2, eps: float = 1e-12) -> Column:
    """Pearson r from moment sums; NULL on too few pairs or no variance; clipped to [-1, 1]."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    r = (sxy - sx * sy / n) / F.sqrt(vx * vy)
    return F.when((n >= min_n) & (vx > eps) & (vy > eps), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
