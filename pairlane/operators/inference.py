"""Rank tests, effect sizes and small exact tests; everything that grows is a Spark aggregate."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .ordered import average_ranks


def rank_sum(df: DataFrame, keys: list[str], value: str, group: str, a, b, split=True) -> DataFrame:
    """Mann-Whitney U of group a over b from tie-averaged ranks: keys, n_a, n_b, u, z (tie-corrected), delta."""
    d = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    side = d.groupBy(*keys, value).agg(F.count_if(F.col(group) == a).alias("ca"), F.count_if(F.col(group) == b).alias("cb"))
    rk = average_ranks(d, keys, value, "rank", split=split)
    j = side.join(rk, [*keys, value])
    t = F.col("ties").cast("double")
    g = j.groupBy(*keys).agg(F.sum("ca").alias("n_a"), F.sum("cb").alias("n_b"), F.sum(F.col("ca") * F.col("rank")).alias("_r"), F.sum(t * t * t - t).alias("_t"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    u = F.col("_r") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * (n + 1 - F.col("_t") / (n * (n - 1))))
    ok = (na > 0) & (nb > 0)
    return g.select(*keys, "n_a", "n_b", F.when(ok, u).alias("u"), F.when(ok & (sd > 0), (u - na * nb / 2) / sd).alias("z"), F.when(ok, 2 * u / (na * nb) - 1).alias("delta"))


def signed_rank(df: DataFrame, keys: list[str], diff: str) -> DataFrame:
    """Wilcoxon signed ranks without zeros: keys, n, n_pos, n_neg, w_plus, w_minus."""
    d = df.where(F.col(diff).isNotNull() & (F.col(diff) != 0)).withColumn("_a", F.abs(diff))
    rk = average_ranks(d, keys, "_a", "rank")
    s = d.groupBy(*keys, "_a").agg(F.count_if(F.col(diff) > 0).alias("p"), F.count_if(F.col(diff) < 0).alias("m"))
    g = s.join(rk, [*keys, "_a"])
    return g.groupBy(*keys).agg(F.sum(F.col("p") + F.col("m")).alias("n"), F.sum("p").alias("n_pos"), F.sum("m").alias("n_neg"), F.sum(F.col("p") * F.col("rank")).alias("w_plus"), F.sum(F.col("m") * F.col("rank")).alias("w_minus"))


def spearman(df: DataFrame, keys: list[str], a: str, b: str, min_n: int) -> DataFrame:
    """Spearman r over rows where both are present: keys, n, r."""
    from .lags import corr_of, moments
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b)
    ra = average_ranks(d, keys, a, "_ra").select(*keys, a, "_ra")
    rb = average_ranks(d, keys, b, "_rb").select(*keys, b, "_rb")
    m = d.join(ra, [*keys, a]).join(rb, [*keys, b]).groupBy(*keys).agg(*moments("_ra", "_rb"))
    return m.select(*keys, "n", corr_of(min_n).alias("r"))


def fe_ols(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Within-group OLS slope of y on x with cluster-robust standard error; groups without variation in x
    drop out.  Closed form from per-group sums: a second pass only for the cluster scores."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = d.groupBy(group).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.min(x).alias("_lo"), F.max(x).alias("_hi")).where(F.col("_lo") < F.col("_hi"))
    d = d.join(g, group).select(group, (F.col(x) - F.col("_mx")).alias("xd"), (F.col(y) - F.col("_my")).alias("yd"), F.col(y).alias("y"))
    c = d.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col("xd") * F.col("yd")).alias("xy"), F.sum(F.col("xd") * F.col("xd")).alias("xx"), F.sum("y").alias("sy"))
    t = c.agg(F.sum("n").alias("n_obs"), F.count("*").alias("n_groups"), F.sum("xy").alias("sxy"), F.sum("xx").alias("sxx"), (F.sum("sy") / F.sum("n")).alias("grand_mean"),
              F.sum(F.col("xy") * F.col("xy")).alias("s1"), F.sum(F.col("xy") * F.col("xx")).alias("s2"), F.sum(F.col("xx") * F.col("xx")).alias("s3"))
    b = F.col("sxy") / F.col("sxx")
    # sum over clusters of (sum x e)^2 with e = y - b x
    meat = F.col("s1") - 2 * b * F.col("s2") + b * b * F.col("s3")
    G = F.col("n_groups")
    return t.select("n_obs", "n_groups", "grand_mean", b.alias("beta"), (F.sqrt(meat * G / (G - 1)) / F.col("sxx")).alias("se"))


def _ln_choose(n, k):
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


@F.pandas_udf(T.DoubleType())
def binomial_two_sided(k: pd.Series, n: pd.Series) -> pd.Series:
    """Exact two-sided p of k successes in n fair trials (one aggregated row per test)."""
    out = []
    for a, m in zip(k, n):
        lo = int(min(a, m - a))
        # walk down from lo until the terms no longer matter
        term, tot, i = math.exp(_ln_choose(m, lo) - m * math.log(2)), 0.0, lo
        while i >= 0 and term > 0:
            tot += term
            if term < tot * 1e-17:
                break
            term *= i / (m - i + 1)
            i -= 1
        out.append(1.0 if 2 * lo == m else min(1.0, 2 * tot))
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def fisher_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """One-sided exact p of a 2x2 table (more in cell a than expected)."""
    out = []
    for w, x, y, z in zip(a, b, c, d):
        n1, n2, k = w + x, y + z, w + y
        lnp = lambda i: _ln_choose(n1, i) + _ln_choose(n2, k - i) - _ln_choose(n1 + n2, k)
        term, tot, i = math.exp(lnp(w)), 0.0, int(w)
        while i <= min(n1, k):
            tot += term
            nxt = term * (n1 - i) * (k - i) / ((i + 1) * (n2 - k + i + 1)) if n2 - k + i + 1 > 0 else 0.0
            if nxt < term and nxt < tot * 1e-17:
                break
            term, i = nxt, i + 1
        out.append(min(1.0, tot))
    return pd.Series(out)


@F.pandas_udf(T.StructType().add("more", T.DoubleType()).add("less", T.DoubleType()))
def alternation_p(n: pd.Series, k: pd.Series, sw: pd.Series) -> pd.DataFrame:
    """Exact P(switches >= sw) and P(switches <= sw) over all orderings of k of one kind among n."""
    more, less = [], []
    for a, b, s in zip(n, k, sw):
        m = a - b
        if b == 0 or m == 0 or a < 3:
            more.append(None)
            less.append(None)
            continue
        runs = np.arange(2, 2 * min(b, m) + 2)
        ln = []
        for r in runs:
            i = r // 2
            if r % 2 == 0:
                ln.append(math.log(2) + _ln_choose(b - 1, i - 1) + _ln_choose(m - 1, i - 1) if i <= min(b, m) else -math.inf)
            else:
                t = [_ln_choose(b - 1, i) + _ln_choose(m - 1, i - 1)] if i <= b - 1 and i <= m else []
                t += [_ln_choose(b - 1, i - 1) + _ln_choose(m - 1, i)] if i <= m - 1 and i <= b else []
                ln.append(np.logaddexp.reduce(t) if t else -math.inf)
        p = np.exp(np.array(ln) - _ln_choose(a, b))
        more.append(float(min(1.0, p[runs - 1 >= s].sum())))
        less.append(float(min(1.0, p[runs - 1 <= s].sum())))
    return pd.DataFrame({"more": pd.array(more, "Float64"), "less": pd.array(less, "Float64")})


@F.pandas_udf(T.StructType().add("e", T.DoubleType()).add("v", T.DoubleType()))
def max_side_moments(n: pd.Series) -> pd.DataFrame:
    """Mean and variance of max(X, n - X) for X ~ Binomial(n, 1/2)."""
    e, v = [], []
    for m in n:
        m = int(m)
        j = np.arange(m + 1)
        p = np.exp(np.array([_ln_choose(m, x) for x in j]) - m * math.log(2))
        y = np.maximum(j, m - j)
        e.append(float((p * y).sum()))
        v.append(float((p * y * y).sum() - (p * y).sum() ** 2))
    return pd.DataFrame({"e": e, "v": v})


def fit_camera_rounds(df: DataFrame, rounds: int = 8) -> DataFrame:
    """Which of two image tracks belongs to which of two 3-D bodies, frame by frame.  Alternates a
    projective camera per clip (smallest eigenvector of the 12 x 12 normal matrix, summed by Spark) with
    the cheaper of the two assignments.  Input: clip, frame, l (x, y, z), f (x, y, z), p (x, y), q (x, y).  `converged` says whether
    the last round changed no assignment of the clip; rounds end early when it changed none at all."""
    from .ordered import cut_lineage
    idx = [(i, j) for i in range(12) for j in range(i, 12)]

    def rows(X, u):
        one, zero = F.lit(1.0), F.lit(0.0)
        x = [X["x"], X["y"], X["z"], one]
        return [F.array(*x, zero, zero, zero, zero, *[-u["x"] * c for c in x]), F.array(zero, zero, zero, zero, *x, *[-u["y"] * c for c in x])]

    @F.pandas_udf("array<double>")
    def smallest(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            m = np.zeros((12, 12))
            for (i, j), x in zip(idx, v):
                m[i, j] = m[j, i] = x
            out.append(np.linalg.eigh(m)[1][:, 0].tolist())
        return pd.Series(out)

    cur = cut_lineage(df.withColumn("lead", F.lit(True)))
    for _ in range(rounds):
        L, O = F.when(F.col("lead"), F.col("p")).otherwise(F.col("q")), F.when(F.col("lead"), F.col("q")).otherwise(F.col("p"))
        d = cur.select("clip", "l", "f", L.alias("ul"), O.alias("uf"))
        d = d.select("clip", F.explode(F.array(*rows(F.col("l"), F.col("ul")), *rows(F.col("f"), F.col("uf")))).alias("r"))
        cam = d.groupBy("clip").agg(F.array(*[F.sum(F.col("r")[i] * F.col("r")[j]) for i, j in idx]).alias("s")).select("clip", smallest("s").alias("cam"))

        def err(X, u):
            pr = [sum((F.col("cam")[4 * k + i] * c for i, c in enumerate([X["x"], X["y"], X["z"], F.lit(1.0)])), F.lit(0.0)) for k in range(3)]
            w = F.nullif(pr[2], F.lit(0.0))
            return F.sqrt((pr[0] / w - u["x"]) ** 2 + (pr[1] / w - u["y"]) ** 2)
        l, f, p, q = (F.col(c) for c in "lfpq")
        e = cur.join(cam, "clip").select("clip", "frame", "l", "f", "p", "q", "lead", (err(l, p) + err(f, q)).alias("a"), (err(l, q) + err(f, p)).alias("b"))
        nxt = cut_lineage(e.withColumn("new", F.coalesce(F.col("a") <= F.col("b"), F.lit(True))))
        still = nxt.groupBy("clip").agg(F.bool_and(F.col("new") == F.col("lead")).alias("converged"))
        out = nxt.join(still, "clip").select("clip", "frame", F.col("new").alias("lead"), (F.least("a", "b") / 2).alias("res"), (F.greatest("a", "b") / 2).alias("res_other"), "converged")
        if nxt.where(F.col("new") != F.col("lead")).isEmpty():
            return out
        cur = nxt.select("clip", "frame", "l", "f", "p", "q", F.col("new").alias("lead"))
    return out
