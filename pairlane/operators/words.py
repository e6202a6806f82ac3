"""Vocabulary of movement words: imputation, scaling, k-means, charts."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from .ordered import quantiles


def medians(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Column medians of the whole table (exact, spread over tasks); one number per column reaches the driver."""
    lng = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).alias("v")) for c in cols])).alias("s")).select("s.m", "s.v")
    got = {x["m"]: x["med"] for x in quantiles(lng, ["m"], "v", {"med": 0.5}, split=True).select("m", "med").collect()}
    return {c: got.get(c) for c in cols}


def impute(df, cols, med) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(med[c])) for c in cols})


def zscore_fit(df, cols) -> dict[str, tuple[float, float]]:
    row = df.agg(*[e for c in cols for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def zscore(df, cols, fit) -> DataFrame:
    return df.withColumns({f"z_{c}": (F.col(c) - fit[c][0]) / (fit[c][1] or 1.0) for c in cols})


def fit_words(z: DataFrame, cols, k: int, n_init: int = 10, seed: int = 0):
    """Best of `n_init` k-means runs by cost; centres are ordered so that labels do not depend on the run.
    Returns (model, rank of each raw label)."""
    v = z.select(array_to_vector(F.array(*[F.col(f"z_{c}") for c in cols])).alias("features")).persist()
    try:
        best = min((KMeans(k=k, seed=seed + i, maxIter=50).fit(v) for i in range(n_init)), key=lambda m: m.summary.trainingCost)
    finally:
        v.unpersist()
    order = sorted(range(len(best.clusterCenters())), key=lambda i: tuple(best.clusterCenters()[i]))
    rank = [order.index(i) for i in range(len(order))]
    return best, rank


def apply_words(z: DataFrame, cols, fitted) -> DataFrame:
    """Word of each row under a fitted vocabulary: the nearest centre as a native expression."""
    model, rank = fitted
    feats = [F.col(f"z_{c}") for c in cols]
    d = [F.struct(sum(((f - float(x)) * (f - float(x)) for f, x in zip(feats, c)), F.lit(0.0)).alias("d"), F.lit(rank[i]).alias("w")) for i, c in enumerate(model.clusterCenters())]
    return z.withColumn("word", F.array_min(F.array(*d))["w"])


def mds_chart(dist: DataFrame, key: str, n: int, dims: int = 3) -> DataFrame:
    """Classical MDS of one aggregated n x n distance table per key: key, point, c0, c1, c2.
    Input: key, i, j, d for i < j."""
    g = dist.groupBy(key).agg(F.collect_list(F.struct("i", "j", "d")).alias("s"))              # n (n - 1) / 2 entries, n fixed

    @F.pandas_udf("array<array<double>>")
    def chart(s: pd.Series) -> pd.Series:
        out = []
        for rows in s:
            D = np.zeros((n, n))
            for x in rows:
                D[x["i"], x["j"]] = D[x["j"], x["i"]] = x["d"]
            J = np.eye(n) - 1 / n
            w, v = np.linalg.eigh(-0.5 * J @ (D ** 2) @ J)
            o = np.argsort(w)[::-1][:dims]
            out.append((v[:, o] * np.sqrt(np.maximum(w[o], 0))).tolist())
        return pd.Series(out)
    return g.select(key, F.posexplode(chart("s")).alias("point", "p")).select(key, "point", *[F.col("p")[k].alias(f"c{k}") for k in range(dims)])
