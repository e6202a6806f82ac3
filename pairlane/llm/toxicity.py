"""Toxicity by non-negative positive-unlabelled learning on hashed word features."""
from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

LETTERS = re.compile(r"[^\W\d_]+")
DIMS = 1 << 18
MEMBERS = 3
#: Words whose features a worker remembers.
HELD_WORDS = 1 << 16


class WordFeatures(dict):
    """Feature numbers of a raw word: each of its letter runs, lower-cased, whole and by first 4, 5 and 6 letters."""

    def __missing__(self, raw: str) -> tuple[int, ...]:
        if len(self) >= HELD_WORDS:
            self.clear()
        names = set()
        for w in LETTERS.findall(raw.lower()):
            names.add(w)
            names.update(f"{w[:k]}*" for k in (4, 5, 6) if len(w) > k)
        got = self[raw] = tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % DIMS for x in names)
        return got


_WORDS = WordFeatures()   # one a worker process


def features(text: str | None, cache: WordFeatures) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text; none for null or no letters."""
    found: set[int] = set()
    for raw in set((text or "").split()):
        found.update(cache[raw])
    out = np.fromiter(found, np.int64, len(found))
    out.sort()
    return out


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id's decimal text leaves 0 modulo 5 (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class _Rows:
    """Sparse 0/1 rows, for products and gradients."""

    def __init__(self, lists: list[np.ndarray]):
        self.n = len(lists)
        self.size = np.fromiter(map(len, lists), np.int64, self.n)
        self.ids = np.concatenate(lists) if lists else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(self.n), self.size)

    def dot(self, w, b):
        return np.bincount(self.row, w[self.ids], self.n) + b

    def grad(self, g):
        return np.bincount(self.ids, g[self.row], DIMS), float(g.sum())


def lean(p: np.ndarray, u: np.ndarray, positives: int, unlabelled: int, weight: float = 3.0, least: float = 1.0) -> np.ndarray:
    """How much each feature leans to the positives, from its counts of texts among them (p) and the unlabelled (u): the log ratio of p, less
    its standard error, to what the share of the unlabelled would give, both raised by `weight` to mistrust small counts; 0 below `least` or in under 3 texts.
    Rare words that stand by toxic ones by chance thus stay out, many of which would add up in a long text."""
    r = np.log((p - np.sqrt(p) + weight) / (u * positives / max(1, unlabelled) + weight))
    return np.where((r >= least) & (p >= 3), r, 0.0)


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, start: np.ndarray, steps: int = 40, rate: float = 0.3, l2: float = 1e-3) -> np.ndarray:
    """Weights and bias (last) of a linear scorer that minimises the non-negative PU risk

        prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

    with the logistic loss and Adagrad steps over the whole sample.  Where the second part is negative, a step climbs it instead, which
    keeps the scorer from fitting the unlabelled positives as negatives; parts of the sample would be negative by chance
    half of the time and pull true positives down.  Rows hold only features with a start above 0 (`lean`); weights begin there and are drawn to it by `l2`.
    """
    w, b = start.astype(float), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return np.append(np.zeros(DIMS), b)
    p, u, used, gw, gb = _Rows(positive), _Rows(unlabelled), start > 0, np.full(DIMS, 1e-8), 1e-8
    for _ in range(steps):
        sp, su = _sigmoid(p.dot(w, b)), _sigmoid(u.dot(w, b))
        negative = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
        dp, du = prior * -sp / p.n, su / u.n                # of the negative part
        if negative >= 0:
            dp = dp + prior * (sp - 1) / p.n                 # and of the positive part
        else:
            dp, du = -dp, -du
        (a, ab), (c, cb) = p.grad(dp), u.grad(du)
        g, h = (a + c + l2 * (w - start)) * used, ab + cb
        gw += g * g
        gb += h * h
        w = w - rate * g / np.sqrt(gw)
        b -= rate * h / gb ** 0.5
    return np.append(w, b)


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 6_000, max_unlabelled: int = 24_000, members: int = MEMBERS) -> np.ndarray:
    """Weights of the mean of `members` linear scorers, each learnt in its own task without its own part of the sample.

    Learns from a documented bounded sample outside the held-out fold: at most `max_positive` rows labelled toxic and
    at most `max_unlabelled` rows of any kind, as the risk asks for, taken in the order of a hash of their id.  The class prior is the toxic share
    among the labelled rows of that fold.  Without positives every weight is zero.
    """
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = y.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    prior = min(max(((share.p or 0) + 1) / (share.n + 2), 1e-3), 0.5)
    place = F.xxhash64("doc_id", F.lit(17))
    fold = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    pos = y.where("toxic = 1").select("doc_id", F.lit(1).alias("y")).orderBy(place, "doc_id").limit(max_positive)
    unl = fold.select("doc_id", F.lit(0).alias("y")).distinct().orderBy(place, "doc_id").limit(max_unlabelled)
    sample = stage(pos.union(unl), "sample")

    def extract(frames):
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "y": pdf.y, "x": [features(t, _WORDS).astype("<i4").tobytes() for t in pdf.text]})

    rows = fold.select("doc_id", "text").join(sample, "doc_id").mapInPandas(extract, "doc_id long, y int, x binary")
    rows = stage(rows, "features")

    def count(frames):
        seen = np.zeros((2, DIMS), np.int64)
        for pdf in frames:
            for v, y in zip(pdf.x, pdf.y):
                seen[y, np.frombuffer(v, "<i4")] += 1
        f = np.flatnonzero(seen.any(0))
        yield pd.DataFrame({"f": f, "p": seen[1, f], "u": seen[0, f]})

    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    seen = rows.select("y", "x").mapInPandas(count, "f int, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where("p >= 3").collect()      # DIMS rows at most
    p, u = np.zeros(DIMS), np.zeros(DIMS)
    for r in seen:
        p[r.f], u[r.f] = r.p, r.u
    start = lean(p, u, sizes.get(1, 0), sizes.get(0, 0))

    def keep(frames):
        for pdf in frames:
            x = (np.frombuffer(v, "<i4") for v in pdf.x)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "y": pdf.y, "x": [v[start[v] > 0].tobytes() for v in x]})

    def fit(key, pdf):
        pdf = pdf.sort_values(["doc_id", "x"])
        pick = lambda k: [np.frombuffer(v, "<i4") for v, t in zip(pdf.x, pdf.y) if t == k]
        return pd.DataFrame({"w": [fit_nnpu(pick(1), pick(0), prior, start).astype("<f4").tobytes()]})

    part = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(members))
    parts = F.filter(F.sequence(F.lit(0), F.lit(members - 1)), lambda m: (m != part) | F.lit(members == 1))
    kept = rows.mapInPandas(keep, "doc_id long, y int, x binary").withColumn("member", F.explode(parts))
    got = [np.frombuffer(r.w, "<f4") for r in kept.groupBy("member").applyInPandas(fit, "w binary").collect()]
    return np.mean(got, axis=0) if got else np.zeros(DIMS + 1, np.float32)


def scores(docs: DataFrame, weights: np.ndarray, text: str = "text") -> Column:
    """Column of scores from 0 to 1 of whole texts; a text without letters, empty or null has the bias's score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))   # DIMS + 1 numbers, whatever the corpus

    def score(texts: pd.Series) -> pd.Series:
        w = shared.value
        return pd.Series([float(_sigmoid(w[features(t, _WORDS)].sum() + w[DIMS])) for t in texts], dtype="float64")

    return F.pandas_udf(score, "double")(F.col(text))


def score_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.  Only the text enters a score; repeated rows get
    equal scores, null ids are scored and never held out, an empty table gives no rows."""
    weights = train(docs, labels, **params)
    s = docs.select("doc_id", scores(docs, weights).alias("score"))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
