"""Packing by non-negative least squares over combinations of piece lengths."""
from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import stage
from .tokenizing import word_tokenizer

GRAIN = 16
GROUP_ROWS = 500


def combinations(bins: int) -> list[dict[int, int]]:
    """Shallow combinations {length: repeats} that exactly fill a window of `bins` units: one length repeated, one
    length repeated plus the rest, two repeated lengths, and three different ones."""
    found: dict[tuple, dict[int, int]] = {}

    def keep(*parts):
        c = Counter()
        for length, times in parts:
            c[length] += times
        found.setdefault(tuple(sorted(c.items())), dict(c))

    for a in range(1, bins + 1):
        for m in range(1, bins // a + 1):
            rest = bins - m * a
            keep((a, m), *([(rest, 1)] if rest else []))
            for n in (2, 3, 4, 6, 8, 12, 16):
                if rest and rest % n == 0:
                    keep((a, m), (rest // n, n))
        for b in range(a + 1, bins):
            if bins - a - b > b:
                keep((a, 1), (b, 1), (bins - a - b, 1))
    return [found[k] for k in sorted(found)]


def solve_nnls(patterns: list[dict[int, int]], histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeats x >= 0 that minimise |A x - h|, A holding how often each pattern takes each length; accelerated
    projected gradient from zero, on counts scaled by their largest."""
    scale = float(histogram.max())
    if not scale:
        return np.zeros(len(patterns))
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.fromiter((k - 1 for p in patterns for k in p), np.int64)
    val = np.fromiter((v for p in patterns for v in p.values()), np.float64)
    n, h = len(patterns), histogram / scale
    times = lambda x: np.bincount(row, val * x[col], len(h))
    back = lambda r: np.bincount(col, val * r[row], n)
    v = np.ones(n)
    for _ in range(20):
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(times(y) - h) / (norm * 1.02))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x * scale


def plan(histogram: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Patterns with whole repeats that use up a histogram of piece lengths (in units) exactly.

    The least-squares repeats are rounded down and never take more of a length than is left.  What remains is packed
    greedily on counts: the longest length left first, then again and again the longest that still fits, and the
    pattern found is repeated as often as the counts allow.  The size of the plan depends on the number of
    lengths, not of pieces.
    """
    bins, left, out = len(histogram), histogram.astype(np.int64).copy(), []
    patterns = combinations(bins)
    x = solve_nnls(patterns, histogram.astype(np.float64))
    for i in np.argsort(-x, kind="stable"):
        times = min([int(x[i])] + [int(left[k - 1]) // v for k, v in patterns[i].items()])
        if times <= 0:
            continue
        for k, v in patterns[i].items():
            left[k - 1] -= times * v
        out.append((patterns[i], times))
    while left.any():
        room, take = bins, Counter()
        while room:
            fits = np.flatnonzero(left[:room] > 0)
            fits = next((k + 1 for k in fits[::-1] if left[k] > take[k + 1]), 0)
            if not fits:
                break
            n = min(room // fits, int(left[fits - 1]) - take[fits])
            take[fits] += n
            room -= n * fits
        times = min(int(left[k - 1]) // v for k, v in take.items())
        for k, v in take.items():
            left[k - 1] -= times * v
        out.append((dict(take), times))
    return out


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, copy of each piece: a document's ids and the end id, cut every `window`
    ids.  Null and empty texts are the end id alone."""

    def cut(frames):
        encode = word_tokenizer(tokenizer)
        tail = np.array([end_id], "<u4").tobytes()
        for pdf in frames:
            rows = []
            for d, t in zip(pdf.doc_id, pdf.text):
                raw = encode.ids(t) + tail
                n = len(raw) // 4
                for s in range(0, n, window):
                    part = raw[4 * s:4 * (s + window)]
                    rows.append((None if pd.isna(d) else int(d), s, len(part) // 4, zlib.crc32(part), n))
            f = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield f.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, grain: int = GRAIN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every row of `docs`.

    Pieces of a whole window make a sequence each; all others are packed by `plan` on their lengths in units of `grain`
    ids, rounded up, so that a full pattern pads less than `grain` ids a piece.  The histogram (window / grain
    numbers) is all the driver sees.  Each piece takes its number within its length from counts of hashed groups
    of at most about GROUP_ROWS pieces, and with that number its slot in the plan; equal lengths, however many,
    are thus numbered in parallel.  Which of two equal pieces takes which slot is decided by doc_id, start and checksum.  Null
    text counts as empty, repeated rows are packed each for itself, an empty table gives no rows.
    """
    bins = window // grain
    cut = stage(pieces(docs, tokenizer, window, end_id), "pieces").withColumn("bin", F.ceil(F.col("length") / grain).cast("int"))
    whole = F.col("length") == window
    cut = cut.withColumn("bin", F.when(whole, bins + 1).otherwise(F.col("bin")))
    counts = {r.bin: r.n for r in cut.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    histogram = np.array([counts.get(b, 0) for b in range(1, bins + 1)], np.int64)
    steps = [({bins + 1: 1}, counts[bins + 1])] if bins + 1 in counts else []
    steps += plan(histogram) if histogram.any() else []
    slots: dict[int, list[tuple[int, int, int, int]]] = {}          # length: (first number, repeats, first sequence, place in it)
    used: Counter = Counter()
    sequence = 0
    for pattern, times in steps:
        for k, v in sorted(pattern.items(), reverse=True):
            slots.setdefault(k, []).append((used[k], v, sequence, times))
            used[k] += v * times
        sequence += times

    groups = max(1, -(-max(counts.values(), default=0) // GROUP_ROWS))
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int")
    cut = cut.withColumn("_g", group)
    sizes = cut.groupBy("bin", "_g").agg(F.count("*").alias("n"))
    before = sizes.withColumn("_b", F.sum("n").over(W.partitionBy("bin").orderBy("_g").rowsBetween(W.unboundedPreceding, -1))).select("bin", "_g", F.coalesce("_b", F.lit(0)).alias("_b"))
    inside = F.row_number().over(W.partitionBy("bin", "_g").orderBy("doc_id", "start", "ids_crc32")) - 1
    numbered = cut.withColumn("_i", inside).join(before, ["bin", "_g"]).withColumn("_n", F.col("_i") + F.col("_b"))
    shared = docs.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in slots.items()})

    def place(frames):
        table = shared.value
        for pdf in frames:
            seq = np.empty(len(pdf), np.int64)
            for b, at in pdf.groupby("bin").indices.items():
                s, n = table[b], pdf._n.to_numpy()[at]
                j = np.searchsorted(s[:, 0], n, "right") - 1
                seq[at] = s[j, 2] + (n - s[j, 0]) // s[j, 1]
            pdf = pdf.assign(sequence_id=seq)
            yield pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]].astype({"doc_id": "Int64"})

    placed = numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "_n").mapInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    order = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))


def padding(length: int, window: int = 4096) -> int:
    """Ids of padding behind a sequence of this length: none at a power of two, else up to the window."""
    return 0 if length & (length - 1) == 0 else window - length
