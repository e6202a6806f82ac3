"""Suffix-array dedup: suffixes sorted by merges that compare through prefix hashes, marks on equal neighbours, removal of bytes."""
from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import drop_staged, mix, stage, stage_dropping

#: Bytes of an anchor gram; different contexts of one gram that go to one shard; suffixes sorted at once; bytes hashed at once.
GRAM, CROWD, SHARD, SLICE = 32, 512, 250_000, 1 << 20
#: Odd bases of the polynomials modulo 2^64: grams, then sorting.
GRAM_BASE, SORT_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_PLACES = 1 << 24


class Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, as far as they were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 16)
            row = np.full(size, self.base)
            row[0] = 1
            self.up = np.multiply.accumulate(row)
            row = np.full(size, self.inverse)
            row[0] = 1
            self.down = np.multiply.accumulate(row)
        return self.up, self.down


_GRAMS = Powers(GRAM_BASE)


def prefix_hashes(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Entry i is the polynomial of the first i bytes, lowest power first."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:len(data)], out=out[1:])
    return out


def gram_bytes(width: int) -> int:
    """A gram leaves at most 255 windows to one anchor, whose places fit a byte each."""
    return min(width, max(GRAM, width - 254))


def places(text: bytes, width: int, cut: int = SLICE):
    """Gram hash, place and windows (first, number) of the anchors of all windows of `width` bytes, slice by slice.

    A window's anchor is its gram of smallest hash (the last of equals), so equal windows have the same anchor at the
    same distance, and each window belongs to exactly one row."""
    gram = gram_bytes(width)
    span = width - gram + 1
    for start in range(0, max(len(text) - width + 1, 0), cut):
        data = np.frombuffer(text, np.uint8, min(len(text) - start, cut + width - 1), start)
        up, down = _GRAMS.to(len(data))
        p = prefix_hashes(data, up)
        g = mix((p[gram:] - p[:-gram]) * down[:len(data) - gram + 1])
        low = (g & ~np.uint64(_PLACES - 1)) | (np.uint64(_PLACES - 1) - np.arange(len(g), dtype=np.uint64))     # hash above, place below
        n, run = len(data) - width + 1, 1
        while 2 * run <= span:
            low = np.minimum(low[:-run], low[run:])
            run *= 2
        at = _PLACES - 1 - (np.minimum(low[:n], low[span - run:span - run + n]) & np.uint64(_PLACES - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        yield g[at[first]].view(np.int64), at[first] + start, first + start, np.diff(np.append(first, n))


def _extension(p, q, a, b, width: int) -> np.ndarray:
    """Longest common extension of the suffixes at a and b, at most `width`: binary search for the longest equal prefix hash."""
    got, pa, pb, qa, qb = np.zeros(len(a), np.int64), p[a], p[b], q[a], q[b]
    step = 1 << (width.bit_length() - 1)
    while step:
        m = np.minimum(got + step, width)
        same = (p[a + m] - pa) * qa == (p[b + m] - pb) * qb
        got = np.where(same & (got + step <= width), m, got)
        step >>= 1
    return got


def merge_sorted(data: np.ndarray, suffixes: np.ndarray, first: np.ndarray, last: np.ndarray, width: int, base: int | None = None) -> np.ndarray:
    """The suffixes of each bucket [first, last) in order of their first `width` bytes: mergesort from runs of one up, all
    merges of a level at once.  A suffix finds its place among the other run's by binary search, each comparison
    being a common extension found in the prefix hashes and the one byte after it."""
    n = len(data)
    up = Powers(base or SORT_BASE).to(n)[0]
    p, q, order, run = prefix_hashes(data, up), up[n::-1], suffixes.copy(), 1
    here = np.arange(len(order))
    while True:
        start = first[here] + (here - first[here]) // (2 * run) * 2 * run
        middle, end = np.minimum(start + run, last[here]), np.minimum(start + 2 * run, last[here])
        busy = last[here] - first[here] > run
        if not busy.any():
            return order
        here, start, middle, end = here[busy], start[busy], middle[busy], end[busy]
        left, mine = here < middle, order[here]
        lo, hi = np.where(left, middle, start), np.where(left, end, middle)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            m = (lo[open_] + hi[open_]) >> 1
            a, b = order[m], mine[open_]
            same = _extension(p, q, a, b, width)
            whole, at = same >= width, np.minimum(same, width - 1)
            on = np.where(whole, ~left[open_], data[a + at] < data[b + at])
            lo[open_] = np.where(on, m + 1, lo[open_])
            hi[open_] = np.where(on, hi[open_], m)
            open_ = open_[lo[open_] < hi[open_]]
        order[here + lo - middle] = mine                   # its place in its own run and its rank in the other
        run *= 2


def equal_neighbours(data: np.ndarray, order: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, bool]:
    """Which suffixes equal the one before them in their bucket over `width` bytes, from the bytes themselves, and whether the order is
    right.  Neighbours in order make the whole order right, so this check finds every wrong step a hash collision made."""
    padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    word = np.zeros(len(data) + 1, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j:j + len(word)]
    equal = np.zeros(len(order), bool)
    at = 1 + np.flatnonzero(first[1:] == first[:-1])
    a, b = order[at - 1], order[at]
    for j in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        x, y = word[a + j], word[b + j]
        if (x > y).any():
            return equal, False
        go = x == y
        at, a, b = at[go], a[go], b[go]
    equal[at] = True
    return equal, True


def repeated(pieces: list[bytes], group: np.ndarray, anchor: np.ndarray, n: np.ndarray, width: int, base: int | None = None) -> list[np.ndarray]:
    """For each piece, which of its windows occur in another piece of its group too.  Piece i has n[i] windows and its anchor at byte
    anchor[i]; windows with anchors at different distances cannot be equal, so group and distance name a bucket."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    data = np.frombuffer(b"".join(pieces), np.uint8)
    of = np.repeat(np.arange(len(pieces)), n)
    begin = np.cumsum(n) - n
    within = np.arange(len(of)) - begin[of]
    start = (np.cumsum(size) - size)[of] + within
    key = group[of] * 256 + anchor[of] - within
    by = np.argsort(key, kind="stable")
    sizes = np.diff(np.append(np.flatnonzero(np.append(True, np.diff(key[by]) != 0)), len(by)))
    by = by[np.repeat(sizes > 1, sizes)]
    sizes = sizes[sizes > 1]
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    last = first + np.repeat(sizes, sizes)
    window_at = np.zeros(len(data), np.int64)
    window_at[start] = np.arange(len(of))
    order = merge_sorted(data, start[by], first, last, width, base)
    equal, right = equal_neighbours(data, order, first, width)
    if not right:                                          # a collision misled a merge: this shard again, by its bytes
        raw = data.tobytes()
        order = np.array([s for _, _, s in sorted((f, raw[s:s + width], s) for f, s in zip(first.tolist(), start[by].tolist()))], np.int64)
        equal, _ = equal_neighbours(data, order, first, width)
    marks = np.zeros(len(of), bool)
    hit = np.flatnonzero(equal)
    marks[window_at[order[np.union1d(hit, hit - 1)]]] = True
    return np.split(marks, begin[1:])


def _text(t) -> bytes:
    return b"" if t is None else t.encode("utf-8", "surrogatepass")


_PIECE = "r long, g long, k long, solo boolean, lo short, hi short, anchor short, skip short, n short, piece binary"
_PIECE_COLUMNS = [c.split()[0] for c in _PIECE.split(", ")]
_SHARD_COLUMNS = ["r", "g", "k", "solo", "anchor", "skip", "n", "piece"]
_BITS = "g long, k long, skip short, n short, bits binary"


def _sort_shards(width: int):
    def shards(frames):
        held, suffixes, last = [], 0, None
        for pdf in frames:
            for row in zip(*(pdf[c].tolist() for c in _SHARD_COLUMNS)):
                if row[0] != last and suffixes >= SHARD:
                    yield sort_one(held)
                    held, suffixes = [], 0
                last = row[0]
                held.append(row)
                suffixes += row[6]
        if held:
            yield sort_one(held)

    def sort_one(rows):
        r, g, k, solo, anchor, skip, n, pieces = zip(*rows)
        marks = repeated(list(pieces), np.unique(np.array(r), return_inverse=True)[1], np.array(anchor, np.int64), np.array(n, np.int64), width)
        out = [(g[i], k[i], skip[i], n[i], np.packbits(m).tobytes()) for i, m in enumerate(marks) if solo[i] and m.any()]
        return pd.DataFrame(out, columns=["g", "k", "skip", "n", "bits"])

    return shards


def _split(width: int):
    """Halve the range of distances lo .. hi of each piece's windows to their anchor.  All windows of a half share a longer core around
    the anchor, whose hash is the new route: windows that are equal still meet, and the crowd around one gram parts."""
    def halves(frames):
        for pdf in frames:
            out = []
            for g, k, solo, lo, hi, anchor, skip, n, piece in zip(*(pdf[c].tolist() for c in _PIECE_COLUMNS[1:])):
                half = (lo + hi) // 2
                for a, b in ((lo, half), (half + 1, hi)):
                    i, j = max(0, anchor - b), min(n - 1, anchor - a)
                    if i <= j:
                        cut, at = piece[i:j + width], anchor - i
                        route = xxhash.xxh3_64_intdigest(cut[at - a:at - b + width], seed=a * 256 + b)
                        out.append((route - (1 << 64) if route >> 63 else route, g, k, solo, a, b, at, skip + i, j - i + 1, cut))
            yield pd.DataFrame(out, columns=_PIECE_COLUMNS)

    return halves


def repeated_windows(docs: DataFrame, width: int) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, first, n, bits: of the n windows from byte `first` on, those whose bit is set start elsewhere too (bits null: all).

    `docs` has unique keys doc_id.  Count the anchor grams of all windows; keep the places of repeated grams as (gram, context hash,
    document, place), no texts; collapse equal contexts to one with a count, whose windows all repeat if it is above one.  Only where a gram has
    different contexts are bytes needed: each such context is cut once out of one document that has it, goes to the shard of its gram, and there its
    suffixes are sorted.  A gram with more than CROWD contexts is parted first (`_split`); parts that are equal then become one, and all windows
    of theirs repeat.  Single windows of one route are equal, so the parting ends.  Second: staged tables that the first reads.
    """
    slice_bytes = SLICE

    def grams(frames):
        for pdf in frames:
            parts = [g for t in pdf.text for g, *_ in places(_text(t), width, slice_bytes)]
            g, n = np.unique(np.concatenate(parts) if parts else np.empty(0, np.int64), return_counts=True)
            yield pd.DataFrame({"g": g, "c": n})

    def rows(frames):
        for pdf in frames:
            out = []
            for d, t in zip(pdf.doc_id, pdf.text):
                raw = _text(t)
                for g, at, first, n in places(raw, width, slice_bytes):
                    k = np.fromiter((xxhash.xxh3_64_intdigest(raw[f:f + c + width - 1]) for f, c in zip(first.tolist(), n.tolist())), np.uint64, len(g)).view(np.int64)
                    out.append(pd.DataFrame({"g": g, "k": k, "doc_id": d, "place": (first << 16) | (n << 8) | (at - first)}))
            if out:
                yield pd.concat(out)

    text = docs.select("doc_id", "text")
    seen = stage(text.select("text").mapInPandas(grams, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).where("c > 1").select("g"), "grams")
    spots = stage_dropping(text.mapInPandas(rows, "g long, k long, doc_id long, place long").join(seen, "g", "left_semi"), "places", seen)
    contexts = stage(spots.groupBy("g", "k").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "place")).alias("at")), "contexts")
    mixed = contexts.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    wanted = contexts.join(mixed, "g").groupBy("at.doc_id").agg(F.collect_list(F.struct("g", "k", (F.col("c") == 1).alias("solo"), F.col("at.place").alias("place"), (F.col("n") > CROWD).alias("crowded"))).alias("wanted"))

    def cut(frames):
        for pdf in frames:
            out = []
            for t, wanted in zip(pdf.text, pdf.wanted):
                raw = _text(t)
                for w in wanted:
                    first, n, anchor = w["place"] >> 16, w["place"] >> 8 & 255, w["place"] & 255
                    out.append((w["g"], w["g"], w["k"], w["solo"], 0, width - gram_bytes(width), anchor, 0, n, raw[first:first + n + width - 1], w["crowded"]))
                    if len(out) >= 20_000:
                        yield pd.DataFrame(out, columns=[*_PIECE_COLUMNS, "crowded"])
                        out = []
            yield pd.DataFrame(out, columns=[*_PIECE_COLUMNS, "crowded"])

    pieces = stage(text.join(wanted, "doc_id").select("text", "wanted").mapInPandas(cut, _PIECE + ", crowded boolean"), "pieces")
    calm, crowded, used, whole = [pieces.where("NOT crowded").drop("crowded")], pieces.where("crowded").drop("crowded"), [pieces], []
    while not crowded.isEmpty():
        parted = stage(crowded.mapInPandas(_split(width), _PIECE), "parted")
        merged = stage(parted.groupBy("r", "piece").agg(F.count("*").alias("c"), F.min(F.struct(*(c for c in _PIECE_COLUMNS if c not in ("r", "piece")))).alias("x")), "merged")
        whole.append(parted.where("solo").join(merged.where("c > 1").select("r", "piece"), ["r", "piece"], "left_semi"))
        rest = merged.select("r", "piece", "c", "x.*").withColumn("solo", F.col("solo") & (F.col("c") == 1)).select(_PIECE_COLUMNS)
        crowds = rest.groupBy("r").agg(F.count("*").alias("n")).where(f"n > {CROWD}").select("r")
        calm.append(rest.join(crowds, "r", "left_anti").select(_PIECE_COLUMNS))
        crowded = stage(rest.join(crowds, "r", "left_semi").select(_PIECE_COLUMNS), "crowded")
        used += [parted, merged, crowded]
    shards = calm[0]
    for c in calm[1:]:
        shards = shards.unionByName(c)
    bits = shards.repartition("r").sortWithinPartitions("r").mapInPandas(_sort_shards(width), _BITS)
    for found in whole:
        bits = bits.unionByName(found.select("g", "k", "skip", "n", F.lit(None).cast("binary").alias("bits")))
    bits = stage_dropping(bits, "bits", *used)
    all_of = contexts.where("c > 1").select("g", "k", F.lit(None).cast("short").alias("skip"), F.lit(None).cast("short").alias("n"), F.lit(None).cast("binary").alias("bits"))
    first, n = F.shiftrightunsigned("place", 16), F.shiftrightunsigned("place", 8).bitwiseAND(F.lit(255))
    found = spots.join(bits.unionByName(all_of), ["g", "k"])
    return found.select("doc_id", (first + F.coalesce("skip", F.lit(0))).alias("first"), F.coalesce("n", n).cast("int").alias("n"), "bits"), [spots, contexts, bits]


def covered(size: int, marks, width: int) -> np.ndarray:
    """Which of `size` bytes lie in a window whose mark is set."""
    starts = np.zeros(size, bool)
    for m in marks:
        f, n = m["first"], m["n"]
        starts[f:f + n] |= True if m["bits"] is None else np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=n).astype(bool)
    sums = np.concatenate([np.zeros(width, np.int64), np.cumsum(starts)])
    return sums[width:] > sums[:-width]


def _dedup(docs: DataFrame, width: int) -> DataFrame:
    found, used = repeated_windows(docs, width)
    marks = stage_dropping(found.groupBy("doc_id").agg(F.collect_list(F.struct("first", "n", "bits")).alias("marks")), "marks", *used)

    def remove(frames):
        for pdf in frames:
            out = []
            for d, t, marks in zip(pdf.doc_id, pdf.text, pdf.marks):
                raw = _text(t)
                if marks is None or not len(marks):
                    out.append((d, len(raw), 0, 0, raw))
                    continue
                gone = covered(len(raw), marks, width)
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                out.append((d, len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.select("doc_id", "text").join(marks, "doc_id", "left").mapInPandas(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def dedup_bytes(docs: DataFrame, width: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes left, joined) for every row of `docs`.

    Texts are UTF-8 bytes.  A byte goes when a string of `width` bytes (8 or more) that covers it also starts at any other place of the table,
    its own text included; all strings are judged on the input.  Null or empty text has no bytes.  Where ids are null or repeated, rows are
    numbered first, so each row is a text of its own and repeated rows remove each other.  Null ids are kept, an empty
    table gives no rows, columns other than doc_id and text are not read.
    """
    if width < 8:
        raise ValueError("width must be 8 bytes or more")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    twice = rows.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 OR doc_id IS NULL")
    if twice.isEmpty():
        return _dedup(rows, width)
    numbered = stage(rows.select(F.col("doc_id").alias("_id"), F.monotonically_increasing_id().alias("doc_id"), "text"), "numbered")
    done = _dedup(numbered.select("doc_id", "text"), width)
    return done.join(numbered.select("doc_id", "_id"), "doc_id").select(F.col("_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
