"""Substring dedup: suffix automata of reference shards, matching statistics, removal of long repeated spans."""
from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import WordHash, hashes, stage, windows, words_of

GRAM = 8
SHARD_WORDS = 100_000
HOT_CONTEXTS = 1_000
PLACES = 1 << 24
_WORDS = WordHash()


class SuffixAutomaton:
    """Suffix automaton of several word sequences, each with a weight (how often it occurs), which tells for any
    sequence how long its match ends at each word and how often a match of a wanted length occurs."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, seq: list[int], weight: int) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in seq:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                count[last] += weight
                continue
            if q is None:
                cur, p = len(nxt), last
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                count.append(0)
                while p != -1 and (q := nxt[p].get(c)) is None:
                    nxt[p][c] = cur
                    p = link[p]
                last, fresh = cur, True
            else:
                cur, p, fresh = -1, last, False
            if p != -1:
                if length[q] != length[p] + 1:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    link.append(link[q])
                    length.append(length[p] + 1)
                    count.append(0)
                    link[q] = clone
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    q = clone
                if fresh:
                    link[cur] = q
                else:
                    last = q
            count[last] += weight

    def close(self) -> None:
        """Add up how often each state's sequences end, longest states first."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def repeats(self, seq: list[int], width: int) -> int:
        """Bit i is set where the `width` words from place i on occur at least twice in the reference."""
        state, matched, bits = 0, 0, 0
        nxt, link, length, count = self.next, self.link, self.length, self.count
        for end, c in enumerate(seq):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            while state and length[link[state]] >= width:
                state = link[state]
                matched = length[state]
            if matched >= width and count[state] >= 2:
                bits |= 1 << (end - width + 1)
        return bits


def gram_words(width: int) -> int:
    """Words of an anchor gram: eight, or as many as leave at most 60 windows to one anchor, which then fit a long."""
    return min(width, max(GRAM, width - 59))


def anchors(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each window of `width` words has its smallest GRAM-word hash (the last of equals): the distinct places, and
    for each its first window and number of windows.  The choice depends on a window's words alone, so equal
    windows choose the same word of theirs, and each window of a text belongs to exactly one place."""
    gram = gram_words(width)
    span = width - gram + 1
    g = windows(ids, gram)
    n = len(g) - span + 1
    if n <= 0:
        e = np.empty(0, np.int64)
        return e, e, e
    if len(g) <= PLACES:                                   # hash above, place below: the least is the last of the smallest
        low = (g & ~np.uint64(PLACES - 1)) | (np.uint64(PLACES - 1) - np.arange(len(g), dtype=np.uint64))
        back = lambda m: PLACES - 1 - (m & np.uint64(PLACES - 1)).astype(np.int64)
    else:
        order = np.lexsort((-np.arange(len(g)), g & ~np.uint64(PLACES - 1)))
        low = np.empty(len(g), np.int64)
        low[order] = np.arange(len(g))
        back = lambda m: order[m]
    width = 1
    while 2 * width <= span:                               # minima of runs of 1, 2, 4 ... places
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    at = back(np.minimum(low[:n], low[span - width:span - width + n]))
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[first], first, np.diff(np.append(first, n))


def _gram_hash(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return windows(ids, gram_words(width))[at].astype(np.int64)


def repeated_windows(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, first, bits: bit i says that the window starting at word first + i of the document repeats elsewhere.

    `docs` has unique keys doc_id.  Steps, all on hashed keys with partial sums before each shuffle: count the anchor
    grams of all windows; keep the places of repeated grams; cut those places' windows out of the texts as
    contexts; collapse equal contexts to one with a weight; put contexts with one gram into one reference shard;
    build the automaton of each shard and stream the shard's contexts through it.  Windows that are equal share
    their gram, so no repeat crosses shards.  A gram with more than HOT_CONTEXTS different contexts is too large
    for one shard; its windows are counted one by one instead, by a 128-bit hash, with the same rows as result.
    """
    def grams(frames):
        for pdf in frames:
            parts = []
            for t in pdf.text:
                ids = hashes(words_of(t), _WORDS)
                parts.append(_gram_hash(ids, anchors(ids, width)[0], width))
            g, n = np.unique(np.concatenate(parts) if parts else np.empty(0, np.int64), return_counts=True)
            yield pd.DataFrame({"g": g, "n": n})

    def places(frames):
        for pdf in frames:
            g, ids_, first, n, size = [], [], [], [], []
            for d, t in zip(pdf.doc_id, pdf.text):
                ids = hashes(words_of(t), _WORDS)
                at, f, c = anchors(ids, width)
                if len(at):
                    g.append(_gram_hash(ids, at, width))
                    first.append(f)
                    n.append(c)
                    ids_.append(d)
                    size.append(len(at))
            if g:
                yield pd.DataFrame({"g": np.concatenate(g), "doc_id": np.repeat(np.array(ids_, np.int64), size), "first": np.concatenate(first).astype(np.int32), "n": np.concatenate(n).astype(np.int16)})

    text = docs.select("doc_id", "text")
    seen = text.select("text").mapInPandas(grams, "g long, n long").groupBy("g").agg(F.sum("n").alias("c")).where("c > 1").select("g")
    spots = text.mapInPandas(places, "g long, doc_id long, first int, n short").join(seen, "g", "left_semi")
    per_doc = spots.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "n", "g"))).alias("spots"))

    def cut(frames):
        for pdf in frames:
            rows = []
            for d, t, spots in zip(pdf.doc_id, pdf.text, pdf.spots):
                w = words_of(t)
                for s in spots:
                    rows.append((d, s["first"], s["g"], b" ".join(w[s["first"]:s["first"] + s["n"] + width - 1])))
                    if len(rows) >= 20_000:
                        yield _contexts(rows)
                        rows = []
            yield _contexts(rows)

    contexts = stage(text.join(per_doc, "doc_id").mapInPandas(cut, "doc_id long, first int, g long, k1 long, k2 long, words binary"), "contexts")
    distinct = contexts.groupBy("k1", "k2", "g").agg(F.count("*").alias("weight"), F.first("words").alias("words"))
    distinct = stage(distinct, "reference")
    crowded = distinct.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > HOT_CONTEXTS).select("g")
    calm, hot = distinct.join(crowded, "g", "left_anti"), distinct.join(crowded, "g", "left_semi")

    def match(frames):
        shard, size, last = [], 0, None
        for pdf in frames:
            for row in zip(pdf.k1, pdf.k2, pdf.g, pdf.weight, pdf.words):
                if row[2] != last and size >= SHARD_WORDS:
                    yield _matched(shard, width)
                    shard, size = [], 0
                last = row[2]
                shard.append(row)
                size += row[4].count(b" ") + 1
        yield _matched(shard, width)

    def split(frames):
        for pdf in frames:
            rows = []
            for k1, k2, c, words in zip(pdf.k1, pdf.k2, pdf.weight, pdf.words):
                w = words.split(b" ")
                rows += [(k1, k2, i, c, *_key(b" ".join(w[i:i + width]))) for i in range(len(w) - width + 1)]
            yield pd.DataFrame(rows, columns=["k1", "k2", "i", "weight", "w1", "w2"]).astype("int64")

    shards = calm.repartition("g").sortWithinPartitions("g").mapInPandas(match, "k1 long, k2 long, bits long")
    single = stage(hot.select("k1", "k2", "weight", "words").mapInPandas(split, "k1 long, k2 long, i long, weight long, w1 long, w2 long"), "windows")
    often = single.groupBy("w1", "w2").agg(F.sum("weight").alias("c")).where("c > 1").select("w1", "w2")
    rest = single.join(often, ["w1", "w2"], "left_semi").groupBy("k1", "k2").agg(F.sum(F.expr("shiftleft(1L, int(i))")).alias("bits"))
    bits = shards.where("bits <> 0").unionByName(rest)
    return contexts.select("doc_id", "first", "k1", "k2").join(bits, ["k1", "k2"]).select("doc_id", "first", "bits")


def _key(words: bytes) -> tuple[int, int]:
    h = hashlib.blake2b(words, digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _contexts(rows: list) -> pd.DataFrame:
    return pd.DataFrame([(d, f, g, *_key(w), w) for d, f, g, w in rows], columns=["doc_id", "first", "g", "k1", "k2", "words"]).astype({"doc_id": "int64", "first": "int32", "g": "int64", "k1": "int64", "k2": "int64"})


def _matched(shard: list, width: int) -> pd.DataFrame:
    """One shard: number its words, build the automaton over the contexts of each gram, stream them through it."""
    out, auto, names = [], SuffixAutomaton(), {}
    seqs = [[names.setdefault(w, len(names)) for w in row[4].split(b" ")] for row in shard]
    for row, seq in zip(shard, seqs):
        auto.add(seq, int(row[3]))
    auto.close()
    for row, seq in zip(shard, seqs):
        whole = (1 << (len(seq) - width + 1)) - 1
        out.append((row[0], row[1], whole if row[3] > 1 else auto.repeats(seq, width)))
    return pd.DataFrame(out, columns=["k1", "k2", "bits"]).astype("int64")


def covered(first: list[int], bits: list[int], n_words: int, width: int) -> np.ndarray:
    """Which of the words lie in a repeated window."""
    edge = np.zeros(n_words + 1, np.int64)
    for f, b in zip(map(int, first), map(int, bits)):
        while b:
            low = b & -b
            i = f + low.bit_length() - 1
            edge[i] += 1
            edge[i + width] -= 1
            b ^= low
    return np.cumsum(edge[:-1]) > 0


def dedup_substrings(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for every row of `docs`.

    Words are maximal runs of anything but space and \\x09-\\x0d, unchanged.  A word goes when a run of `width` words
    that covers it also starts at any other place of the table, its own text included; all runs are judged on
    the input.  Null or empty text has no words.  Rows are told apart by a key made of doc_id and text, so
    rows that share a doc_id but not the text are separate texts, and repeated rows are removed by each other.  Null ids are
    kept, an empty table gives no rows, other columns are not read.
    """
    keyed = docs.select(F.col("doc_id").alias("_id"), "text")
    twice = keyed.groupBy("_id").agg(F.count("*").alias("c")).where("c > 1 OR _id IS NULL")
    if not twice.isEmpty():
        return _dedup_any(keyed, width)
    return _dedup(keyed.withColumnRenamed("_id", "doc_id"), width)


def _dedup(docs: DataFrame, width: int) -> DataFrame:
    marks = repeated_windows(docs, width).groupBy("doc_id").agg(F.collect_list(F.struct("first", "bits")).alias("marks"))

    def remove(frames):
        for pdf in frames:
            rows = []
            for d, t, marks in zip(pdf.doc_id, pdf.text, pdf.marks):
                w = words_of(t)
                if marks is None or not len(marks):
                    rows.append((d, len(w), 0, b" ".join(w).decode("utf-8", "surrogatepass")))
                    continue
                gone = covered([m["first"] for m in marks], [m["bits"] for m in marks], len(w), width)
                kept = [x for x, g in zip(w, gone) if not g]
                rows.append((d, len(w), int(gone.sum()), b" ".join(kept).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept"])

    return docs.join(marks, "doc_id", "left").mapInPandas(remove, "doc_id long, n_words long, n_removed long, kept string")


def _dedup_any(keyed: DataFrame, width: int) -> DataFrame:
    """Tables whose ids are null or repeated: rows are staged and numbered first."""
    rows = stage(keyed, "rows").withColumn("doc_id", F.monotonically_increasing_id())
    rows = stage(rows, "numbered")
    done = _dedup(rows.select("doc_id", "text"), width)
    return done.join(rows.select("doc_id", "_id"), "doc_id").select(F.col("_id").alias("doc_id"), "n_words", "n_removed", "kept")
