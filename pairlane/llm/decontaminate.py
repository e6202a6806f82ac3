"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""
from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import WordHash, chunks, hashes, mix, windows, words_of

HASHES = 16
BLOCK_ITEMS = 20_000
_WORDS = WordHash()


def _salts(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def permuted(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    """One of the hash functions of the signature, a bijection, so that a minimum names its shingle."""
    y = x * salt
    return y ^ (y >> np.uint64(29))


class Index:
    """Signatures of a bounded block of items, by shingle length k and size class; a class holds the sizes of
    (2^(c-1), 2^c] shingles and is looked for in windows of 2^c shingles of a document."""

    def __init__(self, items: list[tuple[int, str]], k: int):
        self.salts = _salts(HASHES)
        self.sets, by = {}, defaultdict(lambda: defaultdict(list))
        for n, (item, text) in enumerate(items):
            words = words_of(text, lower=True)
            if not words:
                continue
            span = min(k, len(words))
            ids = windows(hashes(words, _WORDS), span)
            s = np.unique(ids)
            self.sets[n] = (item, s)
            for i, salt in enumerate(self.salts):
                by[span, max(0, int(len(s) - 1).bit_length())][i].append((permuted(s, salt).min(), n))
        self.classes = {}
        for (span, c), funcs in by.items():
            pairs = [sorted(funcs[i]) for i in range(HASHES)]
            self.classes.setdefault(span, {})[c] = [(np.array([v for v, _ in p], np.uint64), np.array([n for _, n in p], np.int64)) for p in pairs]

    def search(self, texts: list, threshold: int) -> list[tuple[int, int, int, int]]:
        """(place in `texts`, item id, shingles in common, shingles of the item) where 100 * common >= threshold * shingles.

        The texts are laid end to end, so that a few passes over long arrays serve all.  A window over two texts can only
        add a candidate for either; candidates are verified on the shingles of their own text."""
        words = [words_of(t, lower=True) for t in texts]
        ids = hashes(list(itertools.chain.from_iterable(words)), _WORDS)
        ends = np.cumsum([len(w) for w in words])
        out = []
        for span, classes in self.classes.items():
            grams, found = windows(ids, span), set()
            if not len(grams):
                continue
            for i, salt in enumerate(self.salts):
                low, width = permuted(grams, salt), 1
                for c in range(max(classes) + 1):
                    if c and len(low) > width:             # minima of twice as many shingles from two of half as many
                        low = np.minimum(low[:-width], low[width:])
                    width = width * 2 if c else width
                    if c in classes:
                        found.update(self._candidates(low, 1 << c, classes[c][i], ends))
            sets: dict[int, np.ndarray] = {}
            for row, n in found:
                if row not in sets:
                    lo = ends[row - 1] if row else 0
                    sets[row] = np.unique(grams[lo:max(lo, ends[row] - span + 1)])
                item, s = self.sets[n]
                common = int(np.isin(s, sets[row], assume_unique=True).sum())
                if 100 * common >= threshold * len(s):
                    out.append((row, item, common, len(s)))
        return out

    @staticmethod
    def _candidates(low: np.ndarray, width: int, index: tuple, ends: np.ndarray) -> set[tuple[int, int]]:
        values, names = index
        at = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        last = np.append(at[1:] - 1, len(low) - 1) + width - 1
        v = low[at]
        near = np.minimum(np.searchsorted(values, v), len(values) - 1)
        out = set()
        for k in np.flatnonzero(values[near] == v):
            hi = np.searchsorted(values, v[k], "right")
            rows = range(np.searchsorted(ends, at[k], "right"), min(np.searchsorted(ends, last[k], "right"), len(ends) - 1) + 1)
            out.update((int(r), int(n)) for r in rows for n in names[near[k]:hi])
        return out


def contaminated(docs: DataFrame, items: DataFrame, k: int = 5, threshold: int = 80, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Pairs (doc_id, item_id, n_common, n_item) where at least `threshold` percent of an item's distinct k-word
    shingles (A-Z folded) occur in the document; an item of fewer than k words is one shingle of its own length.

    Documents are cut into overlapping windows of the size class of the items looked for, so that containment
    becomes a Jaccard likeness that 16 min-hashes find: 0.5 or more for a copied passage (missed with 2e-5), 0.36 for
    a contiguous passage at the threshold (missed with 8e-4).  Candidates are verified on whole sets.  Items are
    the stated query side: they are taken in blocks of `block_items`, each block meets all documents in one narrow
    pass, and only a block is ever broadcast.  Null or empty texts and items match nothing; repeated rows of a
    document or item with one id give one pair; empty tables give no rows.
    """
    spark = docs.sparkSession
    parts = []
    for block in item_blocks(items, block_items):
        shared = spark.sparkContext.broadcast(Index(block, k))

        def search(frames, shared=shared):
            index = shared.value
            for pdf in frames:
                rows, first = [], 0
                for part in chunks(pdf.text):
                    rows += [(pdf.doc_id.iat[first + row], *m) for row, *m in index.search(part, threshold)]
                    first += len(part)
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_common", "n_item"]).astype({"item_id": "int64", "n_common": "int64", "n_item": "int64"})

        parts.append(docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(search, "doc_id long, item_id long, n_common long, n_item long"))
    if not parts:
        return spark.createDataFrame([], "doc_id long, item_id long, n_common long, n_item long")
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.distinct()


def item_blocks(items: DataFrame, block_items: int):
    """Lists of at most `block_items` (item_id, text), one block on the driver at a time."""
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").toLocalIterator(prefetchPartitions=False)
    pairs = ((r.item_id, r.text) for r in rows)
    while block := list(itertools.islice(pairs, block_items)):
        yield block
