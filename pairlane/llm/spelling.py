"""Spelling variants: asymmetric q-chunks find words one edit apart; forms follow the most frequent neighbour."""
from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import stage, stage_dropping

#: A run of letters A-Z, a-z and U+00C0 to U+00FF in UTF-8 bytes whose A-Z are folded.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: One run in so many is typed with a code point missing; distinct words a task counts before it hands them on; runs looked at at once.
TYPO, HELD, BATCH = 97, 100_000, 200_000
MIN_LENGTH, MIN_COUNT = 5, 3


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the runs of all texts, A-Z folded, with the planted typing errors, of `min_length` code points and `min_count` occurrences or more.

    A run of document d loses code point h % length where h = crc32(d:run) is divisible by TYPO.  Null text has no runs, a null id
    reads as empty.  Tasks count before the shuffle and hold a bounded number of words, a long text is read run by run.
    """
    most, batch = HELD, BATCH

    def counts(frames):
        held = Counter()
        flush = lambda: pd.DataFrame({"word": [w.decode() for w in held], "n": list(held.values())})
        for pdf in frames:
            for d, text in zip(pdf.doc_id, pdf.text):
                if text is None:
                    continue
                prefix = zlib.crc32(b"%s:" % d.encode())
                runs = (m.group() for m in RUN.finditer(text.encode("utf-8", "surrogatepass").lower()))
                while own := Counter(islice(runs, batch)):
                    for run, n in own.items():
                        h = zlib.crc32(run, prefix)
                        if h % TYPO == 0:
                            word = run.decode()
                            at = h % len(word)
                            run = (word[:at] + word[at + 1:]).encode()
                        if len(run) >= min_length and (len(run) >= 2 * min_length or len(run.decode()) >= min_length):
                            held[run] += n
                    if len(held) >= most:
                        yield flush()
                        held.clear()
        if held:
            yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {min_count}")


def _piece(word: Column, start: Column, end: Column) -> Column:
    return F.substring(word, start + 1, end - start)


def _chunks(word: Column, length: Column, shift: Column) -> list[Column]:
    """Keys of a word of `length` code points cut into four quarters, or of the positional grams, moved by `shift`, of a word that holds all of it but
    the edit.

    The word's two disjoint chunks are its halves; one edit leaves one of them whole, and of the other half, cut in two again,
    one of the quarters.  What is left of the edit stands where it stood, what is right of it is moved by the
    difference of lengths, one at most.  Each key holds the length, the edited quarter and the two grams that stay.
    """
    half = F.floor(length / 2).cast("int")
    first, third = F.floor(half / 2).cast("int"), (half + F.floor((length - half) / 2)).cast("int")
    key = lambda edited, a, b: F.xxhash64(F.lit(edited), length, a, b)
    moved = lambda start, end: _piece(word, start + shift, end + shift)
    zero = F.lit(0)
    return [key(0, moved(half, length), moved(first, half)), key(1, moved(half, length), _piece(word, zero, first)),
            key(2, _piece(word, zero, half), moved(third, length)), key(3, _piece(word, zero, half), _piece(word, half, third))]


def _by_merge(words: DataFrame) -> DataFrame:
    """A side of a join that grows with the words: never broadcast, as Spark takes an exploded table for no larger than its input and a compressed
    file for its rows."""
    return words.hint("merge")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: all ordered pairs of distinct words that one inserted, deleted or replaced code point turns into each other.

    The longer word of a pair (either of two equally long ones) gives its chunks, the other its grams within a shift of one;
    pairs that meet in a key are verified inside the join, so only true pairs leave it.
    """
    words = words.select("word", F.length("word").alias("len"))
    chunks = words.select(F.col("word").alias("a"), F.col("len").alias("la"), F.explode(F.array(*_chunks(F.col("word"), F.col("len"), F.lit(0)))).alias("key"))
    grams = [k for d in (0, 1) for k in _chunks(F.col("word"), F.col("len") + d, F.lit(-d))]
    grams = words.select(F.col("word").alias("b"), F.col("len").alias("lb"), F.explode(F.array_distinct(F.array(*grams))).alias("key"))
    near = F.levenshtein("a", "b", 1) == 1
    found = chunks.join(_by_merge(grams), (chunks.key == grams.key) & ((F.col("la") > F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("a") < F.col("b")))) & near)
    pairs = found.select("a", "b").distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def group_variants(counted: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table (word, n) of distinct words.

    A word's form is its near word of largest n, the first in code-point order among equals, if that n is at least twice its own; forms have
    at least twice the count each time, so the way to the root ends, and doubling steps follow it.
    """
    words = stage(counted, "words")
    near = near_pairs(words).join(_by_merge(words.select(F.col("word").alias("b"), F.col("n").alias("nb"))), "b")
    best = near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("m"), F.col("b").alias("form"))).alias("best"))
    found = words.join(_by_merge(best), "word", "left").withColumn("has", F.coalesce(-F.col("best.m") >= 2 * F.col("n"), F.lit(False)))
    found = stage_dropping(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("best.form")).alias("form"), F.when(F.col("has"), -F.col("best.m")).alias("form_n")), "forms", words)
    way = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:                                             # a word whose form has a form goes on to where that one stands
        on = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stage(way.join(_by_merge(on), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        way = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return found.join(_by_merge(way), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame) -> DataFrame:
    """Spelling variants of the words of a table (doc_id, text): word, form, root, n, n_near, form_n as `group_variants` gives them.

    Every row counts, repeated rows and rows that share an id too; null texts and empty texts have no words, a null id reads as empty, ties of
    n go to the smaller word, an empty table gives no rows, other columns are not read.
    """
    return group_variants(word_counts(docs.select("doc_id", "text")))
