"""Secret scan: broad candidates, and a random forest that takes out the false ones."""
from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import forest
from .common import stage

CANDIDATE = re.compile(r"(?<![A-Za-z0-9_\-+/])[A-Za-z0-9_\-+/]{12,}={0,2}")
WORD = re.compile(r"[^\W\d_]+")
# fixed values: published key formats, and names that credentials are assigned to
VENDOR = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{24,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_\-]{35}|eyJ[A-Za-z0-9_\-]{10,}")
NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "credential", "private_key", "bearer")
PLACEHOLDER = ("example", "changeme", "xxxx", "your_", "test", "dummy", "sample", "placeholder")
ASSIGNED = re.compile(r"([A-Za-z_\-]{2,30})[\"']?\s{0,3}(?:=|:|=>)\s{0,3}[\"']?$|\b(bearer)\s$", re.I)
JWT = re.compile(r"eyJ[A-Za-z0-9_\-]{5,}(?:\.{1,2}[A-Za-z0-9_\-]+){1,4}")
#: A credential's name and its sign; the value, seen ahead, is quoted, or runs to a space, bracket or separator.
ASSIGNMENT = re.compile(rf"(?:(?:{'|'.join(NAMES)})[A-Za-z_\-]{{0,28}}[\"']?\s{{0,3}}(?:=>|=|:)\s{{0,3}}|\bbearer\s)"
                        r"(?=\"((?:\\.|[^\"\\\n])+)\"|'((?:\\.|[^'\\\n])+)'|[\"']?([^\s\"'<>()\[\]{},;&]+))", re.I)
ASSIGNED_CHARS = 6
SIGNS, PROSE_WORD = re.compile(r"[\s\-'/.,:!?]+"), re.compile(r"[A-Za-z]?[a-z]*")
LEFT, DICTIONARY_WORDS, PIECE = 48, 20_000, 4
FEATURES = 22


def candidates(text: str | None) -> list[tuple[int, str]]:
    """(start, value) of each run of 12 or more key characters with a digit in it, each published key format, each whole
    web token with its dots, and each value of 6 or more characters assigned to a credential's name; what overlaps is one."""
    if not text:
        return []
    spans = [m.span() for m in CANDIDATE.finditer(text) if any(c.isdigit() for c in m[0])]
    spans += [m.span() for form in (VENDOR, JWT) for m in form.finditer(text)]
    for m in ASSIGNMENT.finditer(text):
        start, end = m.span(m.lastindex)
        if m.lastindex == 3:                               # without quotes the sentence's signs are not the value's
            end = start + len(m[3].rstrip(".:?"))
        if end - start >= ASSIGNED_CHARS:
            spans.append((start, end))
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(start, text[start:end]) for start, end in merged]


def dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS) -> Counter:
    """The `words` most frequent words of 4 to 12 letters a-z with their counts, over all documents."""

    def count(frames):
        for pdf in frames:
            seen: Counter = Counter()
            for t in pdf.text:
                seen.update((t or "").lower().split())
            seen = [(w, n) for w, n in seen.items() if 4 <= len(w) <= 12 and w.isascii() and w.isalpha()]
            yield pd.DataFrame(seen, columns=["w", "n"])

    top = docs.select("text").mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(words)
    return Counter({r.w: r.n for r in top.collect()})


class Language:
    """Character transitions and pieces of dictionary words, for how like prose a value is."""

    def __init__(self, words: Counter):
        self.pieces = {w[i:i + PIECE] for w in words for i in range(len(w) - PIECE + 1)}
        pairs, firsts = Counter(), Counter()
        for w, n in words.items():
            for a, b in zip(w, w[1:]):
                pairs[a + b] += n
                firsts[a] += n
        self.logp = {p: math.log((n + 1) / (firsts[p[0]] + 27)) for p, n in pairs.items()}
        self.rare = math.log(1e-5)

    def transitions(self, value: str) -> float:
        """Mean log probability of each character after the one before, as in the dictionary's words."""
        v = value.lower()
        return sum(self.logp.get(v[i:i + 2], self.rare) for i in range(len(v) - 1)) / max(1, len(v) - 1)

    def coverage(self, value: str) -> float:
        """Share of characters in four-letter pieces of dictionary words."""
        v, end, total = value.lower(), 0, 0
        for i in range(len(v) - PIECE + 1):
            if v[i:i + PIECE] in self.pieces:
                total += i + PIECE - max(i, end)
                end = i + PIECE
        return total / len(v)


def assigned_name(left: str) -> str:
    m = ASSIGNED.search(left)
    return (m[1] or m[2] or "").lower().lstrip("-_") if m else ""


def credential(name: str) -> bool:
    """Whether an assigned name is a credential's; an author is none."""
    name = re.sub(r"author(?!i[sz])", "", name)
    return any(k in name for k in NAMES)


def neighbours(text: str, start: int, value: str) -> tuple[str, str]:
    """The words next to a value on both sides, lower-cased, or nothing."""
    left, right = WORD.findall(text[max(0, start - LEFT):start]), WORD.search(text[start + len(value):start + len(value) + LEFT])
    return left[-1].lower() if left else "", right[0].lower() if right else ""


def describe(text: str, start: int, value: str, path: str, language: Language, rates: dict[str, float]) -> list[float]:
    """Length, character classes and their transitions, entropy, likeness to prose, names and signs around, path."""
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    left, right = text[max(0, start - LEFT):start], text[start + n:start + n + 8]
    name = assigned_name(left)
    before, after = neighbours(text, start, value)
    counts = Counter(value)
    lowered = value.lower()
    return [n, kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("o") / n,
            sum(a != b for a, b in zip(kinds, kinds[1:])) / (n - 1), -sum(c / n * math.log2(c / n) for c in counts.values()), len(counts) / n,
            float(all(c in "0123456789abcdef" for c in lowered)), language.transitions(value), language.coverage(value),
            float(bool(name)), float(credential(name)), rates.get("<" + before, -1.0), rates.get(">" + after, -1.0),
            float(left[-1:] in "\"'" and left != ""), float(right[:1] in "\"'" and right != ""), float("/" in value or left[-1:] in ("/", "\\")), float("://" in left), float("@" in left[-1:] + right[:1] or "." in right[:1]),
            float(any(p in lowered for p in PLACEHOLDER)), float(any(p in path.lower() for p in ("test", "example", "doc", "sample", "fixture", "mock")))]


def prose(value: str) -> bool:
    """Whether a value is words with no capital but the first letter, parted by spaces and common signs; linear in its length."""
    return all(PROSE_WORD.fullmatch(w) for w in SIGNS.split(value))


def rule_labels(text: str, start: int, value: str) -> int:
    """Label of a finding by rule, where nobody has labelled any: 1 for a published key format or web token, or mixed
    characters assigned to a credential's name; 0 for placeholders, numbers and everything that is assigned to no such name.
    Plain words count only if quoted and assigned to a password or secret, and then only one word."""
    if any(p in value.lower() for p in PLACEHOLDER):
        return 0
    if VENDOR.fullmatch(value) or JWT.fullmatch(value):
        return 1
    left = text[max(0, start - LEFT):start]
    name = assigned_name(left)
    if not credential(name) or value.isdigit() or len(set(value)) < min(6, len(value) // 2):
        return 0
    if prose(value):
        return int(left[-1:] in "\"'" and not any(c.isspace() for c in value) and any(k in name for k in ("pass", "pwd", "secret")))
    return 1


class Model:
    def __init__(self, trees: forest.Forest, language: Language, rates: dict[str, float]):
        self.trees, self.language, self.rates = trees, language, rates

    def findings(self, text: str | None, path: str | None) -> list[tuple[int, str, float]]:
        found = candidates(text)
        if not found:
            return []
        x = np.array([describe(text, s, v, path or "", self.language, self.rates) for s, v in found], np.float64)
        return [(s, v, float(p)) for (s, v), p in zip(found, self.trees.scores(x))]


def train(docs: DataFrame, labelled: DataFrame | None = None, max_labelled: int = 20_000, trees: int = 32) -> Model:
    """A model from labelled findings (doc_id, start, label), or, without any, from `rule_labels` of the candidates.

    Labels are read from a documented bounded sample, at most `max_labelled` findings in the order of a hash of
    document and place; the dictionary counts all documents.  Words next to a value count by the smoothed share of
    secrets among the sampled findings that they stand by.  Without findings every score is 0.
    """
    def collect(frames):
        for pdf in frames:
            rows = []
            for d, t, p in zip(pdf.doc_id, pdf.text, pdf.source):
                for s, v in candidates(t):
                    lo, hi = max(0, s - LEFT), s + len(v) + LEFT
                    rows.append((None if pd.isna(d) else int(d), s, t[lo:hi], s - lo, v, p, rule_labels(t, s, v)))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "around", "at", "value", "path", "label"]).astype({"doc_id": "Int64"})

    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    found = slim.mapInPandas(collect, "doc_id long, start long, around string, at long, value string, path string, label int")
    if labelled is not None:
        found = found.drop("label").join(labelled.select("doc_id", "start", F.col("label").cast("int").alias("label")).where("label IS NOT NULL").distinct(), ["doc_id", "start"])
    sample = found.orderBy(F.xxhash64("doc_id", "start", "value"), "doc_id", "start", "value").limit(max_labelled).collect()
    language = Language(dictionary(docs))
    seen, ones = Counter(), Counter()
    for r in sample:
        before, after = neighbours(r.around, r.at, r.value)
        for k in ("<" + before, ">" + after):
            seen[k] += 1
            ones[k] += r.label
    rates = {k: (ones[k] + 0.5) / (n + 1) for k, n in seen.items() if n >= 5}
    x = np.array([describe(r.around, r.at, r.value, r.path, language, rates) for r in sample], np.float64).reshape(len(sample), FEATURES)
    y = np.array([r.label for r in sample], np.float64)
    return Model(forest.fit(docs.sparkSession, x, y, trees), language, rates)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, start, length, value_sha256, score, is_secret: one row per candidate of every row of `docs`, whole texts
    read; start and length in code points.  Null and empty texts have none, repeated rows give repeated findings, overlapping
    candidates do not occur; other columns than doc_id, text and source are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)         # trees and DICTIONARY_WORDS words, whatever the corpus

    def find(frames):
        for pdf in frames:
            rows = [(None if pd.isna(d) else int(d), s, len(v), v, p) for d, t, path in zip(pdf.doc_id, pdf.text, pdf.source) for s, v, p in shared.value.findings(t, path)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "value", "score"]).astype({"doc_id": "Int64"})

    found = docs.select("doc_id", "text", F.col("source").cast("string").alias("source")).mapInPandas(find, "doc_id long, start long, length long, value string, score double")
    return found.select("doc_id", "start", "length", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("is_secret"))


def redact(docs: DataFrame, model: Model, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret in the text replaced by `mark` and n_chars set anew where it changed; all rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(texts: pd.Series, paths: pd.Series) -> pd.Series:
        out = []
        for t, path in zip(texts, paths):
            for s, v, p in reversed(shared.value.findings(t, path)):
                if p >= 0.5:
                    t = t[:s] + mark + t[s + len(v):]
            out.append(t)
        return pd.Series(out, dtype=object)

    text = F.pandas_udf(clean, "string")(F.col("text"), F.col("source").cast("string"))
    done = docs.withColumn("_clean", text)
    changed = ~F.col("_clean").eqNullSafe(F.col("text"))
    return done.withColumns({"n_chars": F.when(changed, F.char_length("_clean").cast("long")).otherwise(F.col("n_chars")), "text": F.col("_clean")}).select(docs.columns)
