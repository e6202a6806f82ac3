"""Token counts by offset-mapped attribution: encode whole documents once, join token spans to fields and sections."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .tokenizing import byte_tokenizer

RULES = ("most", "first", "last")


def sections(fields: list[tuple[str, str | None]], body: str) -> list[tuple[str, int, str]]:
    """(field, section number, text) of a document: its fields in order, each but the last ended by a line break; the
    body field is cut behind each of its line breaks.  The texts joined are the document; a null field is empty."""
    out = []
    for n, (name, value) in enumerate(fields):
        text = (value or "") + ("\n" if n < len(fields) - 1 else "")
        parts = [text]
        if name == body:
            parts = [p + "\n" for p in text.split("\n")]
            parts[-1] = parts[-1][:-1]
            if len(parts) > 1 and not parts[-1]:
                parts.pop()
        out += [(name, i, p) for i, p in enumerate(parts)]
    return out


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each interval, and how many of the tokens that touch it also touch another.

    `ends` are the byte ends of the tokens, which tile the document; intervals tile it too and begin at `bounds`.  A
    token inside one interval is that one's.  A token over a boundary goes to the interval with most of its bytes, the
    earlier of equals ("most"), or to the first or last it touches; empty intervals get none.  Each token is counted once.
    """
    n = len(bounds)
    if not len(ends):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    lo = np.searchsorted(bounds, starts, "right") - 1
    hi = np.searchsorted(bounds, ends - 1, "right") - 1
    owner = hi.copy() if rule == "last" else lo.copy()
    crossing = np.zeros(n, np.int64)
    edges = np.append(bounds, ends[-1])
    for t in np.flatnonzero(lo != hi):
        held = np.minimum(edges[lo[t] + 1:hi[t] + 2], ends[t]) - np.maximum(edges[lo[t]:hi[t] + 1], starts[t])
        crossing[lo[t]:hi[t] + 1] += held > 0
        if rule == "most":
            owner[t] = lo[t] + int(np.argmax(held))
    return np.bincount(owner, minlength=n), crossing


def count_tokens(docs: DataFrame, ranks: str, pattern: str, fields: list[str], body: str, rule: str = "most") -> DataFrame:
    """doc_id, field, section, char_start, char_end, n_tokens, n_crossing, doc_tokens: one row per field and, in the
    body field, per line of every row of `docs`; char places are code points of the joined document.

    A document is its fields joined by line breaks and encoded once as a whole, so counts are those of the tokens a
    model sees and add up to doc_tokens.  Null fields are empty and have their row, repeated rows give repeated rows, an
    empty table gives none; a field may have any name but doc_id, as fields are carried by position.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(frames):
        tokenizer = byte_tokenizer(ranks, pattern)
        for pdf in frames:
            rows = []
            for d, *values in zip(pdf.doc_id, *(pdf[f"f{i}"] for i in range(len(fields)))):
                parts = sections(list(zip(fields, values)), body)
                raw = [p.encode("utf-8", "surrogatepass") for _, _, p in parts]
                bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])[:-1]]).astype(np.int64)
                ends = tokenizer.ends("".join(p for _, _, p in parts))
                n, crossing = attribute(ends, bounds, rule)
                at = 0
                for (name, i, p), a, c in zip(parts, n, crossing):
                    rows.append((None if pd.isna(d) else int(d), name, i, at, at + len(p), int(a), int(c), len(ends)))
                    at += len(p)
            out = pd.DataFrame(rows, columns=["doc_id", "field", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"])
            yield out.astype({"doc_id": "Int64"})

    slim = docs.select("doc_id", *(F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)))
    return slim.mapInPandas(count, "doc_id long, field string, section int, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long")
