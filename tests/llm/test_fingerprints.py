"""Multiset hash against plain Python, and its homomorphism."""
import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from pairlane.llm import fingerprints as fp


def _h(data, seed):
    h = xxhash.xxh64_intdigest(data if isinstance(data, bytes) else data, seed=seed & (2 ** 64 - 1))
    return h


def _xx(*parts):
    """The engine's xxhash64 of several values: each takes the hash so far as its seed; nulls are skipped."""
    seed = 42
    for p in parts:
        if p is None:
            continue
        seed = _h(p.encode() if isinstance(p, str) else (p & (2 ** 64 - 1)).to_bytes(8, "little"), seed)
    return seed - 2 ** 64 if seed >= 2 ** 63 else seed


def _units(text):
    out = []
    for p in text.split("\n"):
        w = p.split()
        if w:
            out.append(_xx(" ".join(w)))
            for i in range(len(w)):
                b, c = (w[i + 1] if i + 1 < len(w) else None), (w[i + 2] if i + 2 < len(w) else None)
                inner = _xx(b, c) if i + 1 < len(w) else None
                out.append(_xx(w[i], inner))
    return out


def _lanes(text):
    lanes = [0] * fp.LANES
    for h in _units(text):
        u = h & (2 ** 64 - 1)
        for s in fp.SEEDS:
            x = u if s == 0 else None
            if s:
                seeded = xxhash.xxh64_intdigest(u.to_bytes(8, "little"), seed=42)
                x = xxhash.xxh64_intdigest((s).to_bytes(4, "little"), seed=seeded)
            for i in range(63):
                lanes[s * 63 + i] += x >> i & 1
    return len(_units(text)), [v % 2 ** 21 for v in lanes]


def _sums(row):
    return [row[c] >> 21 * j & (2 ** 21 - 1) for c in fp.SUM_NAMES for j in range(3)]


def test_vectors_match_plain_sums_and_ignore_paragraph_order(spark):
    texts = ["a b c d\nx y", "x y\na b c d", "", None, "one", "é ü  ß\t z\n\n q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in fp.vectors(df, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        n, lanes = _lanes(t or "")
        assert (rows[i].n_units, _sums(rows[i])) == (n, lanes)
    assert _sums(rows[0]) == _sums(rows[1])


def test_insert_and_delete_paragraphs(spark):
    df = spark.createDataFrame([(0, "a b c\nd e"), (1, "a b c"), (2, "d e")], "doc_id long, text string")
    v = fp.vectors(df, ["doc_id"])
    side = lambda i, p: v.where(F.col("doc_id") == i).select(*(F.col(c).alias(p + c) for c in fp.SUM_NAMES))
    added = side(1, "a_").crossJoin(side(2, "b_")).select(*fp.combine("a_", "b_")).first()
    gone = side(0, "a_").crossJoin(side(2, "b_")).select(*fp.combine("a_", "b_", -1)).first()
    rows = {r.doc_id: r for r in v.collect()}
    assert _sums(added) == _sums(rows[0]) and _sums(gone) == _sums(rows[1])


def test_query_rows(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefé", k=rng.randint(1, 6)))
    texts = {i * 7 - 20: "\n".join(" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 5))) for i in range(40)}
    texts[3], texts[4] = None, ""
    texts[9] = texts[-20]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, place string")
    got = {r.doc_id: r for r in fp.fingerprint_documents(df, parts=5).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for n, i in enumerate(ids):
        a, b = texts[i] or "", texts[ids[(n + 1) % len(ids)]] or ""
        h = len(a) // 2
        e = a[:len(a) - h] + b[:h]
        assert got[i].n_chars == len(a) and got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[9].fingerprint == got[-20].fingerprint and got[3].fingerprint == got[4].fingerprint


def test_repeated_null_and_lone_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    got = fp.fingerprint_documents(df, parts=3).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 1), (1, 3), (1, 3), (1, 3), (2, 0)]
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    lone = fp.fingerprint_documents(df.where("doc_id = 2"), parts=3).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0
    assert fp.fingerprint_documents(df.limit(0), parts=3).count() == 0


def test_lanes_wrap_each_by_itself(spark, monkeypatch):
    monkeypatch.setattr(fp, "LANE_BITS", 4)
    monkeypatch.setattr(fp, "_MASK", 15)
    lane = lambda r: [getattr(r, c) >> 4 * j & 15 for c in fp.SUM_NAMES for j in range(3)]
    long = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(1, long)] + [(2, "a b c\nd e")] * 40 + [(3, long)], "doc_id long, text string")
    rows = {r.doc_id: r for r in fp.vectors(df, ["doc_id"]).collect()}
    for i, t in ((1, long), (2, "a b c\nd e"), (3, long)):
        n, counts = _lanes(t)
        order = [counts[s * 63 + 3 * i + j] % 16 for s in fp.SEEDS for i in range(fp.SUMS) for j in range(3)]
        assert (rows[i].n_units, lane(rows[i])) == (n, order)
    assert [rows[i].copies for i in (1, 2, 3)] == [1, 40, 1]
    edit = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)) + "\nx y"), (2, " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    v = fp.vectors(edit, ["doc_id"])
    side = lambda i, p: v.where(F.col("doc_id") == i).select(*(F.col(c).alias(p + c) for c in ["n_units", *fp.SUM_NAMES]))
    assert side(1, "a_").crossJoin(side(2, "b_")).select(fp.likeness("a_", "b_")).first()[0] > 0.85


def test_many_equal_rows_are_summed_once(spark):
    rows = [(1, "a b")] * 50 + [(2, "c d")] + [(None, "e")] * 7
    for df in (spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(1, "a b")] * 9, "doc_id long, text string")):
        nexts = fp.with_next(df, 3).collect()
        assert sum(r.copies for r in nexts) == df.count() and len({(r.doc_id, r.next_id) for r in nexts}) == len(nexts) <= 5
        got = fp.fingerprint_documents(df, parts=3).collect()
        assert len(got) == df.count() and len({r.fingerprint for r in got if r.doc_id == 1}) == 1
