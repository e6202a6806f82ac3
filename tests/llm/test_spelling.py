import random
import re
import zlib
from collections import Counter


from pairlane.llm import spelling

SCHEMA = "doc_id long, text string"


def counts(rows):
    got = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            got[w] += 1
    return {w: n for w, n in got.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def groups(n):
    form, out = {}, []
    around = {w: [v for v in n if near(w, v)] for w in n}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcé×", k=rng.randint(4, 12))) for _ in range(25)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ß" * 6]
    rows = []
    for d in range(200):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abC") + w[i:], w[:i] + rng.choice("abC") + w[i + 1:]]) or "x"
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((d, rng.choice([" ", "1", "\n", "ł"]).join(words)))
    return rows


def test_groups_equal_brute_force(spark, monkeypatch):
    """Null and repeated ids, null and empty texts, repeated rows, batches cut inside a text, flushed counters."""
    monkeypatch.setattr(spelling, "HELD", 50)
    monkeypatch.setattr(spelling, "BATCH", 7)
    rows = texts(1) + [(None, "Hello hello HELLO"), (3, None), (4, ""), (5, "hellos " * 9), (5, "hellos " * 9)]
    want = groups(counts(rows))
    assert len(want) > 100 and any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want)
    assert got(spelling.spelling_groups(spark.createDataFrame(rows, SCHEMA).repartition(3))) == want


def test_every_pair_one_edit_apart_is_found(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("ab", k=rng.randint(5, 9))) for _ in range(400)}
    pairs = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"))
    assert got(pairs) == sorted((a, b) for a in words for b in words if near(a, b))


def test_long_way_to_the_root(spark):
    words = ["a" * 5 + "b" * i for i in range(12)]
    rows = [(w, 3 * 2 ** i) for i, w in enumerate(words)]
    out = {r.word: r for r in spelling.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert all(out[w].root == words[-1] for w in words) and out[words[0]].form == words[1] and out[words[-1]].form is None


def test_very_long_text_empty_table_clashing_names(spark):
    rows = [(1, "Straße " * 400_000, "w", 1)]
    assert got(spelling.spelling_groups(spark.createDataFrame(rows, SCHEMA + ", word string, n long"))) == groups(counts([r[:2] for r in rows]))
    assert got(spelling.spelling_groups(spark.createDataFrame([], SCHEMA))) == []


def test_no_table_of_words_is_broadcast(spark):
    words = spark.createDataFrame([("colour", 9), ("color", 4), ("colours", 3)], "word string, n long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        near, out = spelling.near_pairs(words), spelling.group_variants(words)
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (near, out)]
        assert all("Join" in p and "Broadcast" not in p for p in plans)
        assert {(r.word, r.form, r.n_near) for r in out.collect()} == {("colour", None, 2), ("color", "colour", 1), ("colours", "colour", 1)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
