import random

import numpy as np
import pytest

from pairlane.llm import suffix_dedup

SCHEMA = "doc_id long, text string"


def brute(texts, width):
    raws, count = [(t or "").encode() for t in texts], {}
    for r in raws:
        for i in range(len(r) - width + 1):
            count[r[i:i + width]] = count.get(r[i:i + width], 0) + 1
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - width + 1):
            if count[r[i:i + width]] > 1:
                gone[i:i + width] = [True] * width
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def texts_of(seed, n=60):
    """Passages shared in parts, copies, periodic runs and texts shorter than a window."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(2, 7)))
    passages = ["".join(f"{word()} " for _ in range(40)) for _ in range(4)]
    texts = []
    for _ in range(n):
        t = "".join(f"{word()} " for _ in range(rng.randint(0, 30)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            t += p[a:a + rng.randint(10, 220)] + word()
        texts.append(t)
    return texts + [texts[0], texts[1], texts[1], "ab" * 90, "x" * 300, "", None, "short", passages[0] * 2]


def got(df, width):
    return {r[0]: tuple(r[1:4]) + (bytes(r[4]),) for r in suffix_dedup.dedup_bytes(df, width).collect()}


@pytest.mark.parametrize("width, crowd, cut", [(48, 512, 1 << 20), (48, 3, 1 << 20), (200, 2, 256), (16, 1, 64), (301, 4, 1 << 20)])
def test_dedup_equals_brute_force(spark, monkeypatch, width, crowd, cut):
    """Also with crowded grams that are parted down to single windows, and with texts hashed slice by slice."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "SLICE", cut)
    texts = texts_of(width)
    assert got(spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3), width) == dict(enumerate(brute(texts, width)))


def shards(seed, n, width):
    rng = random.Random(seed)
    pieces, group, anchor = [], [], []
    for g in range(12):
        core = bytes(rng.choices(b"ab", k=2 * width))
        for _ in range(rng.randint(1, n)):
            left = rng.randint(0, 9)
            p = bytearray(core[9 - left:9 - left + width + rng.randint(0, 9)])
            if rng.random() < 0.5:
                p[rng.randrange(len(p))] ^= 1
            pieces.append(bytes(p))
            group.append(g)
            anchor.append(left + 10)
    return pieces, np.array(group), np.array(anchor), np.array([len(p) - width + 1 for p in pieces])


@pytest.mark.parametrize("base", [None, 1])
@pytest.mark.parametrize("width", [8, 40, 61])
def test_sorted_shard_equals_counting(base, width):
    """Base 1 makes the prefix hashes sums of bytes, which collide all the time; the check of neighbours mends that."""
    pieces, group, anchor, n = shards(width, 20, width)
    count = {}
    windows = [[(g, a - i, p[i:i + width]) for i in range(k)] for p, g, a, k in zip(pieces, group, anchor, n)]
    for w in windows:
        for x in w:
            count[x] = count.get(x, 0) + 1
    marks = suffix_dedup.repeated(pieces, group, anchor, n, width, base)
    assert [m.tolist() for m in marks] == [[count[x] > 1 for x in w] for w in windows]


def test_merges_sort(spark):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    at = rng.permutation(4900)[:2000]
    first, last = np.repeat([0, 7, 8, 1000], [7, 1, 992, 1000]), np.repeat([7, 8, 1000, 2000], [7, 1, 992, 1000])
    order = suffix_dedup.merge_sorted(data, at, first, last, 64)
    raw = data.tobytes()
    for a, b in ((0, 7), (7, 8), (8, 1000), (1000, 2000)):
        assert [raw[i:i + 64] for i in order[a:b]] == sorted(raw[i:i + 64] for i in at[a:b])


def test_null_and_repeated_ids_empty_table_clashing_names(spark):
    t = texts_of(3, 4)
    rows = [(None, t[0], "a", 1), (None, t[1], "b", 2), (7, t[2], "c", 3), (7, t[2], "d", 4), (8, t[3], "e", 5), (9, None, "f", 6)]
    df = suffix_dedup.dedup_bytes(spark.createDataFrame(rows, SCHEMA + ", g string, marks long"), 48)
    want = brute([r[1] for r in rows], 48)
    assert sorted((str(r[0]), *r[1:4], bytes(r[4])) for r in df.collect()) == sorted((str(r[0]), *w) for r, w in zip(rows, want))
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    assert suffix_dedup.dedup_bytes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_text(spark):
    rng = random.Random(4)
    p = "".join(rng.choices("abcdefgh ", k=500))
    text = "".join(rng.choices("abcdefgh ", k=1_500_000)) + p
    out = got(spark.createDataFrame([(1, text), (2, p)], SCHEMA), 200)
    assert out[1][:3] == (1_500_500, 500, 1) and out[2] == (500, 500, 1, b"")
