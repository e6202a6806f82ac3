"""Jaccard components, decontamination and substring removal against brute force."""
import random

import pytest

from pairlane.llm import decontaminate, jaccard, substrings
from pairlane.llm.common import components


def _corpus(seed, n=60, vocab=30, length=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)]
    docs = [" ".join(rng.choices(words, k=rng.randint(0, length))) for _ in range(n // 2)]
    while len(docs) < n:
        w = rng.choice(docs).split()
        for _ in range(rng.randint(0, 3)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
        docs.append(rng.choice([" ", "\n", "\t "]).join(w))
    docs += [None, "", "Solo", "solo", "É É", "é é", "a b", "A B"]
    return docs


def _fold(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "").split()


def _set(t, k):
    w = _fold(t)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k,threshold,seed", [(3, 90, 1), (5, 80, 2), (2, 60, 3), (3, 80, 4)])
def test_components_equal_brute_force(spark, k, threshold, seed):
    docs = _corpus(seed)
    sets = [_set(t, k) for t in docs]
    comp = list(range(len(docs)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, n long").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, k, threshold).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in range(len(docs))}


def test_components_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, 3, 90).collect())
    assert got == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert jaccard.jaccard_components(df.limit(0), 3, 90).count() == 0
    kept = jaccard.keep_first(df, 3, 90).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 3]


def test_a_chain_of_links_is_one_component(spark):
    words = [f"t{i}" for i in range(80)]
    docs = [" ".join(words[i:i + 40]) for i in range(0, 40)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {r.component_id for r in jaccard.jaccard_components(df, 3, 90).collect()} == {0}


@pytest.mark.parametrize("order", ["shuffled", "smallest last"])
def test_components_of_long_paths(spark, order):
    ids = list(range(400))
    if order == "shuffled":
        random.Random(7).shuffle(ids)
    else:
        ids = ids[1:] + ids[:1]
    paths = [ids, [1000 + i for i in ids[:300]]]
    edges = spark.createDataFrame([(a, b) for p in paths for a, b in zip(p, p[1:])], "a long, b long")
    assert {r.id: r.comp for r in components(edges).collect()} == {i: min(p) for p in paths for i in p}


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    items = {i: " ".join(rng.choices(words, k=rng.randint(3, 60))) for i in range(30)} | {90: "", 91: None, 92: "two words"}
    docs = {}
    for i in range(60):
        w = rng.choices(words, k=rng.randint(0, 400))
        if i % 2:
            item = (items[rng.randrange(30)]).split()
            if i % 4 == 3 and len(item) > 30:
                item[len(item) // 2] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = item
        docs[i] = " ".join(w).upper() if i % 3 == 0 else " ".join(w)
    docs |= {100: None, 101: "", 102: "say Two  Words here"}
    want = set()
    for d, t in docs.items():
        w = _fold(t)
        for j, x in items.items():
            v = _fold(x)
            if not v:
                continue
            k = min(5, len(v))
            a, b = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)}, {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
            if 100 * len(a & b) >= 80 * len(a):
                want.add((d, j, len(a & b), len(a)))
    ddf = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    idf = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for block in (1000, 7):
        got = {tuple(r) for r in decontaminate.contaminated(ddf, idf, block_items=block).collect()}
        assert got == want and len(want) > 20
    assert decontaminate.contaminated(ddf.limit(0), idf).count() == 0 and decontaminate.contaminated(ddf, idf.limit(0)).count() == 0


def _removed(docs, width):
    seen = {}
    for d, w in docs.items():
        for i in range(len(w) - width + 1):
            seen.setdefault(tuple(w[i:i + width]), []).append((d, i))
    gone = {d: set() for d in docs}
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d].update(range(i, i + width))
    return {d: (len(w), len(gone[d]), " ".join(x for i, x in enumerate(w) if i not in gone[d])) for d, w in docs.items()}


@pytest.mark.parametrize("width,hot,seed", [(35, 1000, 1), (12, 1000, 2), (12, 1, 3), (5, 2, 4), (70, 1000, 5)])
def test_substrings_equal_brute_force(spark, monkeypatch, width, hot, seed):
    monkeypatch.setattr(substrings, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 300)
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(40)] + ["é", "A", "a"]
    passages = [rng.choices(words, k=rng.randint(width // 2, 3 * width)) for _ in range(8)]
    docs = {}
    for d in range(40):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choices(words, k=rng.randint(0, 60)) + rng.choice(passages)
        docs[d] = w
    docs[40], docs[41], docs[42] = ["x"] * (3 * width), ["y", "z"] * width, docs[3]
    sep = [" ", "\n", "\t", "  "]
    rows = [(d, "".join(x + rng.choice(sep) for x in w), "k") for d, w in docs.items()] + [(50, None, "k"), (51, "", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.dedup_substrings(df, width).collect()}
    assert got == _removed(docs | {50: [], 51: []}, width)


def test_substrings_of_odd_ids(spark):
    t = " ".join(f"q{i}" for i in range(20))
    df = spark.createDataFrame([(1, t), (1, t), (None, "a b"), (2, "c")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in substrings.dedup_substrings(df, 12).collect())
    assert got == [(0, 2, 0, "a b"), (1, 20, 20, ""), (1, 20, 20, ""), (2, 1, 0, "c")]
    assert substrings.dedup_substrings(df.limit(0), 12).count() == 0


def test_sets_of_a_batch_leave_it_in_pieces():
    """Long texts of one Arrow batch pass in pieces of about a million characters, in order and complete; the word cache is bounded."""
    import pandas as pd
    from pairlane.llm import jaccard
    texts = ["a" * 400_000] * 7 + [None, ""]
    got = [(list(i), t) for i, t in jaccard.pieces([pd.DataFrame({"doc_id": range(9), "text": texts})])]
    assert [i for ids, _ in got for i in ids] == list(range(9)) and [t for _, ts in got for t in ts] == texts
    assert max(sum(len(t or "") for t in ts) for _, ts in got) <= 1_400_000
    words = jaccard.WordHash(100)
    assert all(words[b"%d" % i] == jaccard.WordHash()[b"%d" % i] for i in range(1000)) and len(words) <= 100


def test_groups_that_only_quote_a_passage_do_not_meet(spark, monkeypatch):
    words = lambda a, n: [f"{a}x{i}" for i in range(n)]
    quoting = [" ".join(words(d, 300) + words("q", 24)) for d in range(30)]
    copy = quoting[0].split()
    copy[5] = "other"
    df = spark.createDataFrame(list(enumerate([*quoting, " ".join(copy)])), "doc_id long, text string")
    postings, plain = [], jaccard.stage_dropping

    def counted(df, name, *used):
        out = plain(df, name, *used)
        if name == "postings":
            postings.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stage_dropping", counted)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df, 5, 80).collect()}
    assert got == {i: i for i in range(30)} | {30: 0}
    assert postings[-1] == 0


def test_strays_of_a_family_of_copies_lie_in_its_cluster(spark, monkeypatch):
    """Copies with many edits share enough prefix shingles with the family's smallest member, but too far from their places there to link with it."""
    base = [f"b{i}" for i in range(300)]

    def edited(d, n):
        w = list(base)
        for j in range(n):
            w[7 + (300 // n) * j + d % 20] = f"e{d}x{j}"
        return " ".join(w)

    docs = {0: " ".join(base)} | {d: edited(d, 2) for d in range(1, 21)} | {d: edited(d, 8) for d in range(100, 120)}
    postings, plain = [], jaccard.stage_dropping

    def counted(df, name, *used):
        out = plain(df, name, *used)
        if name == "postings":
            postings.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stage_dropping", counted)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), 5, 80).collect()}
    assert got == {d: 0 if d < 100 else d for d in docs}
    assert postings[0] > 0 and postings[-1] == 0


def test_shared_postings_equal_brute_force(spark):
    rng = random.Random(5)
    tokens = list(range(60)) + [(rng.randint(1, 30) << jaccard.CROWD_BIT) + i for i in range(40)]
    rows = [(g, 9, sorted(rng.sample(tokens, rng.randint(0, 12)))) for g in range(30)]
    df = spark.createDataFrame(rows, "gid long, n long, prefix array<long>").repartition(3)
    held = [t for *_, p in rows for t in p]
    want = sorted((g, n, i, t) for g, n, p in rows for i, t in enumerate(p) if held.count(t) > 1)
    assert sorted(map(tuple, jaccard.shared_postings(df).select("gid", "n", "i", "tok").collect())) == want
    assert 0 < len(want) < len(held)
