"""Packing and token attribution against the tokenizers themselves."""
import random
import zlib

import numpy as np
import pytest

from pairlane.llm import packing, token_counts
from pairlane.llm.queries import token_pattern, tokenizer_file
from pairlane.llm.tokenizing import WordTokenizer, byte_tokenizer

WORDS = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_file(WORDS))
    return lambda s: t.encode(s, add_special_tokens=False).ids


TEXTS = ["", None, "Hello, World's  end x", "zzz the of a", "<|endoftext|> a <|startoftext|>x", "é é É ΑΣ ΣΑΣ", "a\x1cb \x85 c d", "12345 !!!??? 日本語 🙂👍🏽", "don't we'll I'M", "x" * 300, " \n ", "a###b %%% &&&c", "́alone ​ zero"]


def test_word_by_word_ids_are_whole_text_ids(plain):
    t = WordTokenizer(tokenizer_file(WORDS))
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choices([x for x in TEXTS if x], k=5)) for _ in range(30)]
    for x in texts + texts:
        assert np.frombuffer(t.ids(x), "<u4").tolist() == (plain(x) if x else [])


def test_plan_uses_up_any_histogram():
    rng = np.random.default_rng(2)
    for bins in (8, 32):
        for h in (rng.integers(0, 50, bins), np.eye(bins, dtype=int)[bins - 1] * 7, np.eye(bins, dtype=int)[bins // 2] * 9, rng.integers(0, 2, bins) * 10 ** 9, np.ones(bins, int)):
            used = np.zeros(bins, np.int64)
            for pattern, times in packing.plan(h):
                assert times > 0 and sum(k * v for k, v in pattern.items()) <= bins
                for k, v in pattern.items():
                    used[k - 1] += v * times
            assert (used == h).all()


def test_least_squares_meets_its_conditions():
    patterns = packing.combinations(16)
    h = np.random.default_rng(0).integers(1, 100, 16).astype(float)
    x = packing.solve_nnls(patterns, h, steps=4000)
    a = np.zeros((16, len(patterns)))
    for j, p in enumerate(patterns):
        for k, v in p.items():
            a[k - 1, j] = v
    g = a.T @ (a @ x - h)
    assert (x >= 0).all() and g.min() > -0.5 and abs(g @ x) < 1e-3 * (h @ h)


def test_pieces_rebuild_every_document(spark, plain):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choices(["the", "of", "strange", "wordlike", "é"], k=rng.choice([3, 30, 60, 126, 127, 128, 500]))) for _ in range(120)]
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [rows[-1], rows[-1], (None, "null id", 1)], "doc_id long, text string, bin int").repartition(3)
    out = packing.pack_documents(df, tokenizer_file(WORDS), window=128, grain=4).toPandas()
    last = len(texts) - 1
    for i, t in enumerate(texts):
        ids = np.array((plain(t) if t else []) + [2], "<u4")
        own = out[out.doc_id == i].sort_values("start")
        copies = 3 if i == last else 1
        assert own.length.sum() == copies * len(ids) and (own.doc_tokens == len(ids)).all()
        assert own.drop_duplicates("start").length.sum() == len(ids)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    lengths = []
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 128
        lengths.append(int(g.length.sum()))
    assert sum(packing.padding(n, 128) for n in lengths) < 0.1 * sum(lengths)
    assert packing.pack_documents(df.limit(0), tokenizer_file(WORDS)).count() == 0


def test_attribution_rules_by_hand():
    ends, bounds = np.array([2, 6, 7, 12]), np.array([0, 3, 5, 8])
    n, crossing = token_counts.attribute(ends, bounds)
    assert n.tolist() == [1, 1, 1, 1] and crossing.tolist() == [1, 1, 2, 1]
    assert token_counts.attribute(ends, bounds, "first")[0].tolist() == [2, 0, 2, 0]
    assert token_counts.attribute(ends, bounds, "last")[0].tolist() == [1, 0, 2, 1]
    assert token_counts.attribute(np.array([], int), bounds)[0].tolist() == [0, 0, 0, 0]


def test_counts_add_up_and_spans_tile(spark):
    rows = [(1, "en", "one\ntwo three\n\nfour", "s"), (2, None, None, None), (3, "de", "", "x"), (4, "fr", "é🙂\n" * 50, "y"), (4, "fr", "é🙂\n" * 50, "y"), (None, "x", "a\n", "z")]
    df = spark.createDataFrame(rows, "doc_id long, field string, text string, section string")
    args = tokenizer_file("byte_bpe_50k.tiktoken"), token_pattern()
    for rule in token_counts.RULES:
        got = token_counts.count_tokens(df, *args, ["field", "section", "text"], "text", rule).toPandas()
        for d, lang, text, source in [rows[0], rows[2]]:
            whole = "\n".join([lang or "", source or "", text or ""])
            own = got[got.doc_id == d].sort_values(["char_start", "char_end"])
            total = len(byte_tokenizer(*args).ends(whole))
            assert own.n_tokens.sum() == total and (own.doc_tokens == total).all()
            assert own.char_start.tolist() == [0, *own.char_end.tolist()[:-1]] and own.char_end.max() == len(whole)
        assert (got[got.doc_id == 1].field == "text").sum() == 4 and len(got[got.doc_id == 4]) == 2 * 52
    assert token_counts.count_tokens(df.limit(0), *args, ["field"], "field").count() == 0
