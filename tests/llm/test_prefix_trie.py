import hashlib
import random
import zlib

import pytest

from pairlane.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest(), r, x))
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple((x[3], x[4]) for x in sorted(convs.get(c - c % 5, []))[:h] + sorted(turns)[h:])
    members, kids, leaves, saved = {}, {}, {}, {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for s in filter(None, members):
        kids.setdefault(s[:-1], []).append(s)
    for s in sorted(members, key=len, reverse=True):
        below = kids.get(s, [])
        leaves[s] = sum(leaves[k] for k in below) if below else 1
        saved[s] = sum(saved[k] for k in below) + ((len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0)
    ends = lambda s: ",".join(map(str, sorted(c for c in members[s] if len(rebuilt[c]) == len(s))))
    return sorted(((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids.get(s, [])), leaves[s], saved[s], hashlib.sha256(ends(s).encode()).hexdigest())
                   for s, m in members.items()), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("width, piece", [(8, 4096), (3, 2)])
def test_trie_equals_brute_force(spark, monkeypatch, width, piece):
    """Long conversations over many blocks, null and equal turns, repeated rows, ids without a first conversation, several pieces of ends."""
    monkeypatch.setattr(prefix_trie, "WIDTH", width)
    monkeypatch.setattr(prefix_trie, "_SLOTS", [f"t{j}" for j in range(width)])
    monkeypatch.setattr(prefix_trie, "ENDS", piece)
    monkeypatch.setattr(prefix_trie, "CHUNK", piece)
    rng = random.Random(width)
    rows = [(c, t if rng.random() > 0.05 else None, rng.choice(["u", "a", None]), rng.choice(["é", "x", None, "", "long" * 9]))
            for c in range(50) for t in range(rng.choice([0, 1, 2, 5, 9, 17, 40]))]
    rows += [(None, 1, "u", "x"), (3, 1, "u", "x"), (3, 1, "u", "x"), (201, 1, "a", "b"), (207, 1, "a", "b" * 100_000)]
    assert rows_of(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_turns_of_one_conversation_over_several_ranges(spark):
    rows = [(5, t, "u", f"{t % 7}") for t in range(900)] + [(6, t, "u", f"{t % 7}") for t in range(900)]
    assert rows_of(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_empty_table_and_clashing_names(spark):
    assert rows_of(prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA))) == []
    rows = [(1, 0, "u", "x", 9, 9, "z")]
    got = rows_of(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA + ", p long, level long, t0 string")))
    assert got == brute([r[:4] for r in rows])
