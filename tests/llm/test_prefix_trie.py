import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hirelake.llm import prefix_trie
from hirelake.llm.queries import op11_conversation_trie, rebuilt

from .conftest import SF

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(conversations):
    """Rows of the trie of {conv_id: [(role, text), ...]}, node by node."""
    members, kids = defaultdict(list), defaultdict(set)
    members[()] = []
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not kids[node]
        saved[node] += max(0, len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    rows = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(conversations[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        rows.append((min(convs, default=None), len(node), parent, len(convs), len(kids[node]), leaves[node], saved[node], sha))
    return sorted(rows, key=repr)


def plain(rows):
    """Turns of each conversation, ordered, of rows without ties."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}


def plain_rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


@pytest.fixture
def make(spark):
    def made(rows):
        names = "number position of row chunk k1 first kind"  # names the operator uses itself
        return spark.createDataFrame(rows, TURNS).withColumns({n: F.lit(n) for n in names.split()})

    return made


def found(spark, conversations, rows, turnless=()):
    none = spark.createDataFrame([(c,) for c in turnless], "conv_id long")
    return rows(prefix_trie.trie(prefix_trie.digested(conversations), none))


def test_trie_of_the_whole_table(spark, rows):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows(op11_conversation_trie(spark, SF)) == plain_trie(plain_rebuilt(plain(table)))


def test_rebuilt_conversations(make, rows):
    table = [(c, t, "user", f"{c}/{t}") for c, n in ((5, 12), (6, 1), (7, 10), (8, 3), (21, 2), (22, 9), (100, 4)) for t in range(n)]
    turns = rebuilt(prefix_trie.digested(make(table)))
    expected = plain_rebuilt(plain(table))
    lengths = {c: len(t) for c, t in expected.items()}
    assert {r["conv_id"]: r["of"] for r in turns.filter("position = 1").collect()} == {c: n for c, n in lengths.items() if n}
    assert {r["conv_id"] for r in turns.filter("position IS NULL").collect()} == {c for c, n in lengths.items() if not n}
    assert turns.filter("position IS NOT NULL").count() == sum(lengths.values())


def test_nulls_repeats_and_turnless_conversations(spark, make, rows):
    table = [
        (1, None, None, None), (1, 0, "user", "a"), (2, 0, None, ""), (2, 1, "user", "a"), (2, 2, "user", "é" * 5),
        (3, 0, "", None), (3, 1, "user", "b"), (None, 0, "user", "a"), (4, 0, "usera", ""), (5, 0, "user", "a"),
    ]
    expected = plain(table) | {9: [], 8: []}
    assert found(spark, make(table), rows, turnless=(9, 8)) == plain_trie(expected)


def test_equal_rows_are_turns_of_their_own(spark, make, rows):
    table = [(c, 0, "user", "same") for c in (1, 2) for _ in range(3)] + [(3, 0, "user", "same")]
    own = {1: [("user", "same")] * 3, 2: [("user", "same")] * 3, 3: [("user", "same")]}
    assert found(spark, make(table), rows) == plain_trie(own)


def test_turns_of_one_place_have_one_order(spark, make, rows):
    tied = [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "tool", "a")]
    table = tied + [(2, *r[1:]) for r in reversed(tied)]
    nodes = found(spark, make(table), rows)
    assert len(nodes) == 4 and all(n[3] == 2 for n in nodes)


def test_empty_table_has_a_root(spark, make, rows):
    assert found(spark, make([]), rows) == [(None, 0, None, 0, 0, 1, 0, prefix_trie.NOBODY)]


def test_long_chains_wide_nodes_and_common_conversations(spark, make, rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    monkeypatch.setattr(prefix_trie, "IDS_AT_ONCE", 7)
    table = [(1, t, "user", f"t{t}") for t in range(300)] + [(2, t, "user", f"t{t}" if t < 170 else f"u{t}") for t in range(260)]
    table += [(c, 0, "user", "wide") for c in range(10, 60)] + [(c, t, "user", ("wide", f"w{c}")[t]) for c in range(60, 120) for t in range(2)]
    assert found(spark, make(table), rows) == plain_trie(plain(table))


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, make, monkeypatch):
    staged = []
    monkeypatch.setattr(prefix_trie, "stage", lambda df, label, real=prefix_trie.stage: (staged.append(label), real(df, label))[1])
    table = [(1, t, "user", "x" * 40) for t in range(1000)]
    none = spark.createDataFrame([], "conv_id long")
    assert prefix_trie.trie(prefix_trie.digested(make(table)), none).count() == 1001
    assert staged.count("trie-round") <= 14


def test_long_texts_count_in_full(spark, make, rows):
    text = "long " * 400_000
    table = [(1, 0, "user", text), (2, 0, "user", text), (3, 0, "user", text + "!")]
    assert found(spark, make(table), rows) == plain_trie(plain(table))
