import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from siftwell.llm import convtrie, queries
from tests.oracle import connect, differences

SCHEMA = "conv_id long, turn long, role string, text string"


def _by_hand(rows):
    """The nodes by loops over whole conversations."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = turns if c % 5 == 0 else own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not kids[p]
        saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(paths[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _random(seed, n=60):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(n * 2), n):
        for t in range(r.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, r.choice([t, t, None]), r.choice(["user", "user", None]), r.choice(["a", "b", "é", None, ""]) if t > 1 else "hello"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_loops(spark, monkeypatch, seed):
    rows = _random(seed)
    rows += rows[:20] + [(None, 1, "user", "nobody"), (3, -5, "x", "y")]
    want = _by_hand(rows)
    assert max(w[1] for w in want) > 10
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert _rows(convtrie.trie(df)) == want
    monkeypatch.setattr(convtrie, "BLOCK", 3)
    monkeypatch.setattr(convtrie, "PIECE", 2)
    monkeypatch.setattr(convtrie, "MERGED", 2)
    assert _rows(convtrie.trie(df)) == want


def test_hot_conversation_hot_node_and_deep_chains(spark, monkeypatch):
    """One conversation with most turns, one text that most share, and a trunk that each conversation leaves one turn later."""
    monkeypatch.setattr(convtrie, "BLOCK", 64)
    rows = [(1_000_000, i, "user", f"turn {i % 7}") for i in range(3000)]
    rows += [(c, i, "user", "same") for c in range(0, 1500, 5) for i in range(2)]
    for j in range(60):
        rows += [(2_000_000 + 5 * j, i, "user", "trunk") for i in range(j + 1)] + [(2_000_000 + 5 * j, j + 1, "user", f"off {j}")]
    assert _rows(convtrie.trie(spark.createDataFrame(rows, SCHEMA).repartition(8))) == _by_hand(rows)


def test_numbers_go_on_across_partitions(spark):
    rows = [(7, 1, "user", "same")] * 500 + [(8, i, "user", "x") for i in range(50)]
    got = convtrie.numbered(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()
    assert sorted(r.i for r in got if r.conv == 7) == list(range(1, 501)) and sorted(r.i for r in got if r.conv == 8) == list(range(1, 51))


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert convtrie.trie(empty).count() == 0
    # conversation 1 has no turns left: it gives up its first ones and its family's first doesn't exist
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    rows = [(c, 0, None, None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", n_convs string, depth int")
    assert _rows(convtrie.trie(df)) == _by_hand(rows) and len(_by_hand(rows)) == 1


def test_sql_gives_the_same_rows(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op12_conversation_trie(spark, d)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in out.dtypes} == {"bigint", "string"}
    assert differences(out, queries.OP12_SQL, connect(d)) == []
