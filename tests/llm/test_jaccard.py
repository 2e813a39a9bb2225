import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import hashes, jaccard, queries


def _brute(rows, words=4, percent=85):
    """rows: (doc_id, text) -> sorted (doc_id, set size, component)."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[find(i)] = min(d, first.get(find(i), d))
    key = lambda t: tuple((x is None, x or 0) for x in t)
    return sorted(((d, len(sets[i]), first.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=key)


def _got(df, **kw):
    return sorted((tuple(r) for r in jaccard.classes(df, **kw).collect()), key=lambda t: tuple((x is None, x or 0) for x in t))


def _corpus(seed, groups, size, spread, alone):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(size)]
        for _ in range(r.randint(2, 12)):
            w = list(base)
            for _ in range(r.choice((0, 1, 1, 2, spread))):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.1:
                w += passage.split()
            out.append(" ".join(w))
    out += [" ".join(word() for _ in range(r.randint(1, 90))) + (" " + passage if r.random() < 0.5 else "") for _ in range(alone)]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_against_brute_force(spark, seed):
    rows = _corpus(seed, 25, 70, 5, 80)
    want = _brute(rows)
    assert len({c for _, _, c in want}) < 0.8 * len(rows)
    assert _got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want


def test_small_blocks(spark, monkeypatch):
    """Groups larger than a block: representatives and visits find the same components."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = _corpus(7, 6, 60, 6, 30)
    chain = "a0 b1 c2 d3 e4 f5 g6 h7 i8 j9 k1 l2 m3 n4 o5 p6 q7 r8 s9 t1 u2 v3 w4 x5 y6 z7 aa bb cc dd ee ff gg hh".split()
    rows += [(1000 + i, " ".join(chain[: 20 + i])) for i in range(14)]  # neighbours link, ends don't
    want = _brute(rows)
    assert sum(c == 1000 for _, _, c in want) > 8
    assert _got(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_homes_of_few_and_of_many_blocks(spark, monkeypatch):
    """All of a few blocks are visited, of many those with a common head: the same components."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "FEW_BLOCKS", 3)
    rows = _corpus(11, 6, 60, 6, 30)
    assert _got(spark.createDataFrame(rows, "doc_id long, text string")) == _brute(rows)


def test_given_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op9_ngram_jaccard(spark, d).collect())
    assert got == _brute(rows)


def test_threshold_is_met_exactly(spark):
    w = [f"w{i}" for i in range(23)]  # 20 shingles; 17 of 20 are 85 percent
    rows = [(1, " ".join(w)), (2, " ".join(w[:20])), (3, " ".join(w[:19])), (5, "x y"), (4, "X\x0by"), (6, "x y z"), (7, "x")]
    assert _got(spark.createDataFrame(rows, "doc_id long, text string")) == _brute(rows)
    assert [c for _, _, c in _brute(rows)][:3] == [1, 1, 1]


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (9, "one two three four five"), (8, "ONE two three four five"), (8, "ONE two three four five"), (None, "one two three four five"), (None, "quite alone here, a b c"), (20, long), (21, long + " end"), (22, "Été à la mer du nord"), (23, "été à la mer du nord")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int")
    assert _got(df) == _brute(rows)
    assert _got(df.limit(0)) == []


def test_trie_against_pairs():
    r = np.random.default_rng(0)
    for _ in range(30):
        base = r.choice(400, 60, replace=False)
        sets = []
        for _ in range(40):
            s = set(base.tolist()) if r.random() < 0.7 else set(r.choice(400, 60, replace=False).tolist())
            sets.append(np.array(sorted((s - set(r.choice(base, 4).tolist())) | set(r.choice(400, 3).tolist()))))
        cls = jaccard.linked_classes(sets, [len(s) for s in sets], 85)
        parent = list(range(40))
        for i in range(40):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(a & b) >= 85 * len(a | b):
                    x, y = parent[i], parent[j]
                    parent = [min(x, y) if p in (x, y) else p for p in parent]
        assert [cls.index(c) for c in cls] == [parent.index(p) for p in parent]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 440)] + [(600, i) for i in range(601, 700)]
    parent = {x: x for e in edges for x in e}
    for u, v in edges:
        a, b = parent[u], parent[v]
        parent = {k: min(a, b) if p in (a, b) else p for k, p in parent.items()}
    got = {x.node: x.label for x in jaccard.components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    assert all(got.get(k, k) == p for k, p in parent.items())


def _family(seed, sets, size, edits):
    """Sets of one base, each with so many shingles of its own instead."""
    r = np.random.default_rng(seed)
    out = []
    for i in range(sets):
        lost = r.choice(size, edits, replace=False)
        out.append(np.sort(np.concatenate([np.arange(edits) + i * edits, sets * edits + np.delete(np.arange(size), lost)])))
    return out


def test_a_family_walks_its_trie_at_once(monkeypatch):
    """The steps over a trie don't grow with the number of sets that walk it."""
    steps, needed = Counter(), jaccard.Trie.needed
    monkeypatch.setattr(jaccard.Trie, "needed", lambda self, a, b: steps.update(n=1) or needed(self, a, b))
    sets = _family(5, 200, 100, 9)  # two share 82 to 91 of 109: few links
    cls = jaccard.linked_classes(sets, [len(s) for s in sets], 85)
    want = list(range(200))
    for i in range(200):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                a, b = want[i], want[j]
                want = [min(a, b) if c in (a, b) else c for c in want]
    assert [cls.index(c) for c in cls] == [want.index(c) for c in want]
    assert steps["n"] <= 3 * 2 * len(sets)


def test_guests_without_possible_links_make_no_visits(spark, monkeypatch):
    """A set shares too little with others for a link of its length: no block is visited, and the components are the same."""
    visits, written = [], jaccard.written

    def counting(df, name, *a):
        out = written(df, name, *a)
        if name == "jaccard-seek":
            visits.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "written", counting)
    r = random.Random(4)
    base = [f"b{i}" for i in range(103)]
    rows = []
    for i in range(24):  # 12 of 100 shingles are a set's own: it keeps 88, a link asks for 92
        w = list(base)
        for j in range(3):
            w[10 + 30 * j + r.randrange(20)] = f"own{i}x{j}"
        rows.append((i, " ".join(w)))
    assert _got(spark.createDataFrame(rows, "doc_id long, text string")) == _brute(rows)
    assert len({c for _, _, c in _brute(rows)}) == len(rows)
    assert visits == [0]


@pytest.mark.parametrize("width", [5, 8])
def test_hashes_are_counted_over_all_chunks(spark, monkeypatch, width):
    """Each document gets its own hashes' counts, and a chunk has at most one pack a bucket."""
    texts = [" ".join(str(7 * i % m) for i in range(40)) for m in range(2, 40)] + [None, "", "7", "7"]
    mask = np.uint64(2 ** (8 * width) - 1)

    def cutter():
        shingles = jaccard.hasher(1)
        return lambda text: (shingles(text), b"n")

    table = hashes.hash_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), cutter, "test_hashes", width, texts=True, chunk_chars=200)
    parts = hashes.counted(table, width)
    n_chunks, buckets = table.count(), hashes.buckets_of(spark)
    assert n_chunks > 6 and parts.count() == parts.select("chunk", "bucket").distinct().count() <= n_chunks * buckets

    def finish(row, lens, own, counts):
        ids, ends = row.column("ids").combine_chunks().flatten(), np.cumsum(lens)
        both = np.stack([own.view(np.int64), counts], 1)
        return pa.table({"doc_id": ids, "got": pa.array([both[a:z].ravel().tolist() for a, z in zip(ends - lens, ends)], pa.list_(pa.int64()))})

    got = {r.doc_id: r.got for r in hashes.reassembled(table, parts, finish, "doc_id long, got array<long>", width).collect()}
    sets = [(jaccard.hasher(1)(t) & mask).view(np.int64).tolist() for t in texts]
    total = Counter(h for s in sets for h in s)
    assert got == {i: [x for h in s for x in (h, total[h])] for i, s in enumerate(sets)}
    places = table.selectExpr("chunk", "posexplode(ids) AS (at, doc_id)").where("doc_id % 5 = 0").select("chunk", "at")
    assert {(r.doc_id, r.text) for r in hashes.texts_at(table, places).collect()} == {(i, t or "") for i, t in enumerate(texts) if i % 5 == 0}


def test_few_packs_a_chunk():
    """Packs of a chunk grow by a quarter of the shuffle partitions."""

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key: "3000")

    assert hashes.buckets_of(Session) == 750
