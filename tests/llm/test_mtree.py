import numpy as np
from pyspark.sql import functions as F

from siftwell.llm import mtree, queries


def _brute(rows, k, every=20):
    """rows: (vec_id, integer vector); every row by itself."""
    out = []
    for i, (q, a) in enumerate(rows):
        if q % every == 0:
            best = sorted((-sum(int(x) * int(y) for x, y in zip(a, b)), c) for j, (c, b) in enumerate(rows) if j != i)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


def test_tree_against_brute_force_and_pruning():
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, (40, 16))
    x = (centres[rng.integers(0, 40, 4000)] + rng.integers(-4, 5, (4000, 16))).astype(np.int64)
    x[100:160] = x[99]  # equal vectors
    tree = mtree.MTree(x)
    q = x[::97]
    best, top = tree.search(q, 10, np.arange(0, 4000, 97))
    for i, row in enumerate(range(0, 4000, 97)):
        s = x @ q[i]
        want = sorted((-int(v), j) for j, v in enumerate(s) if j != row)[:10]
        assert [(-int(a), int(b)) for a, b in zip(top[i], best[i])] == want
    assert tree.compared < 0.7 * len(q) * len(x)


def test_large_numbers():
    x = np.array([[2**40, 3], [2**40, 5], [-(2**40), 2**40], [2**41, 1]], np.int64)
    best, top = mtree.MTree(x).search(x[:1], 2, np.array([0]))
    assert best.tolist() == [[3, 1]] and top.tolist() == [[2**81 + 3, 2**80 + 15]]


def test_given_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [int(np.floor(64 * float(x))) for x in r.embedding]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op3_metric_top_k(spark, d).collect())
    assert got == _brute(rows, 20)


def test_shards_and_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD_ROWS", 64)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 10)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, -0.5] if i % 3 == 0 else [float(x) for x in rng.normal(size=3)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ints = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows]
    assert sorted(tuple(r) for r in mtree.top_k(df, k=7).collect()) == _brute(ints, 7)


def test_bounds_save_comparisons(spark, monkeypatch):
    """In clusters less than half of all pairs are compared, over several shards; on the given tables never more than all."""
    counts = []
    mtree.top_k(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), counts=counts).count()
    made, pairs = counts[0]()
    assert 0 < made <= pairs
    monkeypatch.setattr(mtree, "SHARD_ROWS", 2048)
    monkeypatch.setattr(mtree, "PAGE_ROWS", 20)
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(100, 8)) * 4)[rng.integers(0, 100, 4000)] + rng.normal(size=(4000, 8)) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None] / 4  # embeddings are of one length as a rule
    mtree.top_k(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), counts=counts).count()
    made, pairs = counts[1]()
    assert made < 0.5 * pairs


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (1, [0.5, None]), (2, []), (3, [3.0, 1.0]), (3, [3.0, 1.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    kept = [(0, [64, 128]), (20, [64, 0]), (2, [0, 0]), (3, [192, 64]), (3, [192, 64])]
    assert sorted(tuple(r) for r in mtree.top_k(df, k=20).collect()) == _brute(kept, 20)
    assert mtree.top_k(df.limit(0)).count() == 0
    assert mtree.top_k(df.where("vec_id = 0")).count() == 0
    twice = df.where("vec_id = 0").union(df.where("vec_id = 0")).withColumn("embedding", F.col("embedding"))
    assert [tuple(r) for r in mtree.top_k(twice).collect()] == [(0, 1, 0, 64 * 64 + 128 * 128)] * 2
