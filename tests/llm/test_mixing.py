import re

import pytest
from pyspark.sql import functions as F

from siftwell.llm import mixing


def _targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again until none is above."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * w[s] / free for s in names}
        over = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    sizes, texts = {}, {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()}
    for s, n in texts.values():
        sizes[s] = sizes.get(s, 0) + n
    want = _targets(sizes)
    taken = {}
    assert len(got) == len(texts)
    for r in got:
        source, size = texts[r.doc_id]
        assert (r.size, r.source_size) == (size, sizes[source]) and r.taken in (0, size, 2 * size, 3 * size)
        assert r.target == pytest.approx(want[source])
        taken[source] = taken.get(source, 0) + r.taken
    for s, t in taken.items():
        largest = max(n for x, n in texts.values() if x == s)
        assert abs(t - want[s]) <= 2 * largest


def test_many_small_documents(spark):
    # a hot source over several levels of the tree; every count is exact up to one document
    df = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    got = mixing.mix(df).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 300_000 and len(got) == 6
    for r in got:
        assert abs(r.taken - r.target) <= 4


def test_unbiased(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i), "a") for i in range(8)] + [(99, "w " * 30, "b")], "doc_id long, text string, source string")
    total, rounds = 0, 40
    for seed in range(rounds):
        rows = mixing.mix(df, seed=seed).where("source = 'a'").collect()
        total += sum(r.copies for r in rows)
        rate = rows[0].target / rows[0].source_size
    assert total / rounds / 8 == pytest.approx(rate, abs=0.15)


def test_edges(spark):
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, "x y z", None, 1), (3, "x y z", None, 1), (None, "x\x0by\x00z w", "b", 1), (5, " \t\n", "empty", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == 6
    assert {(r.doc_id, r.size) for r in got} == {(1, 0), (2, 0), (3, 3), (None, 2), (5, 0)}
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.mix(df.limit(0)).count() == 0


def test_many_equal_rows(spark):
    """Rows equal in id and text are spread over blocks too, and are counted one by one."""
    df = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("x").alias("source"))
    df = df.union(spark.range(20_000).select(F.col("id"), F.lit("a b"), F.lit("y")))
    got = mixing.mix(df).groupBy("source").agg(F.count("*").alias("n"), F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert {r.source: r.n for r in got} == {"x": 40_000, "y": 20_000} and all(abs(r.taken - r.target) <= 6 for r in got)
