import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from siftwell.llm import chunks, hmm, queries


def _model(k=3, c=5, seed=0):
    r = np.random.default_rng(seed)
    n = lambda x: x / x.sum(-1, keepdims=True)
    return hmm.Hmm(n(r.random(k)), n(r.random((k, k))), n(r.random((k, c))))


def _paths(m, obs, start):
    """(probability, expected counts) over all state paths."""
    k, c = m.emit.shape
    total, starts, move, emit = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros((k, c))
    for path in itertools.product(range(k), repeat=len(obs)):
        p = start[path[0]] * math.prod(m.move[a, b] for a, b in zip(path, path[1:])) * math.prod(m.emit[s, o] for s, o in zip(path, obs))
        total += p
        starts[path[0]] += p
        for a, b in zip(path, path[1:]):
            move[a, b] += p
        for s, o in zip(path, obs):
            emit[s, o] += p
    return total, starts / total, move / total, emit / total


@pytest.mark.parametrize("segment, at_once", [(128, 8192), (2, 8192), (1, 3), (3, 2)])
def test_likelihood_and_counts_against_all_paths(monkeypatch, segment, at_once):
    """Texts shorter and longer than a segment: the counts are those of whole texts."""
    monkeypatch.setattr(hmm, "SEGMENT", segment)
    monkeypatch.setattr(hmm, "AT_ONCE", at_once)
    m, texts = _model(), [[0, 3, 1, 4, 2, 2], [1], [4, 4, 0], [2, 0]]
    obs, lens = np.array(sum(texts, [])), np.array([len(t) for t in texts])
    want = [_paths(m, t, m.start) for t in texts]
    assert hmm.log_likelihoods(m, obs, lens) == pytest.approx([math.log(w[0]) for w in want])
    got = hmm.expected_counts(m, obs, lens)
    assert got[:3] == pytest.approx(sum(w[1] for w in want))
    assert got[3:12] == pytest.approx(sum(w[2] for w in want).ravel())
    assert got[12:27] == pytest.approx(sum(w[3] for w in want).ravel())
    assert got[-1] == pytest.approx(sum(math.log(w[0]) for w in want))


def test_long_texts_cross_segments(monkeypatch):
    m, obs = _model(seed=4), np.random.default_rng(1).integers(0, 5, 1000)
    u, log = m.start.copy(), 0.0
    for o in obs:
        u = (u * m.emit[:, o]) @ m.move
        log += math.log(u.sum())
        u /= u.sum()
    assert hmm.log_likelihoods(m, obs, np.array([1000])) == pytest.approx([log])
    monkeypatch.setattr(hmm, "AT_ONCE", 2)
    assert hmm.log_likelihoods(m, obs, np.array([300, 1, 699]))[0] < 0
    assert hmm.log_likelihoods(m, np.concatenate([obs, obs[:5]]), np.array([1000, 5]))[0] == pytest.approx(log)


def test_training_raises_the_likelihood(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    one, four = (hmm.score_corpus(docs, iterations=i).agg({"score": "sum", "base_score": "sum"}).first() for i in (0, 4))
    assert four["sum(score)"] > one["sum(score)"] and four["sum(score)"] > four["sum(base_score)"]


def test_base_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_CHARS", 40_000)

    d = "/root/testdata/sf0.001"
    tokens = {r.doc_id: [*(w.decode() for w in (r.text or "").encode().lower().split()), "\n"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = count.total(), len(count)
    got = queries.op8_hidden_markov_scores(spark, d).collect()
    assert len(got) == len(tokens)
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(w in count for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
        assert math.isfinite(r.score)


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "A a\x0bÉ  b", 0), (3, "A a\x0bÉ  b", 0), (None, "w " * 100_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = hmm.score_corpus(df).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 100_001), (1, 1), (2, 1), (3, 5), (3, 5)]
    assert all(math.isfinite(r.score) and r.base_score <= 0 for r in got)
    assert hmm.score_corpus(df.limit(0)).count() == 0
    from pyspark.sql import functions as F

    assert {r.n_known for r in hmm.score_corpus(df, training=F.lit(False)).collect()} == {0}
