import random

import public_tokenizers

from siftwell.llm import bpe, queries, tokencount

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _brute(word, scores, longest):
    best = [(0.0, 0)] + [None] * len(word)
    for e in range(1, len(word) + 1):
        options = [(best[s][0] + scores[word[s:e]], -(best[s][1] + 1)) for s in range(max(0, e - longest), e) if word[s:e] in scores]
        options.append((best[e - 1][0] + tokencount.MISSING, -(best[e - 1][1] + 1)))
        score, n = max(options)
        best[e] = (score, -n)
    return best[-1][1]


def test_shared_prefixes_against_brute_force():
    r = random.Random(2)
    scores = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 5))): -r.random() * 6 for _ in range(60)} | {b"a": -1.0, b"b": -1.5}
    words = sorted({bytes(r.choice(b"abcd") for _ in range(r.randint(0, 12))) for _ in range(3000)})
    trie = tokencount.TrieCounter(scores)
    assert [trie.count(w) for w in words] == [_brute(w, scores, 5) for w in words]
    assert trie.steps < 0.7 * sum(map(len, words))


def test_given_table_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    scores = {p: s for p, s in tokencount.zipf_scores(bpe._ranks(bpe.read_ranks(RANKS))).items() if len(p) <= 24}
    cut, seen = bpe.splitter(public_tokenizers.PATTERN)(), {}
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        words = cut(r.text or "")
        for w in words:
            if w not in seen:
                seen[w] = _brute(w.encode(), scores, 24)
        want[r.doc_id] = (len(words), sum(seen[w] for w in words))
    assert {r.doc_id: (r.n_pretokens, r.n_tokens) for r in queries.op5_token_counts(spark, d).collect()} == want


def test_longest_pieces_against_brute_force(spark):
    scores = tokencount.zipf_scores(bpe._ranks(bpe.read_ranks(RANKS)))
    cut, longest = bpe.splitter(public_tokenizers.PATTERN)(), max(map(len, scores))
    long = sorted(p.decode() for p in scores if len(p) > 24)
    texts = [t for p in long for t in (p, f"above {p} below", p + p[:7], p * 3)]
    got = tokencount.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS, public_tokenizers.PATTERN)
    want = {i: sum(_brute(w.encode(), scores, longest) for w in cut(t)) for i, t in enumerate(texts)}
    assert len(long) >= 20 and {r.doc_id: r.n_tokens for r in got.collect()} == want
    assert want[texts.index("-" * 64)] == 1


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "hello world", 0), (3, "hello world", 0), (None, "x" * 30_000, 0), (4, "日本", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id or 0, r.n_pretokens, r.n_tokens) for r in tokencount.token_counts(df, RANKS).collect()))
    assert [g[:2] for g in got] == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2), (4, 1)]
    assert got[1][2] == got[2][2] == 0 and got[3] == got[4] and got[0][2] > 1000
    assert tokencount.token_counts(df.limit(0), RANKS).count() == 0
