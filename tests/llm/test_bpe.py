import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from siftwell.llm import bpe, chunks, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ENC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(bpe.read_ranks(RANKS)), special_tokens={})


def test_pattern_is_the_known_one():
    assert bpe.KNOWN_PATTERN == public_tokenizers.PATTERN


def test_split_of_odd_texts():
    r = random.Random(4)
    cut = bpe.splitter(public_tokenizers.PATTERN)()
    parts = ["a", "Zé", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "12", "²", "Ⅷ", "٣", "'s", "'LL", "_", "!?", "日本", "́", "ǅ", "ª", "×", "\U0001f600", "\U000e0041", "​", "\x00", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        words = cut(text)
        assert "".join(words) == text
        assert [i for w in words for i in ENC._core_bpe.encode_single_piece(w.encode())] == ENC.encode_ordinary(text), repr(text)


def test_merging_is_the_librarys():
    r = random.Random(7)
    ranks = bpe._ranks(bpe.read_ranks(RANKS))
    words = [bytes(r.choice(b"aest -=\xe6\x97") for _ in range(r.randint(1, 60))) for _ in range(3000)]
    words += [b"a" * n for n in range(1, 200)] + [b"=" * 5000, b"ab" * 4000, b" " * 333, bytes(range(256))]
    for w in words:
        assert bpe.merged(w, ranks) == ENC._core_bpe.encode_single_piece(w), w


def test_decoding_is_a_broadcast_join_without_a_shuffle(spark):
    df = spark.range(3).selectExpr("id doc_id", "array(cast(64 as int)) ids")
    plan = bpe.decode(df, RANKS)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_long_documents_cross_batches(spark):
    sizes = [70_000, 0, 1, 4095, 4096, 4097, 50_000, 8192, 0, 3]
    df = spark.createDataFrame([(i, [64 + (i + j) % 20 for j in range(n)], f"k{i}") for i, n in enumerate(sizes)], "doc_id long, ids array<int>, piece string").coalesce(1)
    ranks = {i: b for b, i in bpe._ranks(bpe.read_ranks(RANKS)).items()}
    rows = bpe.decode(df, RANKS).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(sizes)))
    assert all(bytes(r.decoded) == b"".join(ranks[i] for i in r.ids) and len(r.ids) == sizes[r.doc_id] and r.piece == f"k{r.doc_id}" for r in rows)


def test_given_table(spark):
    d = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = ENC.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op7_bpe_round_trip(spark, d).collect()}
    assert got == want


def test_small_chunks_and_edges(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_CHARS", 50)

    texts = [None, "", "one two three", "one two three", "two three 日本語 <|endoftext|>", "x" * 200_000, " ", "'s 12a"] * 4
    df = spark.createDataFrame([(None if i == 3 else i // 2, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    rows = bpe.decode(bpe.encode(df, RANKS), RANKS).collect()
    assert len(rows) == len(texts)
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.decoded)) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0, (r.text or "").encode()) for r in df.collect())
    assert all(r.ids == ENC.encode_ordinary(bytes(r.decoded).decode()) and r.n_unknown == 0 for r in rows)
    assert bpe.encode(df.limit(0), RANKS).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [50_300, -4, None, 64])], "doc_id long, ids array<int>")
    assert [(r.decoded and bytes(r.decoded), r.n_unknown) for r in bpe.decode(odd, RANKS).orderBy("doc_id").collect()] == [(None, None), (b"", 0), (bytes([97]), 3)]


def test_pack():
    import numpy as np

    x = np.array([0, 1, 255, 256, 70_000, 2**32 - 1], np.uint32)
    assert (chunks.unpack(chunks.pack(x)) == x).all()


@pytest.mark.parametrize("pattern", [r"\S+|\s+", r"."])
def test_other_patterns(spark, pattern):
    df = spark.createDataFrame([(1, "ab cd é")], "doc_id long, text string")
    assert bytes(bpe.decode(bpe.encode(df, RANKS, pattern), RANKS).first().decoded).decode() == "ab cd é"


def _joined_rows(df):
    """Rows that the broadcast join of a plan made in its last run."""
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "BroadcastHashJoin":
            return node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]


@pytest.fixture
def fixed_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_an_id_is_joined_once_a_document(spark, monkeypatch, fixed_plans):
    monkeypatch.setattr(bpe, "IDS_AT_ONCE", 1000, raising=False)
    ranks = {i: b for b, i in bpe._ranks(bpe.read_ranks(RANKS)).items()}
    r = random.Random(5)
    docs = [(i, [r.choice([64, 70, 262, 999_999, 2**40, -1, None]) for _ in range(n)], "x" * 1000) for i, n in enumerate([30_000, 0, 1, 700, 700, 5000])] + [(6, None, None)]
    out = bpe.decode(spark.createDataFrame(docs, "doc_id long, ids array<long>, note string").coalesce(1), RANKS)
    rows = {x.doc_id: x for x in out.collect()}
    assert len(rows) == len(docs)
    for i, ids, note in docs:
        assert (rows[i].ids, rows[i].note) == (ids, note)
        if ids is None:
            assert rows[i].decoded is None and rows[i].n_unknown is None
        else:
            assert bytes(rows[i].decoded) == b"".join(ranks.get(j, b"") for j in ids) and rows[i].n_unknown == sum(j not in ranks for j in ids)
    assert _joined_rows(out) == sum(max(len(set(ids or [])), 1) for _, ids, _ in docs)
