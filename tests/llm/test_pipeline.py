import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from siftwell.llm import mixing, queries, secrets
from siftwell.llm.common import written
from tests.llm.test_jaccard import _brute
from tests.oracle import connect, differences


D = "/root/testdata/sf0.01"
(_, TOXIC), (_, NEAR), (_, MASK), (_, MIX), (_, ENCODE) = corpus_pipeline.STAGES


@pytest.fixture(scope="module")
def stages(spark):
    """The tables before and after each of the first four stages."""
    out = [spark.read.parquet(f"{D}/documents.parquet")]
    for stage in (TOXIC, NEAR, MASK, MIX):
        out.append(written(stage(spark, out[-1], D), "test"))
    return out


def _labelled(spark):
    return {r.doc_id: r.toxic for r in spark.read.parquet(f"{D}/labels.parquet").collect()}


def test_toxicity_keeps_clean_documents(spark, stages):
    kept, labels = {r.doc_id for r in stages[1].collect()}, _labelled(spark)
    assert stages[1].columns == stages[0].columns
    clean = [i for i, t in labels.items() if t == 0]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)


def test_toxicity_rejects_toxic_documents(spark, stages):
    kept, labels = {r.doc_id for r in stages[1].collect()}, _labelled(spark)
    assert sum(i in kept for i, t in labels.items() if t == 1) <= 0.4 * sum(labels.values())


def test_near_copies(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({c for _, _, c in _brute(rows, 5, 80)})


def test_masked_secrets(stages):
    assert stages[3].count() == stages[2].count()
    before = {r.doc_id: r.text for r in stages[2].collect()}
    for r in stages[3].collect():
        assert r.n_chars == len(r.text) and not secrets.base_spans(r.text)
        if not secrets.base_spans(before[r.doc_id]) and "<format>" not in r.text:
            assert r.text == before[r.doc_id]


def test_mixed_sources(stages):
    want = Counter({r.doc_id: r.copies for r in mixing.mix(stages[3]).collect() if r.copies})
    got = Counter(r.doc_id for r in stages[4].collect())
    assert stages[4].columns == stages[0].columns and set(got) <= {r.doc_id for r in stages[2].collect()} and max(got.values()) <= 3
    assert abs(got.total() - want.total()) <= 0.1 * want.total()


def test_encoded_texts(spark, stages):
    texts = Counter(hashlib.sha256(r.text.encode()).hexdigest() for r in stages[4].collect())
    assert Counter(r.decoded_sha256 for r in ENCODE(spark, stages[4], D).collect()) == texts


def test_nulls_and_repeats(spark):
    rows = [(1, None, "en", None, 0), (2, "", "en", "a", 0), (3, "one two three four five six", None, "a", None), (3, "one two three four five six", None, "a", None), (None, "password=abcdef1234 here and there we go", "en", "b", 3), (None, "alone without an id", "en", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, "/root/testdata/sf0.001"), "test")
    assert all(r.doc_id in (None, 1, 2, 3) for r in docs.collect())
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_rows_are_judged_by_their_own_texts(spark):
    first, other, third = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(1, first), (1, other), (2, first + " more"), (2, third), (2, third), (None, third + " more"), (None, "x y z"), (None, "X y z"), (None, "u v w"), (5, ""), (6, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, (r.text or "").lower()) for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect())
    assert got == Counter([(1, first), (1, other), (2, third), (None, "x y z"), (None, "u v w"), (5, ""), (6, ""), (None, "")])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_equal_those_of_sql(spark, name):
    d = "/root/testdata/sf0.01" if name.startswith("op1_") else "/root/testdata/sf0.001"
    assert differences(queries.queries()[name](spark, d), queries.oracle_sql()[name], connect(d)) == []


def test_equal_rows_of_one_text(spark):
    """Many equal rows without an id or a text are one row, and meet no more rows than there are."""
    rows = [(None, "", "en", "a", 0)] * 400 + [(1, "one two three four five six seven", "en", "a", 9)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()) == [0, 1]
