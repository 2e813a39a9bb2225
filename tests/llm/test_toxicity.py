import math
import random

import zstandard
from pyspark.sql import functions as F

from siftwell.llm import queries, toxicity

_R = random.Random(5)
_SYLLABLES = ["an", "ter", "ow", "ith", "re", "on", "est", "al", "ing", "ou", "ed", "ly"]


def _word():
    return "".join(_R.choice(_SYLLABLES) for _ in range(_R.randint(1, 4)))


def _text(n, bad=()):
    words = [_word() for _ in range(n)]
    for b in bad:
        words.insert(_R.randrange(n), b)
    return " ".join(words)


def _rows(n):
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        out.append((i, _text(80, [_R.choice(["vilescum", "zudge" + _word(), "Grobnik"]) for _ in range(3)] if toxic else ()), int(toxic)))
    return out


def test_dictionaries_are_trained_and_tell_apart():
    rows = _rows(400)
    model = toxicity.train([t for _, t, y in rows if y], [t for _, t, y in rows if not y])
    assert len(model.pairs) == len(toxicity.SIZES)
    for plain, toxic in model.pairs:  # the toxic one is the ordinary one after what toxic windows trained
        assert toxic.endswith(plain) and len(toxic) > len(plain)
    for w in (b"vilesc", b"zudge", b"grobni"):
        assert any(w in toxic for _, toxic in model.pairs) and not any(w in plain for plain, _ in model.pairs)


def test_scores_follow_from_compressed_lengths(spark):
    """Every score again, from one-shot compressions with dictionaries made anew and sums written out."""
    rows = _rows(200) + [(900, None, 0), (901, "", 0), (902, "an " * 5000 + "vilescum", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train([t for _, t, y in rows if y], [t for _, t, y in rows if not y and t])
    params = zstandard.ZstdCompressionParameters.from_level(6, window_log=17, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)

    def length(window, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(window))

    def cut(text):
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + toxicity.WINDOW)
            while end < len(text) and end < at + toxicity.WINDOW + 40 and text[end] not in " \t\n\v\f\r":
                end += 1
            end += end < len(text) and end - at >= toxicity.WINDOW and text[end] in " \t\n\v\f\r"
            out.append("  " + "  ".join(text[at:end].split()) + "  ")
            at = end
        return [w.encode() for w in out]

    known = {}

    def difference(w):
        if w not in known:
            known[w] = sum(length(w, a) - length(w, b) for a, b in model.pairs) / len(model.pairs)
        return known[w]

    for r in toxicity.classify(docs, model).collect():
        d = sorted((difference(w) for w in cut((r.text or "").lower())), reverse=True)
        n, up = max(1, len(d)), sum(x for x in d if x > 0)
        x = [1, *[min(max(v, 0), 20) for v in (d + [0, 0, 0])[:3]], math.log(1 + up), up / n, sum(d) / n**0.5, up / n**0.5]
        for least in (1, 2, 3, 4):
            k = len([v for v in d if v > least])
            x += [math.log(1 + k), k / n**0.5]
        z = sum(w * v for w, v in zip(model.weights, x))
        assert math.isclose(r.toxic_score, 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9)


def test_long_labelled_texts_take_part(spark):
    long = [(i, _text(6000, ["zudgeter"] * 40 if i % 2 else ()), i % 2) for i in range(0, 16)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in long], "doc_id long, text string")
    assert min(len(t) for _, t, _ in long) > toxicity.SAMPLE_CHARS
    assert toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in long], "doc_id long, toxic int")) is not None


def test_planted_words_are_found(spark):
    rows = _rows(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    scored = toxicity.classify(docs, toxicity.fit(docs, labels)).withColumn("held", toxicity.held_out(F.col("doc_id"))).where("held").collect()
    truth = {i: y for i, _, y in rows}
    assert len(scored) > 100
    wrong = [r.doc_id for r in scored if (r.toxic_score >= 0.3) != bool(truth[r.doc_id])]
    assert len(wrong) <= 0.03 * len(scored)
    assert all(0 <= r.toxic_score <= 1 for r in scored)


def test_given_tables(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in queries.op10_toxicity(spark, d).where("held_out").collect() if r.doc_id in labels]
    hit = sum(r.predicted for r in held if labels[r.doc_id])
    alarm = sum(r.predicted for r in held if not labels[r.doc_id])
    assert hit >= 0.8 * sum(labels[r.doc_id] for r in held)
    assert alarm <= 0.02 * len(held)


def test_edges(spark):
    rows = _rows(300) + [(1000, None, 0), (1001, "", 1), (None, "vilescum Grobnik", 1), (0, "zudgeterly vilescum", 1)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, toxic int, toxic_score double")
    labels = docs.select("doc_id", "toxic").union(spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(docs, labels)
    got = toxicity.classify(docs, model).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "text", "toxic", "toxic_score", "toxic_windows"]
    by_text = {r.text: r.toxic_score for r in got}
    assert by_text[None] == by_text[""] and by_text["vilescum Grobnik"] >= 0.3
    assert toxicity.classify(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None and toxicity.fit(docs.limit(0), labels) is None
    assert {r.toxic_score for r in toxicity.classify(docs, None).collect()} == {0.0}
    assert toxicity.train(["a b"], ["a b"]) is None
    long = spark.createDataFrame([(1, "an " * 700_000 + "vilescum Grobnik vilescum")], "doc_id long, text string")
    assert toxicity.classify(long, model).first().toxic_windows >= 1
