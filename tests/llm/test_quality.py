import math
import random
import re

import zstandard
from pyspark.sql import functions as F

from siftwell.llm import quality, queries

_R = random.Random(3)
_WORDS = ["".join(_R.choice(["an", "ter", "ow", "ith", "re", "on", "est", "al"]) for _ in range(_R.randint(1, 3))) for _ in range(500)]


def _text(bad, n=60):
    words = _R.choices(_WORDS, k=n)
    if bad == 1:
        return " ".join(w.upper() + "!!" for w in words)
    return " | ".join(words) if bad == 2 else " ".join(words) + "."


def _rows(n):
    return [(i, _text(_R.choice([1, 2]) if i % 5 == 0 else 0), int(i % 5 != 0)) for i in range(n)]


def test_scores_follow_from_compressed_lengths(spark):
    """Every score again, from one-shot compressions with the model's dictionaries and sums written out."""
    rows = _rows(400) + [(900, None, 1), (901, "", 1), (902, "an " * 5000 + "ÄÖÜ!!", 0), (903, "x" * 3000, 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = quality.train([t for _, t, y in rows if y and t], [t for _, t, y in rows if not y])
    params = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False)
    for content in (model.good, model.bad):
        assert zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT).dict_id()

    def length(window, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(window))

    for r in quality.classify(docs, model).where("doc_id % 20 = 0 or doc_id >= 900").collect():
        raw, cut = (r.text or "").encode(), []
        while raw:
            tail = re.match(rb"[^ \t-\r]{0,40}", raw[256:]).group() if len(raw) > 256 else b""
            cut.append(raw[: 256 + len(tail)])
            raw = raw[256 + len(tail) :]
        assert b"".join(cut) == (r.text or "").encode()
        good, bad, n = [length(w, model.good) for w in cut], [length(w, model.bad) for w in cut], [len(w) for w in cut]
        x = [1, 0, 0, 0, 0, 0, 0]
        if cut:
            each = [(g - b) / (k + 64) for g, b, k in zip(good, bad, n)]
            least = sum(map(min, good, bad)) / (sum(n) + 64)
            x = [1, (sum(good) - sum(bad)) / (sum(n) + 64), max(each), min(each), sum(e > 0 for e in each) / len(each), least, max(0, 0.3 - least)]
        z = sum(w * v / s for w, v, s in zip(model.weights, x, model.scale))
        assert math.isclose(r.quality_score, 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9)
        assert r.bad_windows == sum(g > b for g, b in zip(good, bad))


def test_planted_forms_are_found(spark):
    rows = _rows(900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    scored = quality.classify(docs, quality.fit(docs, labels)).where(quality.held_out(F.col("doc_id"))).collect()
    truth = {i: y for i, _, y in rows}
    assert len(scored) > 200 and sum((r.quality_score >= 0.5) != bool(truth[r.doc_id]) for r in scored) <= 0.01 * len(scored)


def test_given_tables(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    out = queries.op13_quality(spark, d)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    bad, good = [r for r in held if not labels[r.doc_id]], [r for r in held if labels[r.doc_id]]
    assert sum(not r.predicted for r in bad) >= 0.95 * len(bad) > 150
    assert sum(r.predicted for r in good) >= 0.99 * len(good)
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 10000


def test_labels_of_held_out_rows_dont_count(spark):
    rows = _rows(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, turned)


def test_edges(spark):
    rows = _rows(300) + [(1000, None, 0), (1001, "", 1), (None, "AN!! TER!!", 0), (5, "repeated row", 1)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, quality int, quality_score double")
    labels = docs.select("doc_id", "quality").union(spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    model = quality.fit(docs, labels)
    got = quality.classify(docs, model).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "text", "quality", "quality_score", "bad_windows"]
    by_text = {r.text: r.quality_score for r in got}
    assert by_text[None] == by_text[""]
    assert quality.classify(docs.limit(0), model).count() == 0
    assert quality.fit(docs, labels.where("quality = 1")) is None and quality.fit(docs.limit(0), labels) is None
    assert quality.train(["a b"], ["a b"]) is None
    assert {r.quality_score for r in quality.classify(docs, None).collect()} == {0.5}
