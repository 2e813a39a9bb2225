"""Quality by compression: does a dictionary trained on good text shorten a text more than one trained on bad text?

Texts are cut into windows of about WINDOW bytes of UTF-8 at white space. Two Zstandard dictionaries are trained
by its own trainer on windows of good and of bad labelled texts, and each window is compressed with
either. The difference of the compressed sizes, over the window's bytes, is what the score goes by:
its mean over the text (drawn to 0 in short ones), the largest and smallest of a window, the share of
windows that the bad dictionary shortens more, and the better of both sizes over the text's bytes (text that
repeats itself is short by either).

A logistic score over these is calibrated on texts that their dictionaries haven't seen: texts are dealt to FOLDS
folds, and the sizes of a fold's texts come from dictionaries of the other folds. Scoring uses one
pair of dictionaries trained on all folds, and all windows of every text. The labelled sample is bounded:
`most_each` good texts and as many bad ones by a hash of their ids (see labelled.sample).

Cases: null and empty texts have no window and get the score of that; repeated rows get equal scores; of
several labels for an id the largest counts; without labels of both kinds, or with too few for the
trainer, every score is 0.5. Null ids are scored like others and never trained on. Further columns
are kept, and replaced where they have the result's names. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from siftwell.llm.labelled import chance, logistic, sample
from siftwell.llm.labelled import held_out as _held_out

WINDOW, DICTIONARY_BYTES, FOLDS, LEVEL = 256, 32_000, 4, 3
#: Bytes by which the mean of a text is drawn to 0.
SHRINK = 64
_WINDOWS = re.compile(rb"(?s).{%d}[^\x20\x09-\x0D]{0,40}|.+" % WINDOW)


def windows(text: str) -> list[bytes]:
    """Windows of a text as UTF-8, cut at white space where there is any within 40 bytes."""
    return _WINDOWS.findall(text.encode("utf-8", "replace"))


def trained(texts: list[list[bytes]]) -> bytes | None:
    """A dictionary trained by Zstandard on windows of texts, or None where they are too few."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [w for parts in texts for w in parts], k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


class Pair:
    """Compressed sizes under the dictionary of good text and under that of bad text."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.by = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT)
            d.precompute_compress(compression_params=params)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)

    def sizes(self, parts: list[bytes]) -> np.ndarray:
        """(windows, 3): bytes of each window, compressed by the good and by the bad dictionary."""
        good, bad = self.by
        return np.array([(len(w), len(good(w)), len(bad(w))) for w in parts], float).reshape(-1, 3)


def features(sizes: np.ndarray) -> list[float]:
    """What the score goes by, from sizes(); all are relative to lengths."""
    if not len(sizes):
        return [1.0, 0, 0, 0, 0, 0, 0]
    n, good, bad = sizes.T
    each, total = (good - bad) / (n + SHRINK), n.sum()
    mean = (good.sum() - bad.sum()) / (total + SHRINK)
    least = np.minimum(good, bad).sum() / (total + SHRINK)
    return [1.0, float(mean), float(each.max()), float(each.min()), float((each > 0).mean()), float(least), float(max(0.0, 0.3 - least))]


@dataclass
class Model:
    """Two dictionaries and a logistic score; small enough to travel with each task."""

    good: bytes
    bad: bytes
    scale: list[float]
    weights: list[float]

    def score(self, rows: list[list[float]]) -> np.ndarray:
        return chance(self.weights, np.array(rows) / np.array(self.scale))


def train(good: list[str], bad: list[str], good_weight: float = 1.0) -> Model | None:
    """A model from labelled texts; good_weight: how many rows a good text stands for."""
    cut = [[windows(t) for t in texts] for texts in (good, bad)]
    x, y = [], []
    for h in range(FOLDS):
        own = [trained([p for i, p in enumerate(texts) if i % FOLDS != h]) for texts in cut]
        if None in own:
            return None
        pair = Pair(*own)
        for label, texts in zip((1.0, 0.0), cut):
            for parts in texts[h::FOLDS]:
                x.append(features(pair.sizes(parts)))
                y.append(label)
    own = [trained(texts) for texts in cut]
    if None in own:
        return None
    x, y = np.array(x), np.array(y)
    scale = x.std(0) + 1e-9
    scale[0] = 1.0
    return Model(*own, list(map(float, scale)), logistic(x / scale, y, np.where(y == 1, good_weight, 1.0)))


def held_out(id_col: Column, mod: int = 3, rest: int = 1) -> Column:
    return _held_out(id_col, mod, rest)


def fit(docs: DataFrame, labels: DataFrame, most_each: int = 2000) -> Model | None:
    """A model from at most most_each texts of each label that aren't held out, weighed as the labels occur."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["label"]: r["n"] for r in known.collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    texts = sample(docs, labels, "quality", held_out(F.col("doc_id")), {1: most_each, 0: most_each})
    if not texts[0] or not texts[1]:
        return None
    return train(texts[1], texts[0], counts[1] / counts[0] * len(texts[0]) / len(texts[1]))


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with the columns quality_score (0 to 1) and bad_windows (windows that the bad dictionary shortens more)."""
    fields = [f for f in docs.schema.fields if f.name not in ("quality_score", "bad_windows")]
    kept = docs.select(*[f"`{f.name}`" for f in fields])
    if model is None:
        return kept.withColumns({"quality_score": F.lit(0.5), "bad_windows": F.lit(0).cast("long")})
    at = [f.name for f in fields].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(model.good, model.bad)
        for batch in batches:
            sizes = [pair.sizes(windows(t.as_py() or "")) for t in batch.column(at)]
            scores = model.score([features(s) for s in sizes]) if sizes else []
            hits = [int((s[:, 1] > s[:, 2]).sum()) for s in sizes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(hits, pa.int64())], [*batch.schema.names, "quality_score", "bad_windows"])

    schema = StructType([*[StructField(f.name, f.dataType, True) for f in fields], StructField("quality_score", DoubleType()), StructField("bad_windows", LongType())])
    return kept.mapInArrow(run, schema)
