"""Toxicity by compression distance: which of two trained Zstandard dictionaries shortens a window more?

Windows are about WINDOW characters of lower-case text, cut at white space; two spaces part their words,
so that a short stem at the start of a word is long enough for the trainer. Toxic texts are mostly made
of ordinary windows, so the windows that make them toxic are found in PASSES passes, each by
Zstandard's own trainer and by compressed lengths alone. The toxic texts are dealt to FOLDS folds; for each
a dictionary is trained on what is chosen from the others (at first all windows), a counterweight is
trained likewise on what that dictionary shortens in ordinary text, and of the fold's windows that the
toxic dictionary shortens beyond the counterweight those words are chosen without which it doesn't. What
recurs in other toxic texts and not in ordinary ones is chosen again by every pass, all else fades. The
counterweight is half as large as what it counters, so what is merely rarer in ordinary text stays.

What the last passes chose then trains pairs of dictionaries of several sizes (SIZES): the ordinary one holds the
counterweight and a dictionary of ordinary windows, the toxic one the same after what toxic windows
train, so on ordinary text both lengths agree. They are joined as contents, as a compressor takes one dictionary.
Training uses half of the ordinary texts. A logistic score over the distribution of a text's differences is
calibrated on the other half, which no dictionary has seen, and on the toxic texts; at most FALSE_ALARMS of
the former may reach 0.3. The sample is
bounded: `most_each` texts of each label (twice as many ordinary ones) by a hash of their ids; a text of
over SAMPLE_CHARS characters takes part with that many, in pieces spread over all of it. Scoring takes
every window of every text.

Cases: null and empty texts have no window and get the score of that; repeated rows get equal scores;
of several labels for an id the largest counts; without labels of both kinds, or without any window
that tells them apart, every score is 0. Null ids are scored like others and never trained on.
Further columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from siftwell.llm.labelled import SAMPLE_CHARS, chance, logistic, sample
from siftwell.llm.labelled import held_out as _held_out

WINDOW, FOLDS, PASSES, LAST_PASSES = 48, 4, 5, 3
#: Bytes of the dictionary of ordinary windows, of the dictionaries of a pass, and of the pairs that score.
ORDINARY_BYTES, PASS_BYTES, SIZES = 16_000, 4000, (1000, 2000, 4000)
#: Share of ordinary texts whose score may reach 0.3 in calibration, and the logit of that.
FALSE_ALARMS, LINE = 0.02, float(np.log(0.3 / 0.7))
#: Bytes by which a window must become shorter, and by which a word must matter to that, to be chosen.
LEAST_GAIN = 2
_WINDOWS = re.compile(r"(?s).{%d}[^\x20\x09-\x0D]{0,40}\s?|.+" % WINDOW)
_PARAMS = zstandard.ZstdCompressionParameters.from_level(6, window_log=17, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)


def windows(text: str) -> list[bytes]:
    """Lower-case windows of a text as UTF-8, with two spaces at both ends of each word."""
    return [f"  {'  '.join(w.split())}  ".encode("utf-8", "replace") for w in _WINDOWS.findall(text.lower())]


# ---------------------------------------------------------------- training


def trained(samples: list[bytes], size: int, k: int = 16, d: int = 6) -> bytes:
    """A dictionary trained by Zstandard; few long samples are cut into halves until it takes them, and it is empty where they are too few for that."""
    for _ in range(4):
        try:
            return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
        except zstandard.ZstdError:
            samples = [half for s in samples if len(s) >= 32 for half in (s[: len(s) // 2], s[len(s) // 2 :])]
    return b""


def compressor(*contents: bytes) -> Callable[[bytes], bytes]:
    """Compresses after a dictionary of the given contents."""
    content = b"".join(contents)
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=_PARAMS).compress
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=_PARAMS)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=_PARAMS).compress


def chosen(texts: list[list[bytes]], plain: Callable, marked: Callable, rng: random.Random) -> list[bytes]:
    """For each text (windows) the words that `marked` shortens beyond `plain`, as one sample.

    Bytes that no text has and that don't recur part the words, so that the trainer takes whole ones.
    """
    out = []
    for parts in texts:
        own = []
        for w in parts:
            gain = len(plain(w)) - len(marked(w))
            if gain < LEAST_GAIN:
                continue
            words = w.strip().split(b"  ")
            for i, word in enumerate(words):
                rest = b"  " + b"  ".join(words[:i] + words[i + 1 :]) + b"  "
                if gain - (len(plain(rest)) - len(marked(rest))) >= LEAST_GAIN:
                    own.append(bytes(rng.choices(range(1, 9), k=10)) + b"  " + word + b"  ")
        if own:
            out.append(b"".join(own))
    return out


@dataclass
class Model:
    """Pairs of an ordinary and a toxic dictionary, and a logistic score; small enough to travel with each task."""

    pairs: list[tuple[bytes, bytes]]
    weights: list[float]

    def compressors(self) -> list[tuple[Callable, Callable]]:
        return [(compressor(a), compressor(b)) for a, b in self.pairs]


def differences(parts: list[bytes], pairs: list[tuple[Callable, Callable]]) -> list[float]:
    """By how many bytes the toxic dictionaries shorten each window more than the ordinary ones, on average."""
    return [sum(len(a(w)) - len(b(w)) for a, b in pairs) / len(pairs) for w in parts]


def features(diffs: list[float]) -> list[float]:
    """The three largest differences, their positive and whole sums and how many exceed 1 to 4 bytes, absolute and by length."""
    n, up = max(1, len(diffs)), sum(max(0, x) for x in diffs)
    top = [min(max(x, 0), 20) for x in sorted(diffs, reverse=True)[:3]] + [0, 0, 0]
    out = [1.0, *top[:3], np.log1p(up), up / n, sum(diffs) / n**0.5, up / n**0.5]
    for least in (1, 2, 3, 4):
        hits = sum(x > least for x in diffs)
        out += [np.log1p(hits), hits / n**0.5]
    return [float(x) for x in out]


def train(toxic: list[str], ordinary: list[str], toxic_weight: float = 1.0, seed: int = 1) -> Model | None:
    """A model from labelled texts, or None where nothing tells them apart. toxic_weight: how many rows a toxic text stands for."""
    if not toxic or not ordinary:
        return None
    rng = random.Random(seed)
    flat = lambda texts: [w for parts in texts for w in parts]
    bad, good = [windows(t) for t in toxic], [windows(t) for t in ordinary]
    base = trained(flat(good[::2]), ORDINARY_BYTES, 200, 8)
    plain = compressor(base)

    def counterweight(own: bytes, texts: list[list[bytes]], size: int) -> bytes:
        found = chosen(texts, plain, compressor(own, base), rng)
        return trained(found, size // 2) if found else b""

    folds, half = [bad[i::FOLDS] for i in range(FOLDS)], [good[::2][i::FOLDS] for i in range(FOLDS)]
    samples, last = [flat(f) for f in folds], []
    for n in range(PASSES):
        found = []
        for h in range(FOLDS):
            own = trained([s for i in range(FOLDS) if i != h for s in samples[i]], PASS_BYTES)
            against = counterweight(own, half[h], PASS_BYTES)
            found.append(chosen(folds[h], compressor(against, base), compressor(own, against, base), rng))
        samples = found
        last += flat(found) if n >= PASSES - LAST_PASSES else []
    model = Model([], [])
    for size in SIZES:
        own = trained(last, size)
        against = counterweight(own, good[::2], size) if own else b""
        model.pairs.append((against + base, own + against + base))
    if any(len(b) == len(a) for a, b in model.pairs):
        return None
    pairs, rest = model.compressors(), good[1::2] or good
    x = [features(differences(parts, pairs)) for parts in bad + rest]
    y = [1.0] * len(bad) + [0.0] * len(rest)
    x, y = np.array(x), np.array(y)
    # toxic rows weigh what keeps the labels' proportion
    model.weights = logistic(x, y, np.where(y == 1, toxic_weight * len(rest) / len(good), 1.0))
    alarm = float(np.quantile(x[y == 0] @ np.array(model.weights), 1 - FALSE_ALARMS, method="higher"))
    model.weights[0] -= max(0.0, alarm - LINE)
    return model


# ---------------------------------------------------------------- tables


def held_out(id_col: Column, mod: int = 4, rest: int = 2) -> Column:
    return _held_out(id_col, mod, rest)


def fit(docs: DataFrame, labels: DataFrame, most_each: int = 1500) -> Model | None:
    """A model from at most most_each texts of each label (twice as many ordinary ones) that aren't held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["label"]: r["n"] for r in known.collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    texts = sample(docs, labels, "toxic", held_out(F.col("doc_id")), {1: most_each, 0: 2 * most_each})
    if not texts[1] or not texts[0]:
        return None
    return train(texts[1], texts[0], toxic_weight=counts[1] / counts[0] * len(texts[0]) / len(texts[1]))


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with the columns toxic_score (0 to 1) and toxic_windows (windows that the toxic dictionaries shorten by more than a byte); other columns stay."""
    fields = [f for f in docs.schema.fields if f.name not in ("toxic_score", "toxic_windows")]
    if model is None:
        return docs.select(*[f"`{f.name}`" for f in fields]).withColumns({"toxic_score": F.lit(0.0), "toxic_windows": F.lit(0).cast("long")})
    at = [f.name for f in fields].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = model.compressors()
        for batch in batches:
            rows, hits = [], []
            for text in batch.column(at):
                diffs = differences(windows(text.as_py() or ""), pairs)
                rows.append(features(diffs))
                hits.append(sum(d > 1 for d in diffs))
            scores = chance(model.weights, np.array(rows)) if rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(hits, pa.int64())], [*batch.schema.names, "toxic_score", "toxic_windows"])

    schema = StructType([*[StructField(f.name, f.dataType, True) for f in fields], StructField("toxic_score", DoubleType()), StructField("toxic_windows", LongType())])
    return docs.select(*[f"`{f.name}`" for f in fields]).mapInArrow(run, schema)
