"""Language-model scores: unigram counts of the whole corpus and a hidden Markov model over word classes.

Words are lower-cased (A-Z) and counted over all training documents in a shuffle of each chunk's
distinct words. A word's class follows from its form (ending, length, script); the model's latent
states emit classes, and a class emits its words by their counts, so that

    P(text) = sum over state paths of prod a(s', s) b_s(class of w) * prod P(w | class of w).

`train` runs Baum-Welch: each partition of the written class sequences adds up its expected counts
and their sums over all partitions give the next model (in whole multiples of 2^-UNIT_BITS, so that the
order of sums doesn't matter). `scores` computes the exact likelihood of each text. Both recursions run
over whole texts: a segment of SEGMENT tokens, from every state at once, is a K x K matrix; these are made
for all segments in lockstep and multiplied along the document, from its start for what is known before
a segment and from its end for what comes after; within segments the scaled forward and backward
recursions go on from there, again in lockstep.

Each text ends with one end token, which is a class of its own. The base score is the add-one
unigram model's. Cases: null and empty texts are the end token alone; repeated rows and null ids are
documents of their own (a null id counts as an empty text in the hash); without training documents
all counts are 0 and the model stays as initialised. Empty tables give empty results; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm import chunks
from siftwell.llm.common import written

CLASSES, SEGMENT, AT_ONCE, UNIT_BITS = 512, 128, 8192, 20
END = ""


def words_of(text: str) -> list[bytes]:
    """Words of a text in lower case, then the end token."""
    out = text.encode().lower().split()
    out.append(b"")
    return out


def word_class(word: str) -> int:
    """0 for the end token, else a class from 1 to CLASSES - 1 by the word's form."""
    if not word:
        return 0
    n = len(word)
    form = f"{word[-2:]}|{0 if n < 3 else 1 if n < 6 else 2 if n < 10 else 3}|{int(not word.isascii())}"
    return 1 + zlib.crc32(form.encode("utf-8", "replace")) % (CLASSES - 1)


def held_out(id_col: Column, mod: int = 7, rest: int = 2) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod == rest


@dataclass
class Hmm:
    start: np.ndarray  # (K,) at the first token of a text
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (K, CLASSES)

    @classmethod
    def initial(cls, states: int, weights: np.ndarray, seed: int = 5) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = (weights + 1.0)[None, :] * rng.uniform(0.5, 1.5, (states, len(weights)))
        move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.zeros((1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        flat = np.full(states, 1 / states)
        return cls(flat, move, emit / emit.sum(1, keepdims=True))

    def updated(self, counts: np.ndarray) -> Hmm:
        """The model of expected counts, laid out as expected_counts gives them."""
        k, c = self.emit.shape
        start, move, emit = np.split(counts[:-1], [k, k + k * k])
        norm = lambda x: x / x.sum(-1, keepdims=True)
        return Hmm(norm(start + 0.1), norm(move.reshape(k, k) + 0.1), norm(emit.reshape(k, c) + 0.01))


def _segments(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, length) of each segment of texts in a row of tokens, then (first segment, number of segments) of each text."""
    per = -(-lens // SEGMENT)
    at = np.cumsum(per) - per
    number = np.arange(per.sum()) - np.repeat(at, per)
    begin = np.repeat(np.cumsum(lens) - lens, per) + number * SEGMENT
    length = np.minimum(SEGMENT, np.repeat(lens, per) - number * SEGMENT)
    return begin, length, at, per


def _transfers(model: Hmm, classes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment and state at its first token: the distribution at the token after it, and the logarithm of the segment's probability."""
    k = len(model.start)
    order = np.argsort(-length, kind="stable")
    by_class = np.ascontiguousarray(model.emit.T)
    matrix, log = np.zeros((len(begin), k, k)), np.zeros((len(begin), k))
    for a in range(0, len(order), AT_ONCE):
        own = order[a : a + AT_ONCE]
        b, n = begin[own], length[own]
        x, logs = np.broadcast_to(np.eye(k), (len(own), k, k)).copy(), np.zeros((len(own), k))
        for t in range(int(n[0])):
            m = int(np.searchsorted(-n, -t, "left"))
            x[:m] = (x[:m] * by_class[classes[b[:m] + t]][:, None, :]) @ model.move
            if t % 8 == 7 or t + 1 == int(n[0]):
                s = x.sum(2)
                x /= s[:, :, None]
                logs += np.log(s)
        s = x.sum(2)
        matrix[own], log[own] = x / s[:, :, None], logs + np.log(s)
    return matrix, log


def _chained(model: Hmm, matrix: np.ndarray, log: np.ndarray, at: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state distribution before each segment, likelihood of what follows each segment by the next state, log-likelihood of each text)."""
    k = len(model.start)
    before, after, out = np.zeros((len(log), k)), np.ones((len(log), k)), np.zeros(len(per))
    docs = np.argsort(-per, kind="stable")
    peak = log.max(1)
    weight = np.exp(log - peak[:, None])
    v, steps = np.broadcast_to(model.start, (len(per), k)).copy(), int(per.max(initial=0))
    for j in range(steps):
        own = docs[: int(np.searchsorted(-per[docs], -j, "left"))]
        seg = at[own] + j
        before[seg] = v[own]
        w = np.einsum("dk,dkl->dl", v[own] * weight[seg], matrix[seg])
        s = w.sum(1)
        v[own] = w / s[:, None]
        out[own] += peak[seg] + np.log(s)
    for j in range(steps - 1, 0, -1):
        own = docs[: int(np.searchsorted(-per[docs], -j, "left"))]
        seg = at[own] + j
        w = weight[seg] * np.einsum("dkl,dl->dk", matrix[seg], after[seg])
        after[seg - 1] = w / w.max(1)[:, None]
    return before, after, out


def expected_counts(model: Hmm, classes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Expected starts, transitions and emissions over whole texts, then their log-likelihood."""
    k, c = model.emit.shape
    start, move, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, c)), 0.0
    begin, length, at, per = _segments(lens)
    before, after = np.broadcast_to(model.start, (len(begin), k)), np.ones((len(begin), k))
    if (per > 1).any():
        before, after, _ = _chained(model, *_transfers(model, classes, begin, length), at, per)
    first, last = np.zeros(len(begin), bool), np.zeros(len(begin), bool)
    first[at[per > 0]], last[(at + per - 1)[per > 0]] = True, True
    order = np.argsort(-length, kind="stable")
    by_class = np.ascontiguousarray(model.emit.T)
    for a in range(0, len(order), AT_ONCE):
        own = order[a : a + AT_ONCE]
        b, n = begin[own], length[own]
        steps = int(n[0])
        active = [int(np.searchsorted(-n, -t, "left")) for t in range(steps)]  # segments longer than t
        alpha, scale = np.zeros((steps, len(own), k)), np.ones((steps, len(own)))
        x = before[own]
        for t in range(steps):
            m = active[t]
            x = x[:m] * by_class[classes[b[:m] + t]]
            s = x.sum(1)
            x = x / s[:, None]
            alpha[t, :m], scale[t, :m] = x, s
            x = x @ model.move
        total += float(np.log(scale).sum())
        end, ahead = alpha[n - 1, np.arange(len(own))], after[own]
        beta = ahead @ model.move.T
        norm = (end * beta).sum(1)[:, None]  # state probabilities sum to 1
        beta = beta / norm
        inner = ~last[own]
        move += model.move * (end[inner].T @ (ahead / norm)[inner])
        for t in range(steps - 1, -1, -1):
            m = active[t]
            alpha[t, :m] *= beta[:m]  # state probabilities
            if t:
                ahead = by_class[classes[b[:m] + t]] * beta[:m] / scale[t, :m, None]
                move += model.move * (alpha[t - 1, :m].T @ ahead)
                beta[:m] = ahead @ model.move.T
        start += alpha[0][first[own]].sum(0)
        for t0 in range(0, steps, 32):
            obs = np.concatenate([classes[b[: active[t]] + t] for t in range(t0, min(steps, t0 + 32))])
            prob = np.concatenate([alpha[t, : active[t]] for t in range(t0, min(steps, t0 + 32))])
            for s in range(k):
                emit[s] += np.bincount(obs, weights=prob[:, s], minlength=c)
    return np.concatenate([start, move.ravel(), emit.ravel(), [total]])


def log_likelihoods(model: Hmm, classes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Natural logarithm of each text's exact probability under the model."""
    begin, length, at, per = _segments(lens)
    return _chained(model, *_transfers(model, classes, begin, length), at, per)[2]


# ---------------------------------------------------------------- tables


def word_counts(packs: DataFrame) -> DataFrame:
    """(chunk, slots, values) as chunks.by_word, with count * CLASSES + class for each word; the tally has tokens, then distinct words of each class."""

    def work() -> Callable[[list[bytes], np.ndarray], chunks.Values]:
        def counted(words: list[bytes], total: np.ndarray) -> chunks.Values:
            return chunks.Values(total * CLASSES + np.fromiter((word_class(w.decode()) for w in words), np.int64, len(words)))

        return counted

    def by_class(words: list[bytes], total: np.ndarray) -> np.ndarray:
        k = np.fromiter((word_class(w.decode()) for w in words), np.int64, len(words))
        return np.concatenate([np.bincount(k, weights=x, minlength=CLASSES) for x in (total, total > 0)]).astype(np.int64)

    return chunks.by_word(packs, work, by_class)


def sequences(codes: DataFrame, parts: DataFrame, tokens: np.ndarray, distinct: np.ndarray) -> DataFrame:
    """A row a chunk: class codes of its texts, and what words alone give each text (base score, words within classes, known tokens)."""
    n, v = int(tokens.sum()), int(distinct.sum())

    def finish(row: pa.Table, lens: np.ndarray, numbers: np.ndarray, value: np.ndarray) -> pa.Table:
        c, k = value // CLASSES, value % CLASSES
        base = np.log10((c + 1) / (n + 1 * (v + 1)))
        word = np.log10((c + 1) / (tokens[k] + distinct[k] + 1))
        begin = np.cumsum(lens) - lens
        sums = [np.add.reduceat(x[numbers], begin).tolist() for x in (base, word)] + [np.add.reduceat((c > 0).astype(np.int64)[numbers], begin).tolist()]
        kinds = [pa.list_(pa.float64())] * 2 + [pa.list_(pa.int64())]
        cols = {name: row.column(name) for name in ("chunk", "ids", "flags", "lens")} | {"classes": pa.array([chunks.pack(k[numbers])], pa.binary())}
        return pa.table(cols | {name: pa.array([x], t) for name, x, t in zip(("base", "word", "known"), sums, kinds)})

    ddl = "chunk long, ids array<long>, flags array<boolean>, lens array<int>, classes binary, base array<double>, word array<double>, known array<long>"
    return chunks.reassembled(codes, parts, finish, ddl)


def train(seqs: DataFrame, model: Hmm, iterations: int = 4) -> Hmm:
    """Baum-Welch over the texts whose flag is set; the counts of all partitions are added up in Spark."""
    for _ in range(iterations):

        def run(batches: Iterator[pa.RecordBatch], model: Hmm = model) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for flags, lens, classes in zip(batch.column(0), batch.column(1), batch.column(2)):
                    use, lens = np.array(flags.as_py(), bool), np.asarray(lens.values, np.int64)
                    obs = chunks.unpack(classes.as_py())[np.repeat(use, lens)]
                    if use.any():
                        got = np.rint(expected_counts(model, obs, lens[use]) * 2**UNIT_BITS).astype(np.int64)
                        total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "x"])

        rows = seqs.select("flags", "lens", "classes").mapInArrow(run, "i long, x long").groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
        if not rows:
            return model
        counts = np.zeros(len(rows))
        for r in rows:
            counts[r["i"]] = int(r["x"]) / 2**UNIT_BITS
        model = model.updated(counts)
    return model


def scores(seqs: DataFrame, model: Hmm) -> DataFrame:
    """(doc_id, training, n_tokens, n_known, base_score, score) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lens = np.array(row["lens"], np.int64)
                log = log_likelihoods(model, chunks.unpack(row["classes"]), lens) / np.log(10)
                cols = [pa.array(row["ids"], pa.int64()), pa.array(row["flags"], pa.bool_()), pa.array(lens), pa.array(row["known"], pa.int64()), pa.array(row["base"]), pa.array(log + np.array(row["word"]))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "training", "n_tokens", "n_known", "base_score", "score"])

    ddl = "doc_id long, training boolean, n_tokens long, n_known long, base_score double, score double"
    return seqs.select("ids", "flags", "lens", "known", "base", "word", "classes").mapInArrow(run, ddl)


def score_corpus(df: DataFrame, states: int = 4, iterations: int = 4, training: Column | None = None) -> DataFrame:
    """scores() of df(doc_id, text) and train_tokens, learning from the rows for which `training` holds (those not held out)."""
    training = ~held_out(F.col("doc_id")) if training is None else training
    codes, packs = chunks.chunk_table(df.select("doc_id", "text", training.alias("training")), lambda: words_of, "training", "lm_chunks")
    parts = written(word_counts(packs), "lm-parts")
    tokens, distinct = np.split(chunks.tallied(parts, 2 * CLASSES), 2)
    seqs = written(sequences(codes, parts, tokens, distinct), "lm-sequences")
    model = train(seqs, Hmm.initial(states, tokens.astype(float)), iterations)
    return scores(seqs, model).withColumn("train_tokens", F.lit(int(tokens.sum())).cast("long"))
