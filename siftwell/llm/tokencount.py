"""Token counts under a unigram vocabulary, by dynamic programming along a trie of pre-tokens.

The best segmentation of a word into vocabulary pieces has the largest sum of piece scores; its
forward score at a position depends on the prefix alone, so all words below a trie node share it.
Distinct pre-tokens with a common beginning meet in one bucket, in order, which is the depth-first order of their trie:
the path to the last word stays on a stack of forward scores and token counts, the next word keeps
the part of the path that both share and computes the rest once. Counts at terminal nodes are joined
back to the documents (see chunks). Scores follow from ranks: a piece of rank r has the logarithm
of a Zipf probability, -log(r + 1) - log(H) with the vocabulary's harmonic number H. Equal scores
prefer fewer tokens. Single bytes are pieces, so every word has a segmentation; one missing from the
vocabulary costs MISSING.

Cases: null and empty texts have no token; repeated rows and null ids are documents of their own;
very long words are processed whole. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftwell.llm import bpe, chunks

MISSING = -30.0


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """A log-probability for each piece by its rank."""
    base = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {p: -math.log(r + 1) - base for p, r in ranks.items()}


def beginning(word: bytes) -> bytes:
    """Words that share so much of a prefix meet in one bucket."""
    return word[:6]


class TrieCounter:
    """Counts of words that arrive in order; the path to the last word is kept."""

    def __init__(self, scores: dict[bytes, float]) -> None:
        self.scores = scores
        self.lengths = sorted({len(p) for p in scores} - {0})  # only lengths that occur are looked up
        self.word = b""
        self.best, self.tokens = [0.0], [0]
        self.steps = 0  # trie nodes computed

    def count(self, word: bytes) -> int:
        """Tokens of the best segmentation of word."""
        last, shared = self.word, 0
        for a, b in zip(last, word):
            if a != b:
                break
            shared += 1
        best, tokens, get, lengths = self.best, self.tokens, self.scores.get, self.lengths
        del best[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            top, n = best[end - 1] + MISSING, tokens[end - 1] + 1
            for length in lengths:
                if length > end:
                    break
                start = end - length
                s = get(word[start:end])
                if s is not None:
                    total = best[start] + s
                    if total > top or total == top and tokens[start] + 1 < n:
                        top, n = total, tokens[start] + 1
            best.append(top)
            tokens.append(n)
        self.steps += len(word) - shared
        self.word = word
        return tokens[len(word)]


def token_counts(df: DataFrame, ranks_path: str, pattern: str = bpe.KNOWN_PATTERN) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every whole text in df(doc_id, text), under all pieces of the vocabulary."""
    raw = df.sparkSession.sparkContext.broadcast(bpe.read_ranks(ranks_path))

    def work() -> Callable[[list[bytes], np.ndarray], chunks.Values]:
        scores = zipf_scores(bpe._ranks(raw.value))

        def counts(words: list[bytes], _: np.ndarray) -> chunks.Values:
            trie = TrieCounter(scores)
            return chunks.Values(np.fromiter(map(trie.count, words), np.int64, len(words)))

        return counts

    def finish(row: pa.Table, lens: np.ndarray, codes: np.ndarray, values: np.ndarray) -> pa.Table:
        sums, ends = np.concatenate([[0], np.cumsum(values[codes])]), np.cumsum(lens)
        return pa.table({"doc_id": row.column("ids").combine_chunks().flatten(), "n_pretokens": pa.array(lens), "n_tokens": pa.array(sums[ends] - sums[ends - lens])})

    codes, packs = chunks.chunk_table(df, bpe.splitter(pattern), name="count_chunks", key=beginning)
    return chunks.reassembled(codes, chunks.by_word(packs, work), finish, "doc_id long, n_pretokens long, n_tokens long")
