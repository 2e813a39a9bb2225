"""Two tokenizers' cuts of the same texts, aligned by byte offsets, and counts of the token pairs that end together.

Side A is a byte-level BPE (a `tokenizers` file), side B a piece model with byte fallback
(`sentencepiece`). A encodes a space and the text, B the text, to which it adds that space; both must
give back these bytes. Offsets where a token of either side ends cut the tokens into groups, and the last
tokens of each group, one of either side, are a link.

`score` counts links over the corpus without ever holding a pair table in one place. Each task packs
documents into chunks and each chunk's distinct pairs, with how often they occur, by stripe: B ids
are dealt to stripes so that a stripe's dense matrix (its B ids by all A ids) has at most STRIPE_BYTES. The
packs of a stripe are added into its matrix (np.add.at), whose row maxima tell each B id's best
partners. The matrices then lead the same stripes' packs, co-partitioned with them: each chunk's
pairs are read off the matrix and go back to the chunk, where documents sum them. A pair that stands in
every text travels once a chunk; memory holds a chunk, or one matrix.

Cases: null and empty texts, and texts that a side doesn't give back to the byte, have no tokens and
get zeros and an empty digest; repeated rows and null ids are documents of their own; strings of special
tokens in a text are ordinary text; further columns are ignored. Empty tables give empty results.
A vocabulary with a token of no bytes is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import bpe
from siftwell.llm.chunks import pack, unpack
from siftwell.llm.common import written

CHUNK_CHARS, STRIPE_BYTES = 4 << 20, 32 << 20
#: Texts beyond so many characters are encoded in parts, cut where both sides always cut.
PART_CHARS = 1 << 20
_CUT = re.compile(r"(?<=[a-z]) (?=[a-z])")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _parts(text: str) -> list[str]:
    """The text in parts of about PART_CHARS; all but the first have lost the space they begin with."""
    out, at = [], 0
    while len(text) - at > PART_CHARS and (m := _CUT.search(text, at + PART_CHARS)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


class Sides:
    """Both tokenizers with the bytes of their tokens. Texts in characters beyond the Latin ones go to the library of A's own file."""

    def __init__(self, a_json: bytes, b_model: bytes) -> None:
        self.a = tokenizers.Tokenizer.from_buffer(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        vocab, of_char = json.loads(a_json)["model"]["vocab"], byte_of_char()
        self.a_bytes = [b"?"] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {self.a_bytes[i]: i for token, i in vocab.items() if token not in special}
        self.fast = tiktoken.Encoding("a", pat_str=bpe.KNOWN_PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if not all(self.a_bytes) or not all(self.b_bytes):
            raise ValueError("a token without bytes")
        #: Whether no piece of B goes on after a word's end, so that texts may be cut there.
        self.b_cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.names = [f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for end in ends for i in range(n)]

    def a_ids(self, text: str) -> list[int]:
        out: list[int] = []
        for part in _parts(text):
            part = " " + part
            out += self.a.encode_batch_fast([part], add_special_tokens=False)[0].ids if bpe.beyond_latin(part) else self.fast.encode_ordinary(part)
        return out

    def b_ids(self, text: str) -> list[int]:
        parts = _parts(text) if self.b_cuts else [text]
        return [i for ids in self.b.encode(parts, num_threads=1) for i in ids]

    def cut(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides, or none where a side doesn't give the text back."""
        if not text:
            return [], []
        whole, a, b = (" " + text).encode(), self.a_ids(text), self.b_ids(text)
        same = b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
        return (a, b) if same else ([], [])


@lru_cache(maxsize=1)
def _sides(a_json: bytes, b_model: bytes) -> Sides:
    return Sides(a_json, b_model)


class Aligned:
    """The groups and links of a row of texts, by arrays over all their tokens."""

    def __init__(self, sides: Sides, cuts: list[tuple[list[int], list[int]]]) -> None:
        self.n_a, self.n_b = (np.array([len(c[k]) for c in cuts], np.int64) for k in (0, 1))
        self.a, self.b = (np.fromiter((i for c in cuts for i in c[k]), np.int64, int(n.sum())) for k, n in ((0, self.n_a), (1, self.n_b)))
        ends_a, ends_b = np.cumsum(sides.a_len[self.a]), np.cumsum(sides.b_len[self.b])
        at = np.searchsorted(ends_b, ends_a)  # the last token of A ends with the last of B
        together = ends_b[at] == ends_a if len(at) else np.zeros(0, bool)
        self.last_a, self.last_b = np.flatnonzero(together), at[together]
        self.link_a, self.link_b = self.a[self.last_a], self.b[self.last_b]
        before = np.concatenate([[0], np.cumsum(together)])
        self.n_links = np.diff(before[np.concatenate([[0], np.cumsum(self.n_a)])])

    def texts(self, sides: Sides) -> Iterator[str]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
        n, m = len(sides.a_bytes), len(sides.b_bytes)
        end_a, end_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        end_a[self.last_a], end_b[self.last_b] = 1, 1
        group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        names = np.concatenate([self.a + n * end_a, 2 * n + self.b + m * end_b])[order]
        at = 0
        for k in (self.n_a + self.n_b).tolist():
            yield "".join(map(sides.names.__getitem__, names[at : at + k].tolist()))[:-1]
            at += k


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _chunked(batches: Iterator[pa.RecordBatch], sides: Sides, chars: int) -> Iterator[tuple[list[int | None], Aligned]]:
    ids, cuts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py() or ""
            ids.append(doc_id.as_py())
            cuts.append(sides.cut(text))
            size += len(text)
            if size >= chars:
                yield ids, Aligned(sides, cuts)
                ids, cuts, size = [], [], 0
    if ids:
        yield ids, Aligned(sides, cuts)


def groups(df: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, groups): the alignment of each text as `a1,a2|b1;a3|b2,b3`, ids of A and of B."""
    a_json, b_model = (df.sparkSession.sparkContext.broadcast(_read(p)) for p in (a_path, b_path))  # as large as the vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(a_json.value, b_model.value)
        for ids, own in _chunked(batches, sides, CHUNK_CHARS // 8):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own.texts(sides), pa.string())], ["doc_id", "groups"])

    return _texts(df).mapInArrow(run, "doc_id long, groups string")


def stripe_count(n_a: int, n_b: int, stripe_bytes: int = STRIPE_BYTES) -> int:
    """Stripes that the ids of B are dealt to, so that a stripe's matrix of counts has at most stripe_bytes (or one row)."""
    return -(-n_b // max(1, stripe_bytes // (8 * n_a)))


_CHUNKS = "chunk long, ids array<long>, n_a array<long>, n_b array<long>, n_links array<long>, digests array<string>, n_pairs int, codes binary, packs array<struct<stripe:int,slots:binary,a:binary,b:binary,n:binary>>"


def link_chunks(df: DataFrame, a_path: str, b_path: str, stripes: int, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """A row a chunk of documents: what each document has, its links as numbers of the chunk's distinct pairs, and these pairs by stripe."""
    a_json, b_model = (df.sparkSession.sparkContext.broadcast(_read(p)) for p in (a_path, b_path))  # as large as the vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, number = _sides(a_json.value, b_model.value), TaskContext.get().partitionId() << 32
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), pa.int32(), pa.binary(), pa.list_(pa.struct([("stripe", pa.int32()), *[(c, pa.binary()) for c in ("slots", "a", "b", "n")]]))]
        for ids, own in _chunked(batches, sides, chunk_chars):
            pairs, codes, counts = np.unique(own.link_b * len(sides.a_bytes) + own.link_a, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")  # small numbers for frequent pairs
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            b, a = np.divmod(pairs[order], len(sides.a_bytes))
            by_stripe, packs = np.argsort(b % stripes, kind="stable"), []
            for slots in np.split(by_stripe, np.flatnonzero(np.diff(b[by_stripe] % stripes)) + 1) if len(b) else []:
                packs.append({"stripe": int(b[slots[0]] % stripes), "slots": pack(np.diff(slots, prepend=0)), "a": pack(a[slots]), "b": pack(b[slots] // stripes), "n": pack(counts[order][slots])})
            digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in own.texts(sides)]
            values = [number, ids, own.n_a.tolist(), own.n_b.tolist(), own.n_links.tolist(), digests, len(b), pack(rank[codes]), packs]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [c.split()[0] for c in _CHUNKS.split(", ")])
            number += 1

    return _texts(df).mapInArrow(run, _CHUNKS)


def _matrices(packs: DataFrame, n_a: int, rows: int) -> DataFrame:
    """(stripe, cells, counts): the counts of each stripe's pairs, added up in its dense matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, stripe = np.zeros((rows, n_a), np.int64), None

        def full() -> pa.RecordBatch:
            cells = np.flatnonzero(matrix)
            out = pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([pack(np.diff(cells, prepend=0))], pa.binary()), pa.array([pack(matrix.ravel()[cells], 8)], pa.binary())], ["stripe", "cells", "counts"])
            matrix[:] = 0
            return out

        for batch in batches:
            for own, a, b, n in zip(*(batch.column(c).to_pylist() for c in ("stripe", "a", "b", "n"))):
                if stripe not in (None, own):
                    yield full()
                stripe = own
                np.add.at(matrix, (unpack(b), unpack(a)), unpack(n))
        if stripe is not None:
            yield full()

    return packs.select("stripe", "a", "b", "n").repartition("stripe").sortWithinPartitions("stripe").mapInArrow(run, "stripe int, cells binary, counts binary")


def _looked_up(packs: DataFrame, matrices: DataFrame, n_a: int, rows: int) -> DataFrame:
    """(chunk, slots, values): for each pair of a chunk twice its count, and one more where no count of its B id is higher."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, best = np.zeros((rows, n_a), np.int64), np.zeros(rows, np.int64)
        for batch in batches:
            chunks, slots, values = [], [], []
            for row in batch.to_pylist():
                if row["chunk"] is None:  # the stripe's matrix, ahead of its packs
                    matrix[:] = 0
                    matrix.ravel()[np.cumsum(unpack(row["a"]))] = unpack(row["b"], 8)
                    best = matrix.max(1)
                    continue
                b = unpack(row["b"])
                count = matrix[b, unpack(row["a"])]
                chunks.append(row["chunk"])
                slots.append(row["slots"])
                values.append(pack(2 * count + (count == best[b]), 8))
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(slots, pa.binary()), pa.array(values, pa.binary())], ["chunk", "slots", "values"])

    first = matrices.select("stripe", F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("slots"), F.col("cells").alias("a"), F.col("counts").alias("b"))
    rows_in = first.unionByName(packs.select("stripe", "chunk", "slots", "a", "b"))
    return rows_in.repartition("stripe").sortWithinPartitions("stripe", F.col("chunk").asc_nulls_first()).mapInArrow(run, "chunk long, slots binary, values binary")


def _sizes(a_path: str, b_path: str) -> tuple[int, int]:
    return max(json.loads(_read(a_path))["model"]["vocab"].values()) + 1, sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def _packs(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk", F.explode("packs").alias("p")).select("chunk", "p.*")


def pair_counts(df: DataFrame, a_path: str, b_path: str, stripe_bytes: int = STRIPE_BYTES) -> DataFrame:
    """(a, b, count, best): how many links of the corpus hold each pair of ids, and whether it is its B id's most frequent."""
    n_a, n_b = _sizes(a_path, b_path)
    stripes = stripe_count(n_a, n_b, stripe_bytes)
    rows = -(-n_b // stripes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, cells, counts in zip(*(batch.column(c).to_pylist() for c in ("stripe", "cells", "counts"))):
                (b, a), n, best = np.divmod(np.cumsum(unpack(cells)), n_a), unpack(counts, 8), np.zeros(rows, np.int64)
                np.maximum.at(best, b, n)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b * stripes + stripe), pa.array(n), pa.array(n == best[b])], ["a", "b", "count", "best"])

    return _matrices(_packs(link_chunks(df, a_path, b_path, stripes)), n_a, rows).mapInArrow(run, "a long, b long, count long, best boolean")


def score(df: DataFrame, a_path: str, b_path: str, stripe_bytes: int = STRIPE_BYTES, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of df(doc_id, text).

    n_best: links whose pair is its B id's most frequent in the corpus, ties included; count_sum: the
    corpus counts of all links; groups_sha256: of what groups() gives, or empty without tokens.
    """
    n_a, n_b = _sizes(a_path, b_path)
    stripes = stripe_count(n_a, n_b, stripe_bytes)
    rows = -(-n_b // stripes)
    chunks = written(link_chunks(df, a_path, b_path, stripes, chunk_chars), "align-chunks")
    values = _looked_up(_packs(chunks), _matrices(_packs(chunks), n_a, rows), n_a, rows)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            at = [np.cumsum(unpack(s)) for s in right.column("slots").to_pylist()]
            got = np.full(row["n_pairs"], -1, np.int64)
            got[np.concatenate([np.zeros(0, np.int64), *at])] = np.concatenate([np.zeros(0, np.int64), *(unpack(v, 8) for v in right.column("values").to_pylist())])
            if (got < 0).any():
                raise ValueError("pairs of a chunk didn't come back")
            of_link = got[unpack(row["codes"])]
            begin = np.concatenate([[0], np.cumsum(row["n_links"])]).astype(np.int64)
            best, total = (np.diff(np.concatenate([[0], np.cumsum(x)])[begin]) for x in (of_link & 1, of_link >> 1))
            links = pa.array(row["n_links"], pa.int64())
            out.append(pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_a": pa.array(row["n_a"], pa.int64()), "n_b": pa.array(row["n_b"], pa.int64()), "n_groups": links, "n_links": links, "n_best": pa.array(best), "count_sum": pa.array(total), "groups_sha256": pa.array(row["digests"], pa.string())}))
        return pa.concat_tables(out)

    ddl = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return chunks.drop("packs").groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(run, ddl)
