"""Texts as dictionary-coded chunks, and a shuffle of each chunk's distinct words.

`chunk_table` cuts every text into words and packs runs of whole documents into chunks of about
CHUNK_CHARS characters: each document as word numbers, and the chunk's distinct words once, dealt to
buckets by a hash and packed. Two tables result: the codes, bucketed by chunk, and the packs of
words. `by_word` brings the packs of a bucket together, where each distinct word is worked on once;
the values go back packed by chunk, and `reassembled` brings them to the chunk's codes without moving
these. A word that stands in every text travels once a chunk, so no word is hot; memory holds a
chunk, or the distinct words of a bucket, of which there are BUCKETS_EACH for each shuffle partition.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import shuffle_partitions, written, written_bucketed

CHUNK_CHARS, BUCKETS_EACH = 8 << 20, 2


def pack(numbers: np.ndarray, width: int = 4) -> bytes:
    """Numbers from 0 by byte planes of `width` bytes, compressed; planes of zeros cost nothing."""
    planes = np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes, width: int = 4) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def pack_words(words: list[bytes]) -> bytes:
    lens = pack(np.array([len(w) for w in words]))
    return struct.pack("<I", len(lens)) + lens + zstandard.ZstdCompressor(level=6).compress(b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    n = struct.unpack_from("<I", data)[0]
    ends = np.cumsum(unpack(data[4 : 4 + n]))
    body = zstandard.ZstdDecompressor().decompress(data[4 + n :])
    return [body[a:z] for a, z in zip([0, *ends.tolist()], ends.tolist())]


def whole_word(word: bytes) -> bytes:
    """What a word's bucket follows from: the word itself."""
    return word


class _Chunk:
    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.flags: list[bool | None] = []
        self.notes: list[bytes] = []
        self.texts: list[str] = []
        self.lens: list[int] = []
        self.codes: list[np.ndarray] = []
        self.chars = 0
        self.words: defaultdict[str | bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__

    def add(self, doc_id: int | None, flag: bool | None, chars: int, tokens: list[str] | list[bytes]) -> None:
        self.ids.append(doc_id)
        self.flags.append(flag)
        self.lens.append(len(tokens))
        self.codes.append(np.fromiter(map(self.words.__getitem__, tokens), np.uint32, len(tokens)))
        self.chars += chars

    def row(self, number: int, buckets: int, key: Callable[[bytes], bytes]) -> pa.RecordBatch:
        codes, n = np.concatenate(self.codes), len(self.words)
        order = np.argsort(-np.bincount(codes, minlength=n), kind="stable")  # small numbers for frequent words
        rank = np.empty(n, np.uint32)
        rank[order] = np.arange(n, dtype=np.uint32)
        flags = np.repeat(np.array([bool(f) for f in self.flags]), self.lens)
        flagged = np.bincount(codes[flags], minlength=n)[order]
        words = [w.encode() if isinstance(w, str) else w for w in self.words]
        words = [words[i] for i in order.tolist()]
        bucket = np.fromiter((zlib.crc32(key(w)) % buckets for w in words), np.int64, n)
        packs = []
        by_bucket = np.argsort(bucket, kind="stable")
        for own in np.split(by_bucket, np.flatnonzero(np.diff(bucket[by_bucket])) + 1) if n else []:
            packs.append({"bucket": int(bucket[own[0]]), "words": pack_words([words[i] for i in own.tolist()]), "slots": pack(np.diff(own, prepend=0)), "flagged": pack(flagged[own])})
        kind = pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary()), ("slots", pa.binary()), ("flagged", pa.binary())]))
        arrays = [
            pa.array([number], pa.int64()), pa.array([self.ids], pa.list_(pa.int64())), pa.array([self.flags], pa.list_(pa.bool_())), pa.array([self.lens], pa.list_(pa.int32())),
            pa.array([n], pa.int32()), pa.array([pack(rank[codes])], pa.binary()), pa.array([packs], kind), pa.array([self.notes], pa.list_(pa.binary())), pa.array([self.texts], pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["chunk", "ids", "flags", "lens", "n_words", "codes", "packs", "notes", "texts"])


def chunk_table(
    df: DataFrame, tokenizer: Callable[[], Callable[[str], list[str] | list[bytes]]], flag: str | None = None, name: str = "chunks", key: Callable[[bytes], bytes] = whole_word, noted: bool = False, texts: bool = False, chunk_chars: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(codes, packs) of df(doc_id, text, optionally a boolean column `flag`).

    codes: chunk, ids, flags, lens, n_words, codes, notes. packs: chunk, bucket, words, slots, flagged (how
    often each word stands in texts with the flag). tokenizer makes the function that cuts a text
    into words; null texts count as empty. If noted, it makes a function to (words, note), and the
    notes are kept by document in codes; with texts, codes keeps the texts too (see texts_at).
    Tokenizers whose words hardly repeat should have smaller chunks, as memory follows a chunk's distinct words.
    """
    buckets, most = BUCKETS_EACH * shuffle_partitions(df.sparkSession), chunk_chars or CHUNK_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, number, chunk = tokenizer(), TaskContext.get().partitionId() << 32, _Chunk()
        for batch in batches:
            for doc_id, text, flagged in zip(batch.column(0), batch.column(1), batch.column(2)):
                text = text.as_py() or ""
                tokens = cut(text)
                if noted:
                    tokens, note = tokens
                    chunk.notes.append(note)
                if texts:
                    chunk.texts.append(text)
                chunk.add(doc_id.as_py(), flagged.as_py(), len(text), tokens)
                if chunk.chars >= most:
                    yield chunk.row(number, buckets, key)
                    number, chunk = number + 1, _Chunk()
        if chunk.ids:
            yield chunk.row(number, buckets, key)

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col(flag) if flag else F.lit(True)).cast("boolean").alias("flag"))
    ddl = "chunk long, ids array<long>, flags array<boolean>, lens array<int>, n_words int, codes binary, packs array<struct<bucket:int,words:binary,slots:binary,flagged:binary>>, notes array<binary>, texts array<string>"
    table = written_bucketed(rows.mapInArrow(run, ddl), name, "chunk", shuffle_partitions(df.sparkSession))
    return table.drop("packs"), table.select("chunk", F.explode("packs").alias("p")).select("chunk", "p.*")


@dataclass
class Values:
    """A number for each word (counts is None), or an array of numbers each."""

    flat: np.ndarray
    counts: np.ndarray | None = None

    def packed(self, at: np.ndarray) -> bytes:
        """The values at the given words."""
        if self.counts is None:
            return pack(self.flat[at], 8)
        n, begin = self.counts[at], (np.cumsum(self.counts) - self.counts)[at]
        ends = np.cumsum(n)
        flat = self.flat[np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        counts = pack(n)
        return struct.pack("<I", len(counts)) + counts + pack(flat)


def by_word(packs: DataFrame, work: Callable[[], Callable[[list[bytes], np.ndarray], Values]], tally: Callable[[list[bytes], np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(chunk, slots, values): work() on each distinct word once, in order within its bucket.

    work makes a function of distinct words and how often each stands in flagged texts of all chunks.
    With tally, each task adds up tally(words, totals) over its buckets and gives it in a row of
    chunk -1 (see tallied).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do, bucket, rows, sums = work(), None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket and rows:
                    yield from finish(do, rows, sums)
                    rows = []
                bucket = row["bucket"]
                rows.append(row)
        if rows:
            yield from finish(do, rows, sums)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([b""], pa.binary()), pa.array([pack(sums[0], 8)], pa.binary())], ["chunk", "slots", "values"])

    def finish(do: Callable, rows: list[dict], sums: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        each = [np.fromiter(map(number.__getitem__, unpack_words(r["words"])), np.int64) for r in rows]
        total = np.zeros(len(number), np.int64)
        for own, r in zip(each, rows):
            total[own] += unpack(r["flagged"])
        words = list(number)
        order = sorted(range(len(words)), key=words.__getitem__)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        words = [words[i] for i in order]
        values = do(words, total[order])
        if tally:
            sums[:] = [tally(words, total[order]) + (sums[0] if sums else 0)]
        for a in range(0, len(rows), 64):
            part = rows[a : a + 64]
            packed = [values.packed(place[own]) for own in each[a : a + 64]]
            yield pa.RecordBatch.from_arrays([pa.array([r["chunk"] for r in part], pa.int64()), pa.array([r["slots"] for r in part], pa.binary()), pa.array(packed, pa.binary())], ["chunk", "slots", "values"])

    dealt = packs.select("chunk", "bucket", "words", "slots", "flagged").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "chunk long, slots binary, values binary")


def tallied(parts: DataFrame, n: int) -> np.ndarray:
    """The sums of by_word's tally over all tasks, n numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v in batch.column(0):
                numbers = unpack(v.as_py(), 8)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(numbers))), pa.array(numbers)], ["i", "x"])

    rows = parts.where("chunk = -1").select("values").mapInArrow(run, "i long, x long").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(n, np.int64)
    for r in rows:
        out[r["i"]] = r["x"]
    return out


def _in_slots(parts: pa.Table, n: int, arrays: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """(values by slot, None, None), or (all numbers, begin and count by slot)."""
    slots, flats, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, v in zip(parts.column("slots").to_pylist(), parts.column("values").to_pylist()):
        slots.append(np.cumsum(unpack(s)))
        if arrays:
            size = struct.unpack_from("<I", v)[0]
            counts.append(unpack(v[4 : 4 + size]))
            flats.append(unpack(v[4 + size :]))
        else:
            flats.append(unpack(v, 8))
    at, flat, out = np.concatenate(slots), np.concatenate(flats), np.zeros(n, np.int64)
    if len(at) != n:
        raise ValueError(f"a chunk has {n} words, {len(at)} came back")
    if not arrays:
        out[at] = flat
        return out, None, None
    count, begin = np.concatenate(counts), np.zeros(n, np.int64)
    begin[at] = np.cumsum(count) - count
    out[at] = count
    return flat, begin, out


def reassembled(codes: DataFrame, parts: DataFrame, finish: Callable, ddl: str, arrays: bool = False) -> DataFrame:
    """finish(row of the chunk, lens, word numbers, values by slot) for each chunk; with arrays the values are (numbers, begin, count)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for i in range(len(left)):
            row = left.slice(i, 1)
            lens = np.array(row.column("lens")[0].as_py(), np.int64)
            got = _in_slots(right, row.column("n_words")[0].as_py(), arrays)
            tables.append(finish(row, lens, unpack(row.column("codes")[0].as_py()), got if arrays else got[0]))
        return pa.concat_tables(tables)

    return codes.drop("texts").groupBy("chunk").cogroup(parts.where("chunk >= 0").groupBy("chunk")).applyInArrow(run, ddl)


def texts_at(codes: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents at places(chunk, at); only these move."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("at").combine_chunks() if len(left) else pa.array([], pa.int32())
        if not len(at):
            return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
        return pa.table({c: left.column(n).combine_chunks().flatten().take(at) for c, n in (("doc_id", "ids"), ("text", "texts"))})

    return codes.select("chunk", "ids", "texts").groupBy("chunk").cogroup(places.groupBy("chunk")).applyInArrow(run, "doc_id long, text string")
