"""Texts as chunks of 64-bit hashes, and a shuffle of each chunk's distinct hashes.

What `chunks` does for words, for tokens that are numbers and hardly repeat: all steps are array
operations, so no hash is a Python object. `hash_table` packs runs of whole documents into chunks of
about `chunk_chars` characters. `counted` deals each chunk's distinct hashes to buckets, which are
ranges of hashes, and adds them up there; the counts go back by chunk, in the order of the hashes,
and `reassembled` brings them to the chunk's documents without moving these. There are about a
quarter as many buckets as shuffle partitions, so the packs of a chunk grow by a quarter of these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.chunks import pack, unpack
from siftwell.llm.common import shuffle_partitions, written_bucketed

#: Buckets up to which each shuffle partition has its own; beyond, four partitions share one.
FEW_BUCKETS = 64


def buckets_of(spark: SparkSession) -> int:
    parts = shuffle_partitions(spark)
    return max(min(parts, FEW_BUCKETS), -(-parts // 4))


def _bytes(hashes: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each hash."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _hashes(data: bytes, width: int) -> np.ndarray:
    raw = np.zeros((len(data) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return raw.view("<u8").ravel()


def hash_table(df: DataFrame, cutter: Callable[[], Callable[[str], tuple[np.ndarray, bytes]]], name: str, width: int = 8, texts: bool = False, chunk_chars: int = 4 << 20) -> DataFrame:
    """(chunk, ids, lens, hashes, notes, texts) of df(doc_id, text), bucketed by chunk.

    cutter makes the function from a text to its distinct hashes and a note; null texts count as
    empty. Only the low `width` bytes of hashes are kept. With texts the texts are kept too (see texts_at).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, number, chars = cutter(), TaskContext.get().partitionId() << 32, 0
        ids, own, notes, kept = [], [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                h, note = cut(text)
                ids.append(doc_id)
                own.append(h)
                notes.append(note)
                if texts:
                    kept.append(text)
                chars += len(text)
                if chars >= chunk_chars:
                    yield row(number, ids, own, notes, kept)
                    number, chars = number + 1, 0
                    ids, own, notes, kept = [], [], [], []
        if ids:
            yield row(number, ids, own, notes, kept)

    def row(number: int, ids: list, own: list[np.ndarray], notes: list[bytes], kept: list[str]) -> pa.RecordBatch:
        arrays = [
            pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(h) for h in own]], pa.list_(pa.int32())),
            pa.array([_bytes(np.concatenate(own), width)], pa.binary()), pa.array([b"".join(notes)], pa.binary()), pa.array([kept], pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["chunk", "ids", "lens", "hashes", "notes", "texts"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ddl = "chunk long, ids array<long>, lens array<int>, hashes binary, notes binary, texts array<string>"
    return written_bucketed(rows.mapInArrow(run, ddl), name, "chunk", shuffle_partitions(df.sparkSession))


def counted(table: DataFrame, width: int = 8) -> DataFrame:
    """(chunk, bucket, counts): in how many documents of all chunks each distinct hash of the chunk stands, by bucket in the hashes' order."""
    buckets, high = buckets_of(table.sparkSession), np.uint64(8 * width - 32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                own, count = np.unique(_hashes(data.as_py(), width), return_counts=True)
                bucket = (((own >> high) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = [*starts[1:].tolist(), len(own)]
                parts = [(int(bucket[a]), pack(np.diff(own[a:z], prepend=np.uint64(0)), 8), pack(count[a:z])) for a, z in zip(starts.tolist(), ends)]
                columns = [pa.array([chunk] * len(parts), pa.int64()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "bucket", "steps", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if r[1] != bucket and rows:
                    yield total(rows)
                    rows = []
                bucket = r[1]
                rows.append(r)
        if rows:
            yield total(rows)

    def total(rows: list[tuple]) -> pa.RecordBatch:
        each = [np.cumsum(unpack(r[2], 8).view(np.uint64)) for r in rows]
        flat, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
        order = np.argsort(flat)
        flat = flat[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        group = np.cumsum(new) - 1
        sums = np.bincount(group, np.concatenate([unpack(r[3]) for r in rows])[order]).astype(np.int64)
        out = np.empty(len(flat), np.int64)
        out[order] = np.minimum(sums, 2**31 - 1)[group]
        packed = [pack(x) for x in np.split(out, ends[:-1])]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array(packed, pa.binary())], ["chunk", "bucket", "counts"])

    dealt = table.select("chunk", "hashes").mapInArrow(deal, "chunk long, bucket int, steps binary, counts binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "chunk long, bucket int, counts binary")


def reassembled(table: DataFrame, parts: DataFrame, finish: Callable, ddl: str, width: int = 8) -> DataFrame:
    """finish(row of the chunk, lens, hashes, counts of these) for each chunk; parts: what `counted` gives."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for i in range(len(left)):
            row = left.slice(i, 1)
            own, place = np.unique(hashes := _hashes(row.column("hashes")[0].as_py(), width), return_inverse=True)
            packs = sorted(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist()))
            counts = np.concatenate([np.zeros(0, np.int64), *(unpack(c) for _, c in packs)])
            if len(counts) != len(own):
                raise ValueError(f"a chunk has {len(own)} hashes, {len(counts)} counts came back")
            tables.append(finish(row, np.array(row.column("lens")[0].as_py(), np.int64), hashes, counts[place]))
        return pa.concat_tables(tables)

    return table.drop("texts").groupBy("chunk").cogroup(parts.groupBy("chunk")).applyInArrow(run, ddl)


def texts_at(table: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents at places(chunk, at); only these leave the JVM and move."""
    at = places.groupBy("chunk").agg(F.collect_list("at").alias("at"))
    rows = table.select("chunk", "ids", "texts").join(at, "chunk")
    return rows.select(F.explode(F.transform("at", lambda i: F.struct(F.get("ids", i).alias("doc_id"), F.get("texts", i).alias("text")))).alias("d")).select("d.*")
