"""Byte-level BPE over a corpus: each distinct word is encoded once, whatever the number of its uses.

`encode` cuts texts into words by the tokenizer's pattern, sends the distinct words of each chunk of
documents to the word's partition, merges each word once by the ranks, joins the ids back to the
chunk and reassembles every document by position. `decode` explodes the distinct ids of each document and
joins them with the token-byte table, which is broadcast (its size is the vocabulary's): rows of documents
stay where they are, and as a broadcast join streams the other side, a document's rows stay together. The
first of them carries its ids and its further columns; the joined pieces are then taken in the order of
the ids. The positions of rows are checked, so a plan that broke their order would be an error.
The rank file is read by the driver from a path that is a parameter; its size is the vocabulary's.

Cases: null and empty texts have no ids; special tokens in a text are ordinary text; repeated rows
and null ids are documents of their own; an id outside the vocabulary decodes to nothing and is
counted in n_unknown; null id arrays decode to null. Empty tables give empty results. Further columns
are ignored by encode and kept by decode.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from siftwell.llm import chunks

#: Ids whose pieces are put together at once, besides the rest of a document.
IDS_AT_ONCE = 1 << 20
#: Letters of the Latin blocks, a range in which the built-in `re` and \p{L} agree.
_LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
_BEYOND = re.compile(rf"[^\t-\r -~{_LATIN}]")
#: The pattern that _PLAIN is short for. A fixed value of the format.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def beyond_latin(text: str) -> bool:
    """Whether a text has characters in which libraries' tables of letters may differ."""
    return _BEYOND.search(text) is not None


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: the pair of neighbours with the lowest rank is joined, the left one of equals, until none has a rank.

    Pairs wait in a heap and parts are linked by their starts, so a word of n bytes takes n log n steps.
    """
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(pairs)
    while pairs:
        _, i, end = heapq.heappop(pairs)
        j = after[i]
        if j < 0 or j >= n or after[j] != end:  # one of the two was joined meanwhile
            continue
        after[i], after[j] = end, -1
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : after[end]])) is not None:
                heapq.heappush(pairs, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:end])) is not None:
            heapq.heappush(pairs, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def splitter(pattern: str) -> Callable[[], Callable[[str], list[str]]]:
    """A maker of the function that cuts a text by the pattern."""

    def make() -> Callable[[str], list[str]]:
        full = regex.compile(pattern).findall
        if pattern != KNOWN_PATTERN:
            return full
        plain, beyond = _PLAIN.findall, _BEYOND.search
        return lambda text: full(text) if beyond(text) else plain(text)

    return make


def encode(df: DataFrame, ranks_path: str, pattern: str = KNOWN_PATTERN) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text in df(doc_id, text)."""
    spark = df.sparkSession
    raw = spark.sparkContext.broadcast(read_ranks(ranks_path))  # as large as the vocabulary

    def work() -> Callable[[list[bytes], np.ndarray], chunks.Values]:
        ranks = _ranks(raw.value)

        def ids_of(words: list[bytes], _: np.ndarray) -> chunks.Values:
            out = [[whole] if (whole := ranks.get(w)) is not None else merged(w, ranks) for w in words]
            count = np.fromiter(map(len, out), np.int64, len(out))
            return chunks.Values(np.fromiter((i for x in out for i in x), np.int64, int(count.sum())), count)

        return ids_of

    def finish(row: pa.Table, lens: np.ndarray, codes: np.ndarray, values: tuple) -> pa.Table:
        pool, begin, count = values
        each = count[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        flat = pool.astype(np.int32)[np.repeat(begin[codes] - ends[:-1], each) + np.arange(int(ends[-1]))]
        offsets = ends[np.concatenate([[0], np.cumsum(lens)])].astype(np.int32)
        ids = row.column("ids").combine_chunks().flatten()
        return pa.table({"doc_id": ids, "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))})

    codes, packs = chunks.chunk_table(df, splitter(pattern), name="bpe_chunks")
    return chunks.reassembled(codes, chunks.by_word(packs, work), finish, "doc_id long, ids array<int>", arrays=True)


def token_bytes(spark: SparkSession, ranks_path: str) -> DataFrame:
    """(_token, _piece): the token-byte table, a row for each entry of the vocabulary."""
    ranks = _ranks(read_ranks(ranks_path))
    return spark.createDataFrame(pa.table({"_token": pa.array(ranks.values(), pa.int64()), "_piece": pa.array(ranks.keys(), pa.binary())}))


def decode(df: DataFrame, ranks_path: str) -> DataFrame:
    """df with the columns decoded (bytes) and n_unknown, from its column ids."""
    fields = [f for f in df.schema.fields if f.name not in ("decoded", "n_unknown")]
    names, schema = [f.name for f in fields], StructType([*[StructField(f.name, f.dataType, True) for f in fields], StructField("decoded", BinaryType()), StructField("n_unknown", LongType())])

    def spelled(docs: pa.RecordBatch, token: pa.Array, piece: pa.Array) -> pa.RecordBatch:
        """docs with the bytes of their ids, of which those in token have the piece of the same place."""
        lists = docs.column(names.index("ids"))
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
        at = pc.index_in(lists.flatten(), value_set=token, skip_nulls=True)
        found, lost = piece.take(at), np.concatenate([[0], np.cumsum(at.is_null().to_numpy(zero_copy_only=False))])[ends]
        to = np.frombuffer(found.buffers()[1], np.int32)[ends] if len(found) else np.zeros(len(ends), np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(to), found.buffers()[2] or pa.py_buffer(b"")])
        known = lists.is_valid()
        made = [pc.if_else(known, x, pa.scalar(None, x.type)) for x in (data, pa.array(np.diff(lost), pa.int64()))]
        return pa.RecordBatch.from_arrays([*docs.columns, *made], schema.names)

    def whole(rows: pa.RecordBatch, starts: list[int], sizes: list[int]) -> Iterator[pa.RecordBatch]:
        """The documents whose rows begin at the starts."""
        place = np.arange(len(rows)) - np.repeat(starts, sizes)
        at, token, piece = (rows.column(i) for i in range(len(names) + 1, len(names) + 4))
        if (at.fill_null(0).to_numpy() != place).any():
            raise RuntimeError("the join has not kept the pieces of documents in their order")
        known = piece.is_valid()
        token, piece = token.filter(known), piece.filter(known).cast(pa.binary())
        docs = pa.RecordBatch.from_arrays([c.take(pa.array(starts)) for c in rows.columns[: len(names)]], names)
        n = docs.column(names.index("ids")).value_lengths().fill_null(0).to_numpy().astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(n) - n) // IDS_AT_ONCE)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(docs)]):
            yield spelled(docs.slice(a, b - a), token, piece)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, have, need = [], 0, 1
        for batch in batches:
            waiting.append(batch)
            have += len(batch)
            if have < need:
                continue
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            size, starts, end = rows.column(len(names)).fill_null(0).to_numpy(), [], 0
            while end < len(rows) and end + size[end] <= len(rows):
                if size[end] < 1:
                    raise RuntimeError("the join has not kept the pieces of documents in their order")
                starts.append(end)
                end += int(size[end])
            if starts:
                yield from whole(rows.slice(0, end), starts, size[starts].tolist())
            left = rows.slice(end)
            waiting, have, need = ([left], len(left), int(size[end])) if len(left) else ([], 0, 1)
        if have:
            raise RuntimeError("the join has not kept the pieces of documents in one place")

    columns = [f"`{f}`" for f in names]
    each = df.select(*columns, F.array_distinct("ids").alias("_own")).select(*columns, "_own", F.posexplode_outer("_own").alias("_at", "_id"))
    first = lambda c, name: F.when(F.coalesce("_at", F.lit(0)) == 0, c).alias(name)
    size = F.greatest(F.coalesce(F.size("_own"), F.lit(1)), F.lit(1))
    each = each.select(*[first(F.col(c), n) for c, n in zip(columns, names)], first(size, "_size"), "_at", "_id")
    pieces = each.join(F.broadcast(token_bytes(df.sparkSession, ranks_path)), F.col("_id").cast("long") == F.col("_token"), "left")
    return pieces.select(*columns, "_size", "_at", "_id", "_piece").mapInArrow(assemble, schema)
