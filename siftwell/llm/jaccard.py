"""N-gram Jaccard join: which documents share so much of their word shingles, in exact components.

A document's set holds its distinct shingles of `words` words (its whole word sequence where it is
shorter), as 64-bit hashes; sets are equal if 128 bits of a hash of theirs are. Two sets link when 100 |A n B| >= percent |A u B|. The steps:

1. Every document is hashed; equal sets become one. Of each set the first shingles in hash order are
   counted over the corpus. Two linked sets have at least l common shingles among the first
   |A| - ceil(t |A|) + l of either, so a set with fewer shared ones than any partner could ask for
   has no link (EXTRA sets l). That drops nearly all sets and no link.
2. The remaining sets are hashed whole and their shingles counted, which gives the global order: rare
   shingles first, ties by hash. Shingles of one set alone need no place in it but count for lengths.
   A set that shares less than t of itself is dropped.
3. Linked sets share a shingle among the first |A| - ceil(t |A|) + 1, their heads. Sets that heads connect
   live in one home; this is where they are stored, not what is compared.
4. The sets of a home are dealt by length (a band spans the lengths that one set can link with) and in
   each band to blocks of at most about BLOCK sets or BLOCK_TOKENS shingles. A block is stored in a trie (`Trie`) along
   the global order. A set walks the trie with its partial overlap, shared by all sets below a node; a
   subtree is passed over when even its remaining length can't reach the overlap needed, or when all its
   sets are linked to the walker already. Sets walk in groups, so each node is visited once a group. Then the blocks'
   classes meet by representatives, and last every set that is not of its home's largest class visits the blocks
   that hold another class and where lengths and shared shingles leave room for a link; in homes of more than
   FEW_BLOCKS blocks only those that hold one of its heads too, if finding these takes at most twice as many rows as
   visits to all would be.

Only links between sets are kept, as forests, and never collected. Copies are not expanded to pairs.

Cases: null and empty texts, and those of white space, have an empty set, are linked with nothing and
are their own component; a component's id is its smallest doc_id; null ids count only where a
component has no other, and its id is null then; repeated rows are copies. Empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import hashes
from siftwell.llm.common import shuffle_partitions, written, written_bucketed

#: Share of a set by which the first filter's prefixes are longer, in hundredths.
EXTRA = 5
#: Sets, and shingles of sets, that one task joins.
BLOCK, BLOCK_TOKENS = 512, 250_000
#: Bytes that mark which shingles the sets hold that walk a trie at once.
MARKS = 16 << 20
#: Blocks of a home that a set visits without asking for common heads.
FEW_BLOCKS = 64
#: Characters of a chunk in the first step, whose chunks keep the texts, and in the second.
CHUNKS = (4 << 20, 8 << 20)
_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P[3]
    h = (h ^ (h >> np.uint64(29))) * _P[0]
    return h ^ (h >> np.uint64(32))


def hasher(words: int) -> Callable[[str | None], np.ndarray]:
    """A function from a text to its distinct shingle hashes, in order."""
    # words are hashed well already, so a sum of odd multiples, one for each place, is mixed once
    times = _mixed(np.arange(1, words + 1, dtype=np.uint64) * _P[2]) | np.uint64(1)

    def shingles(text: str | None) -> np.ndarray:
        w = (text or "").encode().lower().split()
        n = len(w)
        if not n:
            return np.zeros(0, np.uint64)
        a = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, n)
        m = min(n, words)
        h = np.full(n - m + 1, m, np.uint64) * _P[1]  # a short sequence differs from a shingle by its length
        for i in range(m):
            h += a[i : n - m + 1 + i] * times[i]
        h = np.sort(_mixed(h))
        return h[np.concatenate([[True], h[1:] != h[:-1]])]

    return shingles


def least_overlap(n: int, percent: int) -> int:
    """Of a set of n, what a linked set shares at least."""
    return -(-percent * n // 100)


def set_id(h: np.ndarray) -> tuple[int, int]:
    """Two numbers of 64 bits that tell sets apart."""
    x = xxhash.xxh3_128_intdigest(h.tobytes())
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


# ---------------------------------------------------------------- trie


class Trie:
    """Sets of ordered tokens along a path-compressed trie, with classes of linked sets."""

    def __init__(self, tokens: list[np.ndarray], sizes: list[int], percent: int, stored: list[int]) -> None:
        """tokens: shared shingles of each set as ranks in the global order; sizes: of the whole sets; stored: the sets that the trie holds."""
        held = np.zeros(1 + max((int(t.max()) for t in tokens if len(t)), default=0), bool)
        for i in stored:
            held[tokens[i]] = True
        rank = np.cumsum(held) - 1  # shingles of walkers alone meet nothing here
        self.tokens, self.sizes, self.percent = [rank[t[held[t]]] for t in tokens], np.asarray(sizes, np.int64), percent
        self.label = np.arange(len(tokens))
        self.tested = 0
        self.order = np.array(sorted(stored, key=lambda i: self.tokens[i].tolist()), np.int64)
        self.span = max(1, int(held.sum()))
        self.root = self._node()

    def _node(self) -> tuple:
        """Nodes as (segment, children, begin and end of its sets in order, how many of these end here, least size, largest size, longest rest)."""
        sizes, lens = self.sizes[self.order], np.array([len(self.tokens[i]) for i in self.order], np.int64)
        root: list = []
        work = [(0, len(self.order), 0, root)]
        while work:
            lo, hi, at, into = work.pop()
            first, last = self.tokens[self.order[lo]], self.tokens[self.order[hi - 1]]
            m = min(len(first), len(last))
            differ = np.flatnonzero(first[at:m] != last[at:m])
            end = at + (int(differ[0]) if len(differ) else m - at)
            here = lo  # sets that end here come first
            while here < hi and lens[here] == end:
                here += 1
            children: list = []
            into.append((first[at:end], children, lo, hi, here - lo, int(sizes[lo:hi].min()), int(sizes[lo:hi].max()), int(lens[lo:hi].max()) - end))
            own = here
            for i in range(here + 1, hi + 1):
                if i == hi or self.tokens[self.order[i]][end] != self.tokens[self.order[own]][end]:
                    if own < hi:
                        work.append((own, i, end, children))
                    own = i
        return root[0]

    def union(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)

    def needed(self, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
        """Overlap that links sets of a and b."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def link(self, walkers: list[int]) -> None:
        """Unites each walker with every class that holds a set linked with it; as many walk at once as MARKS allows."""
        at_once = max(1, MARKS // self.span)
        for i in range(0, len(walkers), at_once):
            self._walk(np.array(walkers[i : i + at_once], np.int64))

    def _walk(self, walkers: np.ndarray) -> None:
        own = [self.tokens[i] for i in walkers]
        lens = np.array([len(t) for t in own], np.int64)
        flat, who = np.concatenate(own), np.repeat(np.arange(len(own)), lens)
        mark = np.zeros((self.span, len(own)), np.uint8)
        mark[flat, who] = 1
        keys, ends = who * self.span + flat, np.cumsum(lens)  # in order, since each set is
        size = self.sizes[walkers]
        least, most = least_overlap(size, self.percent), size * 100 // self.percent
        # the walkers that reach a node, what they share with the path to it, and how much of them is left
        work = [(self.root, np.arange(len(own)), np.zeros(len(own), np.int64), lens)]
        while work:
            (segment, children, lo, hi, here, small, large, longest), on, have, rest = work.pop()
            below = self.label[self.order[lo:hi]]
            asked = self.needed(size[on], np.maximum(small, least[on]))
            keep = (large >= least[on]) & (small <= most[on]) & (have + np.minimum(rest, len(segment) + longest) >= asked)
            if (below == below[0]).all():  # one class holds all sets below
                keep &= self.label[walkers[on]] != below[0]
            if not keep.all():
                on, have, rest, asked = on[keep], have[keep], rest[keep], asked[keep]
            if not len(on):
                continue
            if len(segment):
                rows = mark[segment] if 4 * len(on) >= mark.shape[1] else mark[segment[:, None], on]
                shared = rows.sum(0, dtype=np.int64)
                have = have + (shared[on] if rows.shape[1] == mark.shape[1] else shared)
            for i in self.order[lo : lo + here].tolist():
                new = np.flatnonzero(self.label[walkers[on]] != self.label[i])
                self.tested += len(new)
                for x in new[have[new] >= self.needed(size[on[new]], self.sizes[i])].tolist():
                    self.union(i, int(walkers[on[x]]))
            if children:
                if len(segment):
                    rest = ends[on] - np.searchsorted(keys, on * self.span + int(segment[-1]), "right")
                keep = have + np.minimum(rest, longest) >= asked
                on, have, rest = on[keep], have[keep], rest[keep]
                work.extend((c, on, have, rest) for c in children if len(on))


def linked_classes(tokens: list[np.ndarray], sizes: list[int], percent: int, classes: list | None = None, walkers: list[int] | None = None, stored: list[int] | None = None) -> list[int]:
    """For each set the number of a set of its class, by links among the sets and those known by `classes`.

    tokens: shingles of each set in a common order. walkers: only these are compared, with all or with the stored ones.
    """
    every = list(range(len(tokens)))
    stored = every if stored is None else stored
    if not stored:
        return every
    trie = Trie(tokens, sizes, percent, stored)
    first: dict = {}
    for i, c in enumerate(classes or []):
        if c is not None:
            trie.union(first.setdefault(c, i), i)
    trie.link(every if walkers is None else walkers)
    return trie.label.tolist()


# ---------------------------------------------------------------- components


def _forest(edges: DataFrame) -> DataFrame:
    """Edges(u, v) with the same components, at most one for each node of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(i: int) -> int:
            while parent.setdefault(i, i) != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(u), find(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 4_000_000:
                yield out(parent, find)
                parent.clear()
        if parent:
            yield out(parent, find)

    def out(parent: dict[int, int], find: Callable[[int], int]) -> pa.RecordBatch:
        pairs = [(i, r) for i in list(parent) if (r := find(i)) != i]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of its component, for every node of edges(u, v).

    Large-star and small-star rounds until nothing changes; hubs are split by skew joins, since each
    round only takes minima and joins them back.
    """
    e = written(_forest(edges).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


# ---------------------------------------------------------------- tables


def _hashed(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Step 1: (doc_id, n, sid, sid2, shared, chunk, at) for each document, shared: of its first shingles those in other documents too; and the chunks, with texts."""

    def cutter() -> Callable:
        shingles = hasher(words)

        def cut(text: str) -> tuple[np.ndarray, bytes]:
            h = shingles(text)
            n = len(h)
            first = h[: n - least_overlap(n, percent) + max(1, n * EXTRA // 100)] if n else h
            return first, struct.pack("<qqq", n, *(set_id(h) if n else (0, 0)))

        return cut

    def finish(row: pa.Table, lens: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> pa.Table:
        sums, ends = np.concatenate([[0], np.cumsum(counts > 1)]), np.cumsum(lens)
        notes = np.frombuffer(row.column("notes")[0].as_py(), "<i8").reshape(-1, 3)
        ids = row.column("ids").combine_chunks().flatten()
        place = {"chunk": pa.array(np.full(len(lens), row.column("chunk")[0].as_py())), "at": pa.array(np.arange(len(lens), dtype=np.int32))}
        return pa.table({"doc_id": ids, "n": pa.array(notes[:, 0]), "sid": pa.array(notes[:, 1]), "sid2": pa.array(notes[:, 2]), "shared": pa.array(sums[ends] - sums[ends - lens])} | place)

    # five of eight bytes tell enough: a chance match only keeps a set
    table = hashes.hash_table(docs, cutter, "jaccard_first", width=5, texts=True, chunk_chars=CHUNKS[0])
    return hashes.reassembled(table, hashes.counted(table, 5), finish, "doc_id long, n long, sid long, sid2 long, shared long, chunk long, at int", 5), table


def _ordered(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Step 2: (sid, n, tokens) of docs(doc_id, text), one for each set: shared shingles in the global order."""

    def cutter() -> Callable:
        shingles = hasher(words)

        def cut(text: str) -> tuple[np.ndarray, bytes]:
            h = shingles(text)
            return h, struct.pack("<qq", len(h), set_id(h)[0])

        return cut

    def finish(row: pa.Table, lens: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> pa.Table:
        notes = np.frombuffer(row.column("notes")[0].as_py(), "<i8").reshape(-1, 2)
        sids, sizes, tokens = [], [], []
        for (n, sid), end, length in zip(notes.tolist(), np.cumsum(lens).tolist(), lens.tolist()):
            df, h = counts[end - length : end], hashes[end - length : end]
            several = df > 1
            df, h = df[several], h[several]
            if len(h) >= least_overlap(n, percent) and n:
                order = np.argsort(df, kind="stable")  # the hashes of a text are in order
                sids.append(sid)
                sizes.append(n)
                tokens.append(np.stack([df[order], h[order].view(np.int64)], 1).ravel())
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        return pa.table({"sid": pa.array(sids, pa.int64()), "n": pa.array(sizes, pa.int64()), "tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))})

    table = hashes.hash_table(docs, cutter, "jaccard_sets", chunk_chars=CHUNKS[1])
    return hashes.reassembled(table, hashes.counted(table), finish, "sid long, n long, tokens array<long>")


def _ranked(lists: list[np.ndarray]) -> list[np.ndarray]:
    """(count, hash) pairs of each set as ranks of the global order among those present."""
    if not lists:
        return []
    flat = np.concatenate(lists).reshape(-1, 2)
    _, first, place = np.unique(np.ascontiguousarray(flat[:, 1]).view(np.uint64), return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(flat[first, 0], kind="stable")] = np.arange(len(first))  # of equal counts in the order of hashes
    return np.split(rank[place], np.cumsum([len(x) // 2 for x in lists])[:-1])


def _joined(table: pa.Table, percent: int) -> pa.Table:
    """Forest edges among the sets of one task: columns sid, n, tokens, label (known class or null), walks (compared with those that don't walk, or if all do, with all)."""
    sids, lists = table.column("sid").to_pylist(), [np.asarray(x.values) for c in table.column("tokens").chunks for x in c]
    labels, walks = table.column("label").to_pylist(), table.column("walks").to_pylist()
    walkers, stored = ([i for i, w in enumerate(walks) if w == x] for x in (True, False))
    cls = linked_classes(_ranked(lists), table.column("n").to_pylist(), percent, labels, walkers, stored or walkers)
    pairs = [(sids[i], sids[c]) for i, c in enumerate(cls) if sids[i] != sids[c]]
    return pa.table({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})


def _set_links(sets: DataFrame, percent: int) -> DataFrame:
    """Steps 3 and 4: (node, label) of sets(sid, n, tokens) that are linked with others."""
    need = F.ceil(F.col("n") * percent / 100)
    prefix = (F.col("n") - need + 1 - (F.col("n") - F.size("tokens") / 2)).cast("int")
    heads = sets.select("sid", F.posexplode(F.slice("tokens", F.lit(1), F.greatest(F.lit(0), prefix * 2))).alias("i", "h")).where("i % 2 = 1").select("sid", "h")
    heads = written(heads, "jaccard-heads")
    least = heads.groupBy("h").agg(F.min("sid").alias("v"))
    near = heads.join(written(least, "jaccard-least"), "h").where("sid <> v").select(F.col("sid").alias("u"), "v")
    candidates = written(components(near), "jaccard-candidates")
    # sets whose lengths can link are in one band or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / max(1e-6, 1.000001 * float(np.log(100 / percent))))
    placed = sets.select(F.col("sid").alias("node"), band.alias("band"), "n", (F.size("tokens") / 2).cast("long").alias("k")).join(candidates, "node")
    placed = written(placed.select(F.col("node").alias("sid"), F.col("label").alias("home"), "band", "n", "k"), "jaccard-homes")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("k") / BLOCK_TOKENS))
    counts = written(placed.groupBy("home", "band").agg(blocks.alias("blocks")), "jaccard-sizes")
    large = counts.groupBy("home").agg((F.sum("blocks") > 1).alias("large"))
    spots = placed.join(counts.join(large, "home"), ["home", "band"]).select("sid", "home", "band", F.pmod(F.xxhash64("sid"), F.col("blocks")).alias("block"), "n", "k", "large")
    spots = written(spots, "jaccard-spots")

    def join(at: DataFrame, *keys: str) -> DataFrame:
        """Links among the sets at(sid, keys, label, walks) of each group; only here their shingles move."""
        rows = sets.join(at.select("sid", *keys, "label", "walks"), "sid").select(*keys, "sid", "n", "tokens", "label", "walks")
        return rows.groupBy(*keys).applyInArrow(lambda t: _joined(t, percent), "u long, v long")

    edges = written(join(spots.withColumn("label", F.lit(None).cast("long")).withColumn("walks", F.lit(True)), "home", "band", "block"), "jaccard-links")
    spread = spots.where("large").drop("large")
    if not spread.isEmpty():

        def classed() -> DataFrame:
            known = written(components(edges), "jaccard-known")
            return written(spread.join(known.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid")), "jaccard-classed")

        # representatives of the blocks' classes meet, in blocks again
        roots = classed().where("label = sid").drop("block")
        count = roots.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
        roots = roots.join(count, "home").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("parts"))).withColumn("walks", F.lit(True))
        edges = written(edges.union(join(roots, "home", "block")), "jaccard-links")
        rows = classed()
        # the largest class of a home stays, all other sets visit the blocks where they can have a link
        count = rows.groupBy("home", "label").agg(F.count(F.lit(1)).alias("sets"))
        main = count.groupBy("home").agg(F.max(F.struct("sets", "label")).alias("m")).select("home", F.col("m.label").alias("main"))
        rows = written(rows.join(main, "home").withColumn("guest", F.col("label") != F.col("main")).drop("main"), "jaccard-places")
        guests = rows.where("guest").select("sid", "home", "band", "block", "label", "n", "k")
        # of the labels of a block the least and the largest tell whether it holds another than a guest's
        bounds = (F.min("label").alias("least"), F.max("label").alias("most"), F.min("n").alias("small"), F.max("n").alias("large"), F.max("k").alias("shared"))
        blocks = written(rows.groupBy("home", F.col("band").alias("to_band"), F.col("block").alias("to_block")).agg(*bounds), "jaccard-blocks")
        fits = f"""(label <> least or label <> most) and (band <> to_band or block <> to_block) and 100 * large >= {percent} * n and {percent} * small <= 100 * n
            and {100 + percent} * least(k, shared) >= {percent} * (n + greatest(small, ceil({percent} * n / 100)))"""
        keys = ["home", "to_band", "to_block"]
        # in homes of many blocks heads choose among these, if that takes at most twice as many rows as visits to all would be
        many = blocks.groupBy("home").agg(F.count(F.lit(1)).alias("blocks")).where(F.col("blocks") > FEW_BLOCKS)
        many = written(many.join(guests.groupBy("home").agg(F.count(F.lit(1)).alias("guests")), "home"), "jaccard-many")
        if many.isEmpty():
            met = guests.join(blocks, "home").where(fits).select("sid", *keys, "label", "k")
        else:
            places = written(heads.join(rows.join(many.select("home"), "home"), "sid"), "jaccard-head-places")
            hosts = written(places.groupBy("home", "h", F.col("band").alias("to_band"), F.col("block").alias("to_block")).agg(F.sum(F.col("guest").cast("long")).alias("guests")), "jaccard-head-blocks")
            pairs = hosts.groupBy("home", "h").agg((F.count(F.lit(1)) * F.sum("guests")).alias("pairs")).groupBy("home").agg(F.sum("pairs").alias("pairs"))
            chosen = written(many.join(pairs, "home").where("pairs <= 2 * guests * blocks").select("home"), "jaccard-by-head")
            by_head = places.where("guest").join(chosen, "home").select(*guests.columns, "h").join(hosts.drop("guests"), ["home", "h"])
            by_head = by_head.join(blocks, keys).where(fits).select("sid", *keys, "label", "k").distinct()
            met = by_head.union(guests.join(chosen, "home", "left_anti").join(blocks, "home").where(fits).select("sid", *keys, "label", "k"))
        seek = written(met, "jaccard-seek")
        # a block meets its guests in parties of about four times a block
        parties = F.greatest(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)), F.ceil(F.sum("k") / (4 * BLOCK_TOKENS)))
        parties = written(seek.groupBy(*keys).agg(parties.alias("parties")), "jaccard-parties")
        guests = seek.join(parties, keys).withColumn("party", F.pmod(F.xxhash64("sid"), F.col("parties"))).withColumn("walks", F.lit(True))
        stored = rows.select("sid", "home", F.col("band").alias("to_band"), F.col("block").alias("to_block"), "label").join(parties, keys)
        stored = stored.withColumn("party", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parties") - 1))).withColumn("walks", F.lit(False))
        cols = ["sid", *keys, "party", "label", "walks"]
        edges = written(edges.union(join(guests.select(*cols).union(stored.select(*cols)), *keys, "party")), "jaccard-links")
    return written(components(edges), "jaccard-classes")


def classes(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed, table = _hashed(docs, words, percent)
    hashed = written(hashed, "jaccard-docs")
    full = hashed.where("n > 0")
    least_id = full.groupBy("sid", "sid2").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.max("shared").alias("shared"), F.min(F.struct("chunk", "at")).alias("place"))
    least_id = written(least_id, "jaccard-distinct")
    # what any linked set would share at least of the first shingles
    asked = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) * EXTRA / 100))
    kept = least_id.where(F.col("shared") >= asked).select("place.chunk", "place.at")
    # stored by sid, so shingles move to each join's groups but not to the joins themselves
    parts = shuffle_partitions(docs.sparkSession)
    sets = written_bucketed(_ordered(hashes.texts_at(table, kept), words, percent).repartition(parts, "sid"), "jaccard_ordered", "sid", parts)
    linked = least_id.join(_set_links(sets, percent).withColumnRenamed("node", "sid"), "sid")
    linked = written(linked.select("sid", "sid2", "label", "first"), "jaccard-linked")
    whole = linked.groupBy("label").agg(F.min("first").alias("whole"))
    named = written(least_id.join(linked.join(whole, "label").select("sid", "sid2", "whole"), ["sid", "sid2"], "left").select("sid", "sid2", F.coalesce("whole", "first").alias("component_id")), "jaccard-named")
    out = full.join(named, ["sid", "sid2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(hashed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
