"""Exact top-k inner products by best-first search in M-trees.

A vector x of squared length at most M gets one more coordinate, sqrt(M - |x|^2), and a query a zero
there: then |q - x|^2 = |q|^2 + M - 2 q.x, so the largest inner products are the nearest neighbours
in a metric space. Vectors are dealt to shards by their nearest pivot (pivots are a bounded sample;
a crowded one is dealt on to several shards), and each shard holds an M-tree of three levels: routing
nodes and leaf pages with centre, covering radius, smallest distance and the distance to the parent's
centre, and entries with their distance to the page's centre. Centres are rows of the tree, as in any
M-tree, so a comparison with a centre is that row's comparison too and no row is compared twice.

A query first searches a shard of the pivot of its largest product. The k-th score found there goes with it: shards of
a pivot p with radius r can't matter where q.p + |q| r is less, and the search of the others begins with
that bound. A block of queries that began at neighbouring pivots searches a tree together: in each round every query takes its page
of the least possible distance, and the queries at one page are evaluated at once. Pages whose centre
needn't be compared (by the parent's distance), and each query's entries by their own, are passed over
by the triangle inequality; a search ends when no page can hold a better score or an equal one.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows without
an id; shorter vectors count as padded with zeros; a repeated row is a row of its own, and only the
query's own row is left out; ties go to the smaller id; scores beyond 64 bits are clamped. With
fewer candidates than k all are returned; empty tables give empty results. Further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import written

SHARD_ROWS, PAGE_ROWS, QUERY_BLOCK, MOST_PIVOTS = 8192, 96, 4096, 512


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _chosen(points: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of n points at random, the nearest of them for each point, its distance)."""
    rows = np.sort(rng.choice(len(points), n, replace=False))
    d = np.concatenate([_distances(points[i : i + 2048], points[rows]) for i in range(0, len(points), 2048)])
    d[rows, np.arange(n)] = 0
    return rows, d.argmin(1), d.min(1)


@dataclass
class Page:
    centre: int  # a number of MTree.centres
    radius: float  # largest distance of a vector below from the centre
    hole: float  # smallest one
    to_parent: float
    below: np.ndarray  # page numbers of a routing node, rows of a leaf (the first leaf of a centre begins with its row)
    own: np.ndarray | None = None  # a leaf's distances from the centre


class MTree:
    """An M-tree over integer vectors (rows), sorted by id."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        x = vectors.astype(np.float64)
        square = (x * x).sum(1)
        self.most = float(square.max(initial=0.0))
        points = np.concatenate([x, np.sqrt(np.maximum(self.most - square, 0))[:, None]], 1)
        self.leaves: list[Page] = []
        self.nodes: list[Page] = []
        self.centres = np.zeros(0, np.int64)  # rows
        self.compared = 0
        n = len(x)
        if not n:
            return
        rng = np.random.default_rng(11)
        rows, home, dist = _chosen(points, max(1, -(-n // PAGE_ROWS)), rng)
        at = points[rows]
        self.centres = rows
        is_centre = np.zeros(n, bool)
        is_centre[rows] = True
        for c in range(len(rows)):
            mine = np.flatnonzero((home == c) & ~is_centre)
            mine = np.concatenate([rows[c : c + 1], mine[np.argsort(dist[mine], kind="stable")]])
            dist[rows[c]] = 0.0
            for i in range(0, len(mine), PAGE_ROWS):  # rings around the centre
                part = mine[i : i + PAGE_ROWS]
                self.leaves.append(Page(c, float(dist[part].max()), float(dist[part].min()), 0.0, part, dist[part]))
        tops, near, above = _chosen(at, max(1, int(len(rows) ** 0.5)), rng)
        of = np.array([p.centre for p in self.leaves])
        for t in range(len(tops)):
            mine = np.flatnonzero(near[of] == t)
            if len(mine):
                below = np.concatenate([self.leaves[i].below for i in mine])
                far = _distances(at[tops[t]][None, :], points[below])[0]
                for i in mine:
                    self.leaves[i].to_parent = float(above[of[i]])
                self.nodes.append(Page(int(tops[t]), float(far.max()), float(far.min()), 0.0, mine))

    def search(self, queries: np.ndarray, k: int, skip: np.ndarray, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best rows of each query, -1 where there are fewer.

        skip: a row of its own for each query, or -1. floor: scores below it needn't be found.
        """
        n, m = len(queries), len(self.vectors)
        q = queries.astype(np.float64)
        exact = float(np.abs(q).sum(1).max(initial=0.0)) * float(np.abs(self.vectors).max(initial=0)) < 2**53 / max(1, m)
        best = np.full((n, k), -1, np.int64)
        if not exact:  # too large for doubles: whole numbers of Python, without a bound
            top = np.full((n, k), None, object)
            for i in range(n):
                scores = [(-int(np.dot(queries[i].astype(object), v.astype(object))), r) for r, v in enumerate(self.vectors) if r != skip[i]]
                for j, (s, r) in enumerate(sorted(scores)[:k]):
                    top[i, j], best[i, j] = -s, r
            self.compared += n * m
            return best, top
        top = np.full((n, k), -np.inf)
        if not m or not n:
            return best, top
        length = (q * q).sum(1)
        slack = 1e-6 * (1 + np.sqrt(length + self.most))
        floor = np.full(n, -np.inf) if floor is None else floor
        data = self.vectors.astype(np.float64)

        def distance(score: np.ndarray, own: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(length[own] + self.most - 2 * score, 0))

        def bounded(own: np.ndarray) -> None:
            low[own] = np.maximum(top[own, -1], floor[own])
            known = np.isfinite(low[own])
            reach[own] = np.where(known, distance(np.where(known, low[own], 0), own), np.inf)

        def offered(own: np.ndarray, got: np.ndarray, rows: np.ndarray) -> None:
            """Scores of rows for the queries `own`, -inf where a row doesn't count."""
            good = (got >= low[own][:, None]) & (got > -np.inf)
            who, what = np.flatnonzero(good.any(1)), np.flatnonzero(good.any(0))
            if not len(who):
                return
            own, got, rows = own[who], np.where(good, got, -np.inf)[np.ix_(who, what)], rows[what]
            scores = np.concatenate([top[own], got], 1)
            ids = np.concatenate([best[own], np.broadcast_to(rows, got.shape)], 1)
            pick = np.lexsort((ids, -scores), axis=1)[:, :k]
            top[own], best[own] = np.take_along_axis(scores, pick, 1), np.take_along_axis(ids, pick, 1)
            bounded(own)

        low, reach = np.full(n, -np.inf), np.full(n, np.inf)  # score and distance of the k-th best row so far
        everyone = np.arange(n)
        bounded(everyone)
        to_centre, of_centre = (np.full((n, len(self.centres)), np.nan) for _ in range(2))

        def centres(own: np.ndarray, which: np.ndarray) -> None:
            """Compares queries with centres; each pair once."""
            fresh = np.isnan(to_centre[np.ix_(own, which)])
            if not fresh.any():
                return
            got = np.rint(q[own] @ data[self.centres[which]].T)
            self.compared += int((fresh & (skip[own][:, None] != self.centres[which])).sum())  # its own score a query knows
            of_centre[np.ix_(own, which)] = got
            to_centre[np.ix_(own, which)] = np.sqrt(np.maximum(length[own][:, None] + self.most - 2 * got, 0))

        g = len(self.nodes)
        bound = np.full((n, g + len(self.leaves)), np.inf)
        centres(everyone, np.array([p.centre for p in self.nodes]))
        for j, p in enumerate(self.nodes):
            d = to_centre[:, p.centre]
            bound[:, j] = np.maximum(0, np.maximum(d - p.radius, p.hole - d))
        leaf_centre = np.array([p.centre for p in self.leaves])
        radius, hole, to_parent = (np.array([getattr(p, x) for p in self.leaves]) for x in ("radius", "hole", "to_parent"))
        while True:
            page = bound.argmin(1)
            live = np.flatnonzero(bound[everyone, page] <= reach + slack)
            live = live[np.isfinite(bound[live, page[live]])]
            if not len(live):
                return best, top
            order = live[np.argsort(page[live], kind="stable")]
            for own in np.split(order, np.flatnonzero(np.diff(page[order])) + 1):
                at = int(page[own[0]])
                bound[own, at] = np.inf
                if at < g:  # leaf pages: first by the stored distance to the parent
                    below = self.nodes[at].below
                    top_distance = to_centre[own, self.nodes[at].centre][:, None]
                    near = np.abs(top_distance - to_parent[below]) - radius[below] <= (reach[own] + slack[own])[:, None]
                    some, pages = own[near.any(1)], below[near.any(0)]
                    if len(some):
                        centres(some, np.unique(leaf_centre[pages]))
                        d = to_centre[np.ix_(some, leaf_centre[pages])]
                        ahead = np.maximum(0, np.maximum(d - radius[pages], hole[pages] - d))
                        bound[np.ix_(some, g + pages)] = np.where(near[np.ix_(near.any(1), near.any(0))], ahead, np.inf)
                else:
                    p = self.leaves[at - g]
                    near = np.abs(to_centre[own, p.centre][:, None] - p.own[None, :]) <= (reach[own] + slack[own])[:, None]
                    near &= skip[own][:, None] != p.below[None, :]
                    got = np.full(near.shape, -np.inf)
                    if p.below[0] == self.centres[p.centre]:
                        got[:, 0] = np.where(near[:, 0], of_centre[own, p.centre], -np.inf)
                        near[:, 0] = False
                    who, what = np.nonzero(near)
                    self.compared += len(who)
                    if len(who) * 4 < near.size:
                        got[who, what] = np.rint(np.einsum("ij,ij->i", q[own[who]], data[p.below[what]]))
                    else:  # dense enough for one product of matrices
                        got = np.where(near, np.rint(q[own] @ data[p.below].T), got)
                    offered(own, got, p.below)


# ---------------------------------------------------------------- tables


def scaled(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component x as double; null for vectors that take no part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~odd, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    rows = [np.array(x.as_py(), np.int64) for x in column] if len(column) else []
    width = max([len(r) for r in rows], default=0) if width is None else width
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.concatenate([a, np.zeros((len(a), width - a.shape[1]), a.dtype)], 1)


def _pivots(vectors: DataFrame) -> np.ndarray:
    """A bounded sample of vectors(row, vec_id, v): one for each SHARD_ROWS, at most MOST_PIVOTS."""
    n = vectors.count()
    sample = vectors.orderBy(F.xxhash64("vec_id", "row")).limit(max(1, min(MOST_PIVOTS, -(-n // SHARD_ROWS)))).select("v").toArrow()
    return _matrix(sample.column("v"))


def homes(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vectors(row, vec_id, v) with pivot (the nearest one), away (the distance from it) and lead (the pivot of the largest product)."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2))
            p = _widened(pivots, x.shape[1]).astype(np.float64)
            x = _widened(x, p.shape[1]).astype(np.float64)
            d, lead = (_distances(x, p), (x @ p.T).argmax(1)) if len(p) else (np.zeros((len(x), 1)), np.zeros(len(x)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1)), pa.array(lead.astype(np.int32))], [*batch.schema.names, "pivot", "away", "lead"])

    return written(vectors.mapInArrow(nearest, "row long, vec_id long, v array<long>, pivot int, away double, lead int"), "mtree-homes")


def top_k(df: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, counts: list | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id is divisible by query_every.

    counts: if given, the function that returns (comparisons made, pairs of a query and a row) is appended.
    """
    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col), scale).alias("v"))
    vectors = vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    vectors = written(vectors, "mtree-vectors")
    pivots = _pivots(vectors)
    homed = homes(vectors, pivots)
    # at most MOST_PIVOTS rows: shards, queries and radius of each pivot
    is_query = F.col("vec_id") % query_every == 0
    each = homed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.sum(is_query.cast("long")).alias("queries"), F.max("away").alias("radius")).orderBy("pivot").collect()
    shards = {r["pivot"]: -(-r["n"] // SHARD_ROWS) for r in each}
    began = homed.where(is_query).groupBy("lead").agg(F.count(F.lit(1)).alias("n")).orderBy("lead").collect()
    # leads share a block up to QUERY_BLOCK queries; one with more has several
    blocks, parts, size = {}, {}, 0
    for r in began:
        fresh = not blocks or size + r["n"] > QUERY_BLOCK
        size = r["n"] if fresh else size + r["n"]
        blocks[r["lead"]] = r["lead"] if fresh else list(blocks.values())[-1]
        parts[r["lead"]] = -(-r["n"] // QUERY_BLOCK)
    radius = {r["pivot"]: r["radius"] for r in each}

    def number_of(pivot: str, numbers: dict[int, int]) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])[F.col(pivot)], F.lit(1)) if numbers else F.lit(1)

    def dealt(name: Column, n: Column, seed: int = 0) -> Column:
        return F.concat_ws("-", name, F.pmod(F.xxhash64("row", F.lit(seed)), n))

    homed = homed.withColumn("shard", dealt(F.col("pivot"), number_of("pivot", shards)))

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array(table.column("vec_id")), kind="stable")
        table = table.take(pa.array(order))
        tree = MTree(_matrix(table.column("v")))
        body = pickle.dumps((tree, np.array(table.column("vec_id")), np.array(table.column("row"))), protocol=5)
        return pa.table({"shard": [table.column("shard")[0].as_py()], "tree": pa.array([body], pa.binary())})

    index = written(homed.select("shard", "row", "vec_id", "v").groupBy("shard").applyInArrow(build, "shard string, tree binary"), "mtree-index")
    queries = homed.where(is_query).select("row", "vec_id", "v", "lead", dealt(F.col("lead"), number_of("lead", shards), 1).alias("shard"), dealt(number_of("lead", blocks), number_of("lead", parts), 2).alias("block"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        """Queries (row, vec_id, v, floor) of one block against the tree of one shard; the best k each, then a row with the number of comparisons."""
        schema = pa.schema([(x, pa.int64()) for x in ("q_row", "query_id", "row", "vec_id", "score", "compared")])
        if not len(left) or not len(right):
            return schema.empty_table()
        tree, ids, rows = pickle.loads(right.column("tree")[0].as_py())
        q = _matrix(left.column("v"))
        q_rows, q_ids = np.array(left.column("row")), np.array(left.column("vec_id"))
        floor = np.array([-np.inf if x is None else float(x) for x in left.column("floor").to_pylist()])
        place = {r: i for i, r in enumerate(rows.tolist())}
        skip = np.array([place.get(r, -1) for r in q_rows.tolist()], np.int64)
        width = max(q.shape[1], tree.vectors.shape[1])
        q = _widened(q, width)
        if tree.vectors.shape[1] < width:
            tree = MTree(_widened(tree.vectors, width))
        best, top = tree.search(q, k, skip, floor)
        found = [(i, best[i, j], top[i, j]) for i in range(len(q)) for j in range(k) if best[i, j] >= 0 and top[i, j] is not None and top[i, j] != -np.inf]
        cols = [[q_rows[i] for i, _, _ in found], [q_ids[i] for i, _, _ in found], [rows[r] for _, r, _ in found], [ids[r] for _, r, _ in found], [max(-(2**63), min(2**63 - 1, int(s))) for _, _, s in found]]
        arrays = [pa.array([*(int(x) for x in c), None], pa.int64()) for c in cols]
        return pa.Table.from_arrays([*arrays, pa.array([None] * len(found) + [tree.compared], pa.int64())], schema=schema)

    def searched(pairs: DataFrame) -> DataFrame:
        """search() for queries with a shard and a block each; a tree meets each block that asks for it."""
        asks = pairs.select(F.col("shard").alias("_shard"), F.col("block").alias("_block")).distinct()
        trees = index.join(asks, F.col("shard") == F.col("_shard")).select("shard", F.col("_block").alias("block"), "tree")
        ddl = "q_row long, query_id long, row long, vec_id long, score long, compared long"
        return pairs.select("shard", "block", "row", "vec_id", "v", "floor").groupBy("shard", "block").cogroup(trees.groupBy("shard", "block")).applyInArrow(search, ddl)

    first = written(searched(queries.withColumn("floor", F.lit(None).cast("long"))), "mtree-first")
    kth = first.where("q_row is not null").groupBy("q_row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shards that may hold a score of at least floor, but for the one that was searched."""
        numbers = np.array(sorted(shards), np.int64)
        reach = np.array([radius[p] for p in numbers.tolist()])
        for batch in batches:
            q = _matrix(batch.column(2))
            p = _widened(pivots, q.shape[1]).astype(np.float64)[numbers] if len(pivots) else np.zeros((len(numbers), q.shape[1]))
            q = _widened(q, p.shape[1]).astype(np.float64)
            size = np.sqrt((q * q).sum(1))
            most = q @ p.T + size[:, None] * reach[None, :] + 1e-6 * (1 + size[:, None] * (1 + np.abs(p).max(initial=0)))
            floor = np.array([-np.inf if x is None else float(x) for x in batch.column(6).to_pylist()])
            seen = batch.column(4).to_pylist()
            wanted = [[s for x in numbers[most[i] >= floor[i]].tolist() for j in range(shards[x]) if (s := f"{x}-{j}") != seen[i]] for i in range(len(q))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(wanted, pa.list_(pa.string()))], [*batch.schema.names, "wanted"])

    bounded = queries.join(kth, queries["row"] == kth["q_row"], "left").select("row", "vec_id", "v", "lead", "shard", "block", "floor")
    asked = bounded.mapInArrow(elsewhere, "row long, vec_id long, v array<long>, lead int, shard string, block string, floor long, wanted array<string>")
    asked = written(asked.select("row", "vec_id", "v", "block", "floor", F.explode("wanted").alias("shard")), "mtree-asked")
    found = first.union(searched(asked))
    if counts is not None:
        found = written(found, "mtree-found")
        counts.append(lambda: (found.agg(F.sum("compared")).first()[0] or 0, sum(r["queries"] for r in each) * max(0, sum(r["n"] for r in each) - 1)))
    order = Window.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.where("q_row is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
