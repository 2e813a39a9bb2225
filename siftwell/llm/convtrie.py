"""A trie of conversations: each distinct sequence of first turns is a node, with its members and what lies below.

`numbered` puts the turns of each conversation in line by one sort of the whole table and numbers them
across its partitions. `rebuilt` replaces the first turns of a conversation by those of another. A node
is known by its depth and two 64-bit sums (exclusive or) of its turns' hashes, each taken with its position, so the
sums of all prefixes are running sums. `node_tables` makes the trie by merging partial ones:
what each partition holds is combined where it lies, and rounds of merges keyed by node and lane add up
the members and join the end lists of up to MERGED lanes, until one lane is left. An end list lies in pieces of
neighbouring ids, PIECE at most, which are hashed in order without ever being whole in memory.

`rolled_up` adds up subtrees from the bottom. A node belongs to the chain of the member with the
smallest hash, so each chain is one conversation's path from some depth on, whatever the shape of the trie. The
totals of chains climb from chain to chain, adding to the nodes where they hang; as hashes are
random, a path meets about as many chains as the logarithm of the number of conversations, and that
many rounds suffice. Sums along a chain are running sums. These are taken in blocks of BLOCK positions, so
one conversation with a third of all turns is spread over many tasks, as are the children of one node.

Cases: null roles and texts are empty; turns of equal number are in line by role and text; repeated rows are
turns of their own; rows without a conversation take no part; further columns are ignored. An empty
table gives no nodes, any other has a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import SALTS, written

BLOCK, PIECE, MERGED = 4096, 4096, 16
#: Turns that one conversation gives to another are fewer than this.
GIVEN, FAMILY = 9, 5
NODE = ["depth", "k1", "k2"]


def numbered(df: DataFrame) -> DataFrame:
    """(conv, i, turn_hash, n_bytes) of df(conv_id, turn, role, text): the turns of each conversation numbered from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = df.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    # the last key parts rows that are equal in all columns, which are as good as each other
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_tie")]
    line = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    turn_hash = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            start = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            k = np.arange(1, len(conv) + 1) - np.repeat(start, np.diff([*start, len(conv)]))
            if conv[0] == last:
                k[: start[1] if len(start) > 1 else len(conv)] += seen
            last, seen = conv[-1], int(k[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k)], [*batch.schema.names, "k"])

    ddl = "conv long, part int, turn_hash binary, n_bytes long, k long"
    own = written(line.select("conv", F.spark_partition_id().alias("part"), turn_hash.alias("turn_hash"), F.octet_length("text").cast("long").alias("n_bytes")).mapInArrow(run, ddl), "trie-turns")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(before)).where("before > 0")
    # only the first conversation of a partition can have begun in another, so this has a row a partition at most
    return own.join(F.broadcast(parts.select("conv", "part", "before")), ["conv", "part"], "left").select("conv", (F.col("k") + F.coalesce("before", F.lit(0))).alias("i"), "turn_hash", "n_bytes")


def running(df: DataFrame, key: list[str], order: Column, values: dict[str, Column], add: str) -> DataFrame:
    """df with running totals by `order` (whole numbers from 0) within each key: {new name: column}, added up by the aggregate named `add`.

    Taken within blocks of BLOCK numbers and over the blocks, so that no group is longer than a block.
    """
    total = getattr(F, add)
    rows = df.withColumns({"_order": order, "_block": F.floor(order / BLOCK).cast("long")})
    blocks = rows.groupBy(*key, "_block").agg(*[total(c).alias(f"_before_{n}") for n, c in values.items()])
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*key, "_block", *[total(f"_before_{n}").over(before).alias(f"_before_{n}") for n in values])
    within = Window.partitionBy(*key, "_block").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[total(c).over(within).alias(n) for n, c in values.items()]).join(carried, [*key, "_block"])
    joined = {n: (F.col(n).bitwiseXOR(F.coalesce(f"_before_{n}", F.lit(0))) if add == "bit_xor" else F.col(n) + F.coalesce(f"_before_{n}", F.lit(0))) for n in values}
    return rows.withColumns(joined).drop("_order", "_block", *[f"_before_{n}" for n in values])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after the exchange: turns(conv, pos, turn_hash, n_bytes), conversations(conv, length).

    The first h turns of conversation c are those of conversation c - c % FAMILY (fewer if it has
    fewer), then c's own follow after its first h; h is the CRC-32 of c in decimal, modulo GIVEN.
    """
    convs = turns.groupBy("conv").agg(F.max("i").alias("n"))
    convs = convs.withColumns({"base": F.expr(f"conv - conv % {FAMILY}"), "h": F.crc32(F.col("conv").cast("string").cast("binary")) % GIVEN})
    bases = convs.where("conv = base").select("base", F.col("n").alias("of_base"))
    own_all = F.col("conv") == F.col("base")
    convs = convs.join(bases, "base", "left").withColumn("given", F.when(own_all, 0).otherwise(F.least("h", F.coalesce("of_base", F.lit(0)))))
    convs = convs.withColumn("cut", F.when(own_all, 0).otherwise(F.col("h"))).withColumn("length", F.col("given") + F.greatest(F.col("n") - F.col("cut"), F.lit(0)))
    convs = written(convs, "trie-conversations")
    blocks = convs.select("conv", "given", "cut", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / BLOCK).cast("long"))).alias("block"))
    own = turns.withColumn("block", F.floor(F.col("i") / BLOCK).cast("long")).join(blocks, ["conv", "block"]).where("i > cut")
    own = own.select("conv", (F.col("i") - F.col("cut") + F.col("given")).alias("pos"), "turn_hash", "n_bytes")
    givers = turns.where(f"i < {GIVEN} and conv % {FAMILY} = 0").withColumnRenamed("conv", "base")
    given = givers.join(convs.where("given > 0").select("conv", "base", "given"), "base").where("i <= given")
    return own.unionByName(given.select("conv", F.col("i").alias("pos"), "turn_hash", "n_bytes")), convs.select("conv", "length")


def members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node that a conversation passes: node, parent, conv, bytes of its last text, and whether the conversation ends there."""
    salted = lambda s: F.xxhash64(F.lit(s), "pos", "turn_hash")
    rows = turns.select("conv", "pos", "n_bytes", salted(1).alias("e1"), salted(2).alias("e2"))
    rows = running(rows, ["conv"], F.col("pos"), {"k1": F.col("e1"), "k2": F.col("e2")}, "bit_xor")
    ends = convs.select("conv", F.col("length").alias("pos"), F.lit(True).alias("ends"))
    below = rows.join(ends, ["conv", "pos"], "left").select(
        F.col("pos").alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("e2")).alias("p2"), "conv", "n_bytes", F.coalesce("ends", F.lit(False)).alias("ends")
    )
    zero = F.lit(0).cast("long")
    root = convs.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), "conv", zero.alias("n_bytes"), (F.col("length") == 0).alias("ends"))
    return below.unionByName(root)


def merged(tables: DataFrame, key: list[str], aggs: list[Column], again: list[Column], lanes: int) -> DataFrame:
    """Partial tables merged by key in rounds: each brings up to MERGED lanes into one, after what lies together is combined."""
    while True:
        lanes = -(-lanes // MERGED)
        tables = tables.withColumn("lane", F.floor(F.col("lane") / MERGED).cast("int")).groupBy(*key, "lane").agg(*aggs)
        aggs = again
        if lanes <= 1:
            return tables.drop("lane")


def node_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of members(): nodes(node, parent, n_bytes, n_convs, conv, chain), ends(node, ends_sha256) for nodes where a conversation ends."""
    rows = rows.withColumns({"lane": F.spark_partition_id(), "own": F.struct(F.xxhash64("conv").alias("by"), F.col("conv").alias("conv"))})
    rows = written(rows, "trie-members")
    lanes = (rows.agg(F.max("lane")).first()[0] or 0) + 1
    least = [F.min(c).alias(c) for c in ("p1", "p2", "n_bytes", "conv", "own")]
    nodes = merged(rows, NODE, [F.count(F.lit(1)).alias("n_convs"), *least], [F.sum("n_convs").alias("n_convs"), *least], lanes)
    pieces = rows.where("ends").withColumn("piece", F.floor(F.col("conv") / PIECE).cast("long"))
    pieces = merged(pieces, [*NODE, "piece"], [F.collect_list("conv").alias("ids")], [F.flatten(F.collect_list("ids")).alias("ids")], lanes)
    return nodes.withColumn("chain", F.col("own.conv")).drop("own"), hashed_lists(pieces)


def hashed_lists(pieces: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the ids of all pieces of a node, ascending and joined by commas, piece after piece."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3])], [*NODE, "ends_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in [*NODE, "ids"])):
                if node == own:
                    state.update(b",")
                else:
                    done += [(*node, state.hexdigest())] if node else []
                    node, state = own, hashlib.sha256()
                state.update(",".join(map(str, ids)).encode())
            if done:
                yield table(done)
        if node:
            yield table([(*node, state.hexdigest())])

    rows = pieces.withColumn("ids", F.array_sort("ids")).repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    return rows.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with n_children, and with parent_conv_id and parent_chain of their parents; the children of one node meet it in up to SALTS groups."""
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    dealt = nodes.where("depth > 0").withColumn("_salt", F.pmod(F.xxhash64("k1", "k2"), F.lit(SALTS)).cast("int"))
    part = dealt.select(*up, "_salt").groupBy(*NODE, "_salt").agg(F.count(F.lit(1)).alias("n"))
    counts = part.groupBy(*NODE).agg(F.sum("n").alias("n_children"), F.collect_list("_salt").alias("_salts"))
    known = nodes.select(*NODE, "conv", "chain").join(counts, NODE)
    parents = known.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"), F.col("chain").alias("parent_chain"), F.explode("_salts").alias("_salt"))
    below = dealt.join(parents, ["depth", "p1", "p2", "_salt"]).drop("_salt")
    root = nodes.where("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast("long"), "parent_chain": F.lit(None).cast("long")})
    return below.unionByName(root).join(counts.drop("_salts"), NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def rolled_up(nodes: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """nodes of with_parents() with sums over their subtrees: {name: value of one node}."""
    names = list(sums)
    nodes = nodes.withColumns({f"_{n}": c for n, c in sums.items()})
    again = [F.sum(n).alias(n) for n in names]
    totals = nodes.groupBy("chain").agg(*[F.sum(f"_{n}").alias(n) for n in names])
    heads = nodes.where("parent_chain is null or parent_chain <> chain").select("chain", "parent_chain", (F.col("depth") - 1).alias("at"))
    heads = written(heads.where("parent_chain is not null"), "trie-chains")
    climbing, added = written(totals.join(heads, "chain"), "trie-climbing"), []
    while not climbing.isEmpty():
        added.append(climbing.groupBy(F.col("parent_chain").alias("chain"), F.col("at").alias("depth")).agg(*again))
        higher = climbing.groupBy(F.col("parent_chain").alias("chain")).agg(*again)
        climbing = written(higher.join(heads, "chain"), "trie-climbing")
    for more in added:
        nodes = nodes.unionByName(more, allowMissingColumns=True)
    own = {n: F.coalesce(F.sum(f"_{n}"), F.lit(0)) + F.coalesce(F.sum(n), F.lit(0)) for n in names}
    if added:  # what hangs below a node is added to the node's own row
        kept = [c for c in nodes.columns if c not in ("chain", "depth", *names, *[f"_{n}" for n in names])]
        nodes = nodes.groupBy("chain", "depth").agg(*[F.max(c).alias(c) for c in kept], *[v.alias(f"_{n}") for n, v in own.items()])
    # depths run downwards, and totals upwards: positions count from the deepest node of all
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    return running(nodes, ["chain"], F.lit(deepest) - F.col("depth"), {n: F.col(f"_{n}") for n in names}, "sum").drop(*[f"_{n}" for n in names])


def trie(df: DataFrame) -> DataFrame:
    """The nodes of the trie of df(conv_id, turn, role, text) after rebuilt(): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes, ends = node_tables(members(*rebuilt(numbered(df))))
    nodes = written(with_parents(written(nodes, "trie-nodes")), "trie-parents")
    sums = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")}
    out = rolled_up(nodes, sums).join(ends, NODE, "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
