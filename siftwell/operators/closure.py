"""Paths through trees and chains by doubling: as many rounds as the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.tables import dealt, tasks_for, written


def prefixes_above(edges: DataFrame) -> DataFrame:
    """(node, root, depth, prefix): for every node of edges(parent, child, prefix), each path down to it from a root, and the prefixes along it.

    A root is a parent that is no child; it has an empty path to itself. Paths that meet a node again are
    cut, so cycles give none. Each round joins paths with those that lead to where they begin, so their length
    doubles; it has as many partitions as the paths' size asks for. Repeated edges count once; edges with a null
    end take no part, null prefixes are empty.
    """
    own = written(edges.where("parent is not null and child is not null").select("parent", "child", F.coalesce("prefix", F.lit("")).alias("prefix")), "edges")
    n = tasks_for(own, 64 + F.length("prefix"))
    own = written(dealt(own, n, "parent").distinct(), "edges")
    ends = lambda c: dealt(own.select(F.col(c).alias("node")), n, "node").distinct()
    roots = written(ends("parent").join(ends("child"), "node", "left_anti"), "roots")
    is_root = roots.withColumnRenamed("node", "top").withColumn("done", F.lit(True))
    start = own.where("parent <> child").select(F.col("child").alias("node"), F.col("parent").alias("top"), "prefix", F.array("child").alias("seen"))
    start = dealt(start, n, "top").join(dealt(is_root, n, "top"), "top", "left")
    nothing = own.schema["child"].dataType
    trivial = roots.select("node", F.col("node").alias("top"), F.lit("").alias("prefix"), F.array().cast(f"array<{nothing.simpleString()}>").alias("seen"), F.lit(True).alias("done"))
    paths = written(start.withColumn("done", F.coalesce("done", F.lit(False))).select("node", "top", "prefix", "seen", "done").unionByName(trivial), "paths")
    while not (open_paths := paths.where("not done")).isEmpty():
        n = tasks_for(paths, 64 + F.length("prefix") + 24 * F.size("seen"))
        above = paths.select(F.col("node").alias("top"), F.col("top").alias("_top"), F.col("prefix").alias("_prefix"), F.col("seen").alias("_seen"), F.col("done").alias("_done"))
        met = dealt(open_paths.drop("done"), n, "top").join(dealt(above, n, "top"), "top").where(~F.arrays_overlap("seen", "_seen") & ~F.array_contains("seen", F.col("_top")))
        longer = met.select("node", F.col("_top").alias("top"), F.concat("_prefix", "prefix").alias("prefix"), F.concat("_seen", "seen").alias("seen"), F.col("_done").alias("done"))
        paths = written(paths.where("done").unionByName(longer), "paths")
    return paths.select("node", F.col("top").alias("root"), F.size("seen").alias("depth"), "prefix")


def newest_names(renames: DataFrame) -> DataFrame:
    """(name, newest): where the chain of renames(old, new) that begins at each old name ends; names on a cycle have none.

    A name is renamed once: of several, the smallest new name counts.
    """
    step = renames.where("old is not null and new is not null and old <> new").groupBy("old").agg(F.min("new").alias("new"))
    ends = written(step.select(F.col("old").alias("name"), F.col("new").alias("to")), "names")
    final = ends.select(F.col("to").alias("name")).distinct().join(ends.select("name"), "name", "left_anti").withColumnRenamed("name", "to").withColumn("done", F.lit(True))
    final = written(final, "names-final")
    n, rounds = ends.count(), 0
    while 2**rounds <= n and not ends.join(final, "to", "left_anti").isEmpty():
        further = ends.select(F.col("name").alias("to"), F.col("to").alias("_to"))
        ends = written(ends.join(further, "to", "left").select("name", F.coalesce("_to", "to").alias("to")), "names")
        rounds += 1
    return ends.join(final, "to", "left_semi").select("name", F.col("to").alias("newest"))
