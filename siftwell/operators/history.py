"""Versions of a project: which files changed between two snapshots, and the last commit that touched each path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators import closure


def snapshot(files: DataFrame) -> DataFrame:
    """(path, size, hash) of files(path, text): what a later snapshot is compared with. Of repeated paths the largest text counts."""
    one = files.where("path is not null").groupBy("path").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    return one.select("path", F.length("text").cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state): paths of two snapshots that were added, changed or removed; equal ones are left out. One full outer join of hashes."""
    old, new = (s.select("path", F.col("hash").alias(n)) for s, n in ((before, "_old"), (after, "_new")))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return old.join(new, "path", "full_outer").select("path", state.alias("state")).where("state is not null")


def refreshed(rows: DataFrame, changes: DataFrame, again: DataFrame) -> DataFrame:
    """An index rows(path, ...) after changes(path, state): rows of untouched paths stay, those of added and changed ones come from `again`, which is parsed of these alone."""
    touched = changes.select("path")
    return rows.join(touched, "path", "left_anti").unionByName(again.join(changes.where("state <> 'removed'").select("path"), "path", "left_semi"))


def last_commits(touches: DataFrame, renames: DataFrame) -> DataFrame:
    """(path, last, n): the newest commit of touches(path, at) under any name that became a path by renames(old, new), and how many there were."""
    names = closure.newest_names(renames)
    now = touches.where("path is not null").join(names, F.col("path") == F.col("name"), "left").select(F.coalesce("newest", "path").alias("path"), "at")
    return now.groupBy("path").agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
