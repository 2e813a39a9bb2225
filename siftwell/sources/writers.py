"""Writers: results, maps that are never overwritten, line updates that change nothing else, verdicts and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(results: DataFrame, path: str) -> None:
    """All results with the requests as sent."""
    results.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def write_map(entries: DataFrame, path: str) -> None:
    """A draft for review; an existing map is left alone and raises."""
    entries.write.mode("errorifexists").json(path)


def moved_lines(entries: DataFrame, moved: DataFrame, keys: list[str]) -> DataFrame:
    """entries with the lines of moved(keys, new_line). Raises if anything but a line would change."""
    out = entries.join(moved.select(*keys, "new_line"), keys, "left").withColumn("line", F.coalesce("new_line", "line")).select(*entries.columns)
    rest = [c for c in entries.columns if c != "line"]
    if not entries.select(*rest).exceptAll(out.select(*rest)).isEmpty() or not out.select(*rest).exceptAll(entries.select(*rest)).isEmpty():
        raise ValueError("more than lines would change: a key of moved isn't unique")
    return out


def append_verdicts(verdicts: DataFrame, path: str) -> None:
    """Dated verdicts, appended; unknown ones raise before anything is written."""
    if not verdicts.where(~F.col("verdict").isin("confirmed", "false_positive") | F.col("rule").isNull() | F.col("file").isNull() | F.col("code_sha").isNull()).isEmpty():
        raise ValueError("a verdict must be confirmed or false_positive, with rule, file and code_sha")
    verdicts.withColumn("date", F.coalesce("date", F.current_date())).write.mode("append").parquet(path)


def save_snapshot(requests: DataFrame, path: str, version: int = 1) -> None:
    """What a preview showed, so that exactly that is asked later."""
    requests.withColumn("_version", F.lit(version)).write.mode("errorifexists").parquet(path)


def load_snapshot(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    rows = spark.read.parquet(path)
    if not rows.where(F.col("_version") != version).isEmpty():
        raise ValueError("the snapshot is of another version; make the preview again")
    return rows.drop("_version")
