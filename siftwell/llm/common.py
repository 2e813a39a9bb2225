"""Helpers shared by the operators of this subpackage: tables, the shared folder, salted lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}

#: Sub-groups that a hot key is dealt into before its rows meet.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="siftwell-")
    return _own_dirs[app]


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends here and no executor's loss undoes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftwell/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like written(), but in buckets of key, so that a later join or cogroup on key moves only its other side."""
    spark = df.sparkSession
    tag = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/siftwell/{tag}"
    (df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).format("parquet").saveAsTable(tag))
    return spark.table(tag)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_totals(df: DataFrame, keys: list[str], salt_of: list[str], aggs: dict, again: dict) -> tuple[DataFrame, DataFrame]:
    """(df with a column _salt, totals by keys and _salt): the totals of a whole group, once for each of its sub-groups.

    aggs makes the partial totals of a sub-group, again combines them. A join of both by keys and
    _salt brings a hot group together in up to SALTS tasks instead of one.
    """
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_of), F.lit(SALTS)).cast("int"))
    part = dealt.groupBy(*keys, "_salt").agg(*[v.alias(k) for k, v in aggs.items()])
    whole = part.groupBy(*keys).agg(F.collect_list("_salt").alias("_salts"), *[v.alias(k) for k, v in again.items()])
    return dealt, whole.withColumn("_salt", F.explode("_salts")).drop("_salts")
