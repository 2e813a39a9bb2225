"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that one task of a shuffle takes where partitions follow the input's size.
TASK_BYTES = 32 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="siftwell-")
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back."""
    path = f"{shared_dir(df.sparkSession)}/siftwell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame, row_bytes: Column) -> int:
    """How many tasks share the rows of df, at TASK_BYTES each; row_bytes: about the size of a row. Reads df, so it should be stored."""
    return -(-int(df.agg(F.sum(row_bytes).cast("long")).first()[0] or 0) // TASK_BYTES)


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """df in so many partitions of the keys, if they are more than Spark would make: a task's share doesn't grow with the input."""
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
