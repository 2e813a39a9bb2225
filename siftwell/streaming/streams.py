"""Structured Streaming forms. Late rows follow the watermark; a late row never relabels what is settled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.functions import keys as K


def new_requests(requests: DataFrame, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Requests by their key, each once within the watermark."""
    return requests.withWatermark(at, late).dropDuplicatesWithinWatermark(["request_key"])


def failure_counts(lines: DataFrame, at: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, signature, n, jobs) of error lines(job, kind, line, ts), merged as the batch form does."""
    rows = lines.withColumn("signature", K.signature(F.col("kind"), F.col("line"))).withWatermark(at, late)
    return rows.groupBy(F.window(at, window), "signature").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("job")).alias("jobs"))


def activity_islands(events: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Islands of a key's events without a silence longer than `gap`."""
    rows = events.withWatermark(at, late)
    return rows.groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("started"), F.max(at).alias("ended"))


def over_limit(events: DataFrame, key: str, most: int, at: str = "ts", span: str = "60 seconds", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Sliding windows in which a key has more than `most` events."""
    return events.withWatermark(at, late).groupBy(F.window(at, span, slide), key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def into_cache(answers: DataFrame, path: str, checkpoint: str, upsert: Callable[[DataFrame, str], None]) -> StreamingQuery:
    """Micro-batches of answers into a cache; upsert must be idempotent on (request_key, n), as a batch may be replayed."""
    return answers.writeStream.foreachBatch(lambda batch, _: upsert(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
