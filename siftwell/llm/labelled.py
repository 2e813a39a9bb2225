"""A bounded sample of labelled texts, and a logistic score over a few features of each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A longer text takes part with so many characters, in ten pieces spread over all of it.
SAMPLE_CHARS = 20_000


def held_out(id_col: Column, mod: int, rest: int) -> Column:
    """True for rows that nothing is learned from. A null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod == rest


def sample(docs: DataFrame, labels: DataFrame, label: str, held: Column, most: dict[int, int]) -> dict[int, list[str]]:
    """Texts by label (1 where any label of the id is above 0): for each at most most[label] ids by a hash, those of `held` (over doc_id) left out.

    Empty texts, null ids and null labels take no part; of rows with one id the smallest text does. Narrow
    rows first: ids are chosen from the labels, and these, at most the sum of `most`, are broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held)
    known = known.groupBy(F.col("doc_id").alias("_id")).agg((F.max(label) > 0).cast("int").alias("_label"))
    ids = None
    for value, n in most.items():
        own = known.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(n)
        ids = own if ids is None else ids.union(own)
    text, piece = F.col("text").cast("string"), SAMPLE_CHARS // 10
    spread = F.concat_ws(" ", *[F.substr(text, F.floor((F.length(text) - piece) * i / 9).cast("int") + 1, F.lit(piece)) for i in range(10)])
    rows = (
        docs.select(F.col("doc_id").alias("_id"), F.when(F.length(text) > SAMPLE_CHARS, spread).otherwise(text).alias("_text"))
        .where(F.length("_text") > 0)
        .join(F.broadcast(ids), "_id")
        .groupBy("_id", "_label")
        .agg(F.min("_text").alias("_text"))
        .orderBy("_id")
        .collect()
    )
    return {value: [r["_text"] for r in rows if r["_label"] == value] for value in most}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> list[float]:
    """Weights of the columns of x by Newton's method."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = chance(list(w), x)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def chance(weights: list[float], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.array(weights), -30, 30)))
