"""How good labels are: confusion, precision, recall, area under the curve and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def confusion(rows: DataFrame, truth: Column, said: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, precision and recall (null where nothing was said or true)."""
    t, s = truth.cast("boolean"), said.cast("boolean")
    out = rows.agg(F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"), F.count_if(~t & ~s).alias("tn"))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    return out.withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))


def area_under_curve(rows: DataFrame, truth: Column, score: Column) -> DataFrame:
    """One row: n_pos, n_neg and auc, ties counting half.

    Scores are summed by value first, so that the running sum passes over distinct scores only.
    """
    per = rows.select(truth.cast("int").alias("t"), score.alias("s")).groupBy("s").agg(F.sum("t").alias("pos"), F.sum(1 - F.col("t")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(_ascending()), F.lit(0))
    per = per.withColumn("below", below)
    sums = per.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"))
    return sums.select("n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def _ascending() -> WindowSpec:
    return Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
