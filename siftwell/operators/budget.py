"""Size budgets as running sums, and the reading plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REVIEW_LEAST = 0.295
#: Steps of p in which a reading plan sums sizes before it orders any.
STEPS = 1000


def fitting(items: DataFrame, keys: list[str], order: list[Column], size: Column, most: int, at_least_one: bool = True) -> DataFrame:
    """The first items of each group whose sizes sum to no more than `most`; the very first in any case."""
    along = Window.partitionBy(*keys).orderBy(*order)
    rows = items.withColumn("_sum", F.sum(size).over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(along))
    keep = (F.col("_sum") <= most) | ((F.col("_nth") == 1) & F.lit(at_least_one))
    return rows.where(keep).drop("_sum", "_nth")


def slices(lines: DataFrame, keys: list[str], hit: Column, reach: int = 2) -> DataFrame:
    """Lines within `reach` lines of a hit."""
    around = Window.partitionBy(*keys).orderBy("line_no").rangeBetween(-reach, reach)
    return lines.withColumn("_hit", F.max(hit.cast("int")).over(around)).where("_hit = 1").drop("_hit")


def reading_plan(results: DataFrame, place: str, most: int) -> DataFrame:
    """results(id, label, p, body) in reading order, with part, place_p and listed.

    Flagged ones by severity, then reviews with p of REVIEW_LEAST or more grouped by place (the
    highest p first; a place is listed whole or not, a review without one is its own), then unknown ones, then low
    reviews. listed tells which fit the budget of characters; a null body has none.
    """
    part = F.when(F.col("label").isin("DRIFT", "BREAKS", "STALE", "UNSUPPORTED", "CHANGE"), 0).when((F.col("label") == "review") & (F.coalesce("p", F.lit(0.0)) >= REVIEW_LEAST), 1)
    part = part.when(F.col("label") == "??", 2).when(F.col("label") == "review", 3).otherwise(4)
    rows = results.withColumn("part", part).withColumn("size", F.coalesce(F.length("body"), F.lit(0)))
    group = F.when((F.col("part") == 1) & F.col(place).isNotNull(), F.col(place).cast("string")).when(F.col("part") == 1, F.concat(F.lit("no place #"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))
    rows = rows.withColumn("unit", group)
    units = rows.groupBy("part", "unit").agg(F.max(F.coalesce("p", F.lit(0.0))).alias("place_p"), F.sum("size").alias("unit_size"))
    # units are summed by part and hundredth of p; only those of the step where the budget ends are put in line
    step = F.floor(F.col("place_p") * STEPS)
    units = units.withColumn("step", step)
    steps = units.groupBy("part", "step").agg(F.sum("unit_size").alias("step_size"))
    by_step = Window.partitionBy(F.lit(0)).orderBy("part", F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)  # at most 5 x (STEPS + 1) rows for p from 0 to 1
    steps = steps.withColumn("after", F.sum("step_size").over(by_step)).withColumn("before", F.col("after") - F.col("step_size"))
    met = units.join(F.broadcast(steps.select("part", "step", "before", "after")), ["part", "step"])
    order = Window.partitionBy("part", "step").orderBy(F.col("place_p").desc(), "unit").rowsBetween(Window.unboundedPreceding, 0)
    edge = met.where((F.col("before") < most) & (F.col("after") > most)).withColumn("listed", F.col("before") + F.sum("unit_size").over(order) <= most)
    whole = met.where((F.col("before") >= most) | (F.col("after") <= most)).withColumn("listed", F.col("after") <= most)
    listed = whole.union(edge).select("part", "unit", "place_p", "listed")
    return rows.join(listed, ["part", "unit"]).drop("size", "unit_size")


def passing_over(items: DataFrame, keys: list[str], order: list[Column], size: Column, most: int) -> DataFrame:
    """items in order, each kept if it fits what room is left of `most`; what doesn't fit is passed over.

    A running sum can't pass over, so each group's sizes are folded in order; the items themselves don't
    move into the fold. Items of null size take no room.
    """
    along = Window.partitionBy(*keys).orderBy(*order)
    rows = items.withColumn("_nth", F.row_number().over(along)).withColumn("_size", F.coalesce(size, F.lit(0)).cast("long"))
    sizes = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_nth", "_size"))).alias("_all"))
    start = F.struct(F.lit(most).cast("long").alias("room"), F.array().cast("array<int>").alias("kept"))
    take = lambda acc, x: F.when(x["_size"] <= acc["room"], F.struct((acc["room"] - x["_size"]).alias("room"), F.concat(acc["kept"], F.array(x["_nth"])).alias("kept"))).otherwise(acc)
    kept = sizes.select(*keys, F.explode(F.aggregate("_all", start, take)["kept"]).alias("_nth"))
    return rows.join(kept, [*keys, "_nth"], "left_semi").select(*items.columns)


def fair_shares(items: DataFrame, keys: list[str], size: Column, room: int) -> DataFrame:
    """items with share: how much of a group's room each may have, so that none has less than another unless it needs less.

    With sizes in line, the level is the room that the smaller ones leave, dealt to those not smaller, at the
    first size above it; where no size is, all have what they need. Shares are whole numbers.
    """
    along = Window.partitionBy(*keys).orderBy("_size")
    rows = items.withColumn("_size", F.coalesce(size, F.lit(0)).cast("long"))
    rows = rows.withColumn("_k", F.row_number().over(along)).withColumn("_less", F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
    whole = Window.partitionBy(*keys)
    level = F.floor((F.lit(room) - F.col("_less")) / (F.count(F.lit(1)).over(whole) - F.col("_k") + 1))
    rows = rows.withColumn("_level", level)
    rows = rows.withColumn("_cut", F.min_by(F.when(F.col("_size") > F.col("_level"), F.col("_level")), F.when(F.col("_size") > F.col("_level"), F.col("_k"))).over(whole))
    return rows.withColumn("share", F.least("_size", F.coalesce("_cut", F.col("_size")))).drop("_size", "_k", "_less", "_level", "_cut")
