"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

Each source gets a target share of all words by its weight; a target stops at `max_copies` times the
source's size and the excess is shared again by weight (water filling, in closed form over the
sources in the order in which they reach their caps). A document is to be copied target / size of
its source times: the whole part always, the fraction by pivotal rounding. Two fractional
probabilities meet and mass moves at random from one to the other until one of them is 0 or 1, which
is decided; the other meets the next. Neighbours in size meet, the largest first, so the words taken stay near the
target and not only the number of documents.

The pairing runs in a reduction tree: blocks of about BLOCK documents of a source and a class of size
(CLASSES to a doubling) fold into decided rows and one residual each, the residuals fold in blocks
again, up to one for each class; these fold to one for each source, which is rounded alone. No group holds more than about BLOCK rows whatever a source's share of them. Random
numbers are hashes of the ids that meet and of the seed, so reruns agree.

Cases: null or empty texts have size 0 and are taken 0 times; a null source is a source of its own,
ordered last; repeated rows are documents of their own (of more than BLOCK rows equal in id and text
each is dealt by its row's number, as their hash alone would put them all into one block); an empty table gives an empty result. Sources of size 0 have target 0. Further
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import written

WORD = "[^\\x20\\x09-\\x0D]+"
#: Documents that fold into one residual at each level of the tree, and classes of size to a doubling.
BLOCK, CLASSES = 256, 8


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """(row, doc_id, source, size, deal, number): words of each document, a hash that deals documents to blocks, and a number of the row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(
        (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(17), F.col(id_col), text).alias("deal"),
        F.monotonically_increasing_id().alias("number"),
    )


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_copies: int = 3) -> DataFrame:
    """(source, source_size, n_docs, target): one row for each source.

    The windows here see one row a source, never documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_copies)
    everyone = Window.partitionBy(F.lit(0))
    filled = Window.partitionBy(F.lit(0)).orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everyone)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after).cast("double")
    per = per.withColumn("total", total).withColumn("capped", F.col("cap").cast("double") < level * F.col("weight"))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everyone).cast("double")
    spent = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everyone), F.lit(0))
    shared = (F.col("total") - spent).cast("double") / free * F.col("weight")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.least(shared, F.col("cap").cast("double")))
    return per.select("source", "source_size", "n_docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _fold(items: Column, seed: int) -> Column:
    """Pivotal rounding along an array of (size, deal, doc_id, row, p): struct(carry, decided array of (row, doc_id, size, up))."""

    def decided(x: Column, up: int) -> Column:
        return F.struct(x["row"].alias("row"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), F.lit(up).alias("up"))

    def carrying(x: Column, p: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["deal"].alias("deal"), x["doc_id"].alias("doc_id"), x["row"].alias("row"), p.alias("p"))

    def meet(acc: Column, x: Column) -> Column:
        c = acc["carry"]
        s = c["p"] + x["p"]
        u = _unit(F.lit(seed), c["doc_id"], c["deal"], x["doc_id"], x["deal"], F.lit("meet"))
        low, to_x, c_up = s < 1, u < x["p"] / s, u < (1 - x["p"]) / (2 - s)
        carry = F.when(low, F.when(to_x, carrying(x, s)).otherwise(carrying(c, s))).otherwise(F.when(c_up, carrying(x, s - 1)).otherwise(carrying(c, s - 1)))
        done = F.when(low, F.when(to_x, decided(c, 0)).otherwise(decided(x, 0))).otherwise(F.when(c_up, decided(c, 1)).otherwise(decided(x, 1)))
        return F.struct(carry.alias("carry"), F.concat(acc["decided"], F.array(done)).alias("decided"))

    none = F.expr("cast(array() as array<struct<row:bigint,doc_id:bigint,size:bigint,up:int>>)")
    first = F.struct(items[0].alias("carry"), none.alias("decided"))
    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), first, meet)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, weights: tuple[int, ...] = (5, 2, 1), max_copies: int = 3, seed: int = 7) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies, taken): how often the mix takes each document.

    row is the value of row_col, carried along for those who need to tell rows apart.
    """
    sized = written(sizes(df, id_col, text_col, source_col, row_col), "mix-sizes")
    return _rounded(sized, written(source_targets(sized, weights, max_copies), "mix-sources"), seed)


def _rounded(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    named = sources.withColumnRenamed("source", "_source")
    docs = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    docs = docs.withColumn("whole", F.floor(rate).cast("int")).withColumn("p", rate - F.floor(rate))
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    keep = ["source", "source_size", "target", "whole"]
    shut = docs.where(~open_).select("row", "doc_id", "size", *keep, F.lit(0).alias("up"))

    def decided(folded: DataFrame) -> DataFrame:
        return folded.select(F.explode("f.decided").alias("d"), *keep).select("d.row", "d.doc_id", "d.size", *keep, "d.up")

    results, tops = [shut], []
    class_ = F.floor(F.log2("size") * CLASSES).cast("int")
    classed = docs.where(open_).withColumn("class", class_)
    crowds = written(classed.groupBy("deal").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK).select(F.col("deal").alias("_deal")), "mix-crowds")
    spot = F.col("deal")
    if not crowds.isEmpty():
        classed = classed.join(crowds, F.col("deal") == F.col("_deal"), "left")
        spot = F.when(F.col("_deal").isNull(), F.col("deal")).otherwise(F.xxhash64("deal", "number"))
    counts = sized.where("size > 0").groupBy(F.col("source").alias("_source"), class_.alias("_class")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    counts = written(counts, "mix-classes")
    level = classed.join(counts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class")))
    level = level.select(*keep, "class", "blocks", F.pmod(spot, F.col("blocks")).alias("block"), F.struct("size", "deal", "doc_id", "row", "p").alias("item"))
    most = counts.agg(F.max("blocks")).first()[0] or 0
    while most:
        folded = level.groupBy(*keep, "class", "blocks", "block").agg(_fold(F.sort_array(F.collect_list("item"), asc=False), seed).alias("f"))
        folded = written(folded, "mix-level")
        results.append(decided(folded))
        tops.append(folded.where("blocks = 1").select(*keep, F.col("f.carry").alias("item")))
        # blocks of the level above: about BLOCK residuals each
        above = F.ceil(F.col("blocks") / BLOCK)
        level = folded.where("blocks > 1").select(*keep, "class", above.alias("blocks"), F.pmod(F.col("block"), above).alias("block"), F.col("f.carry").alias("item"))
        most = 0 if most == 1 else -(-most // BLOCK)
    # one residual a class is left in each source: a fixed number, as sizes are bounded
    if tops:
        rest = tops[0]
        for t in tops[1:]:
            rest = rest.unionByName(t)
        folded = written(rest.groupBy(*keep).agg(_fold(F.sort_array(F.collect_list("item"), asc=False), seed).alias("f")), "mix-top")
        results.append(decided(folded))
        last = folded.select(F.col("f.carry").alias("item"), *keep)
        up = F.when(_unit(F.lit(seed), F.col("item.doc_id"), F.col("item.deal"), F.lit("last")) < F.col("item.p"), 1).otherwise(0)
        results.append(last.select("item.row", "item.doc_id", "item.size", *keep, up.alias("up")))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    copies = F.col("whole") + F.col("up")
    return out.select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
