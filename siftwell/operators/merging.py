"""Aggregations: requests asked alike, twins, registries, verdict records, families and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T

#: A rule's record is stated from so many verdicts, and poor from such a share of false positives.
RECORD_LEAST, RECORD_SHARE = 5, 0.6
FLAGGED = ("BREAKS", "review")
FIXED_TOKENS, CHARS_PER_TOKEN, PRICE = 259, 3.4, 0.042 / 1_000_000


def asked_alike(requests: DataFrame, key: str = "request_key", order: str = "seq") -> DataFrame:
    """requests with the column asked_as: the first row with the same key, whose answer all share.

    An aggregate and a join by key, not a window: a key that holds a third of all rows is summed before it moves.
    """
    first = requests.groupBy(key).agg(F.min(order).alias("asked_as"))
    return requests.join(first, key)


def twins(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, duplicate_of): texts equal to an earlier one but for case, punctuation and spacing."""
    rows = df.select(F.col(id_col).alias("id"), F.sha2(T.normalised(F.col(text_col)), 256).alias("key"), (T.normalised(F.col(text_col)) != "").alias("some")).where("some")
    first = rows.groupBy("key").agg(F.min("id").alias("duplicate_of"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(first, "key").where("id <> duplicate_of").select("id", "duplicate_of")


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the order: what a registry keeps."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def effective_config(rows: DataFrame) -> DataFrame:
    """(key, value, uses) of rows(key, role, file, line, value, profile, is_test): the first plain definition's value, and where the key is used."""
    role = F.when(F.col("role") == "defined", 0).when(F.col("role") == "bound", 1).when(F.col("role") == "used", 2).otherwise(3)
    plain = (F.col("role") == "defined") & F.col("value").isNotNull() & F.col("profile").isNull() & ~F.col("is_test")
    return rows.groupBy("key").agg(
        F.min_by(F.when(plain, F.col("value")), F.when(plain, F.struct("file", "line"))).alias("value"),
        F.array_sort(F.collect_list(F.struct(role.alias("o"), "file", "line"))).alias("uses"),
    )


def latest(verdicts: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last row of each key."""
    values = [c for c in verdicts.columns if c not in keys]
    return verdicts.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order)).alias("v")).select(*keys, "v.*")


def rule_records(verdicts: DataFrame) -> DataFrame:
    """(rule, false_positives, verdicts, poor): each finding's last verdict counted once."""
    good = verdicts.where(F.col("verdict").isin("confirmed", "false_positive"))
    last = latest(good, ["rule", "file", "code_sha"])
    per = last.groupBy("rule").agg(F.count_if(F.col("verdict") == "false_positive").alias("false_positives"), F.count(F.lit(1)).alias("verdicts"))
    return per.withColumn("poor", (F.col("verdicts") >= RECORD_LEAST) & (F.col("false_positives") / F.col("verdicts") >= RECORD_SHARE))


def apply_verdicts(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """results with recorded (what was recorded for this rule and this code) and poor_record; labels stay as they are."""
    good = verdicts.where(F.col("verdict").isin("confirmed", "false_positive"))
    last = latest(good, ["rule", "file", "code_sha"]).select("rule", "file", "code_sha", F.col("verdict").alias("_verdict"))
    poor = rule_records(verdicts).where("poor").select("rule", F.lit(True).alias("_poor"))
    out = results.join(last, ["rule", "file", "code_sha"], "left").join(poor, "rule", "left")
    flagged = F.col("label").isin(*FLAGGED)
    return out.withColumn("recorded", F.when(flagged, F.col("_verdict"))).withColumn("poor_record", F.coalesce(flagged & F.col("_poor"), F.lit(False))).drop("_verdict", "_poor")


def family(path: Column) -> Column:
    """What the versions of one document share: its path without dates, versions and words of age."""
    low = F.lower(path)
    out = F.regexp_replace(low, F.lit(r"\d{4}-\d{2}-\d{2}|\bv?\d+(?:\.\d+)*\b|\b(?:old|new|draft|final|archive[d]?|legacy|deprecated|latest|current|copy)\b"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(out, F.lit(r"[-_. ]+"), F.lit("-")), F.lit(r"-*/-*"), F.lit("/"))


def newest_of_family(docs: DataFrame, order: list[Column]) -> DataFrame:
    """docs(path, ...) with family and newest: the path that is last by the order, null where the last are tied."""
    rows = docs.withColumn("family", family(F.col("path"))).withColumn("_rank", F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)]))
    top = rows.groupBy("family").agg(F.max("_rank").alias("_top"))
    best = rows.join(top, "family").where(F.col("_rank") == F.col("_top")).groupBy("family").agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("_path"))
    return rows.drop("_rank").join(best.select("family", F.when(F.col("_n") == 1, F.col("_path")).alias("newest")), "family")


def health(results: DataFrame, place: str, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rates, places): the share of ?? in all results, and the places most results are paired with."""
    rates = results.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "??").alias("n_unknown"))
    return rates, results.groupBy(place).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), place).limit(most)


def estimated_tokens(body: Column) -> Column:
    """Tokens of one request: a fixed charge and its characters."""
    return (F.floor(F.length(body) / CHARS_PER_TOKEN) + FIXED_TOKENS).cast("long")
