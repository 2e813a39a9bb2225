"""From documents to sentences: paragraphs, headings, tables, requirement sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T

#: Lines of the shape of code, and routes as sentences write them.
CODE_LINE = (
    r"^(?:>>>|\.\.\.\s)|^(?:async\s+)?def\s+\w+\s*\(|^class\s+\w+\s*[(:{<]|^(?:fn|func|function|let|const|var|val|pub)\s+\w+\s*[(<:=]"
    r"|^import\s+[\w.*]+\s*(?:;|$)|^import\s+[{*]|^from\s+[\w.]+\s+import\s+[\w*(]|^(?:return|raise|yield|await|assert)\s+[^\s]*[.(\[]"
    r"|^\S+\s*=\s*\S+$|^[\w.\[\]]+\s*[-+*/%|&]?=\s*[\w.]+\(|^[\w.]+\(.*\)\s*;?$|^(?:if|for|while|switch|catch|else\s+if)\s*\(.*\)\s*\{\s*$|\w\([^()]*\)\s*[;{]\s*$"
)
ROUTE = r"\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+`?(/[^\s`,;)\]]*)"


def line_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_no from 1, line) of every line; rows of null text give none."""
    return df.select(*keys, F.posexplode(T.lines(F.col(text))).alias("_i", "line")).select(*keys, (F.col("_i") + 1).alias("line_no"), "line")


def sentence_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, sentence_no from 1, sentence)."""
    return df.select(*keys, F.posexplode(T.sentences(F.col(text))).alias("_i", "sentence")).select(*keys, (F.col("_i") + 1).alias("sentence_no"), "sentence")


def paragraph_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_no, paragraph): wrapped lines joined, each with the line it starts on."""
    return df.select(*keys, F.explode(T.paragraphs(T.normal_newlines(F.col(text)))).alias("p")).select(*keys, F.col("p.line").alias("line_no"), F.col("p.text").alias("paragraph"))


def requirement_rows(df: DataFrame, keys: list[str], text: str = "text", least: float = 5) -> DataFrame:
    """(keys, line_no, sentence, is_code): sentences that may be requirements.

    Headings, fences and table heads go; a table row is its cells joined; a top-level list item under
    a heading that is a statement begins with the heading. Sentences shaped like code are marked, not
    dropped, so that they can be listed. The windows run along one document.
    """
    rows = paragraph_rows(df, keys, text).withColumn("t", F.trim("paragraph"))
    along = Window.partitionBy(*keys).orderBy("line_no")
    before = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("fence", F.col("t").startswith("```")).withColumn("in_fence", F.sum(F.col("fence").cast("int")).over(before) % 2 == 1)
    rows = rows.where(~F.col("fence") & ~F.col("in_fence"))
    heading = F.when(F.col("t").startswith("#"), F.trim(F.regexp_replace("t", F.lit("^#+"), F.lit(""))))
    rows = rows.withColumn("heading", F.last(heading, ignorenulls=True).over(before))
    # a table's rows follow its rule line; a blank line or a heading ends the table
    rule = F.col("t").rlike(r"^\|?[\s:|-]*-[\s:|-]*\|?$") & (F.col("t") != "")
    state = F.when(rule, True).when((F.col("t") == "") | F.col("t").startswith("#"), False)
    rows = rows.withColumn("in_table", F.coalesce(F.last(state, ignorenulls=True).over(before), F.lit(False)))
    rows = rows.where((F.col("t") != "") & ~F.col("t").startswith("#") & ~rule)
    rows = rows.where(~F.col("t").startswith("|") | F.col("in_table"))
    item = F.col("t").rlike(r"^([-*+]|\d+\.)\s") & ~F.col("paragraph").rlike(r"^\s")
    rows = rows.select(*keys, "line_no", "heading", item.alias("item"), F.posexplode(T.sentences(F.col("paragraph"))).alias("i", "s"))
    bare = F.when(F.trim("s").startswith("|"), T.table_cells(F.col("s"))).otherwise(F.col("s"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, F.lit(r"^[ \-*|#>]+|[ \-*|#>]+$"), F.lit("")), F.lit(r"\s+"), F.lit(" ")))
    rows = rows.withColumn("plain", bare)
    led = F.col("item") & (F.col("i") == 0) & T.is_statement(F.coalesce("heading", F.lit("")))
    rows = rows.withColumn("sentence", F.when(led, F.concat("heading", F.lit(": "), "plain")).otherwise(F.col("plain")))
    code = (F.col("sentence").rlike(CODE_LINE) | F.trim("s").rlike(CODE_LINE)) & ~F.col("sentence").rlike(ROUTE)
    return rows.where(T.long_enough(F.col("sentence"), least)).select(*keys, "line_no", "sentence", code.alias("is_code"))


def mentions(sentence: Column) -> Column:
    """struct(names, numbers, routes, paths) that a sentence names."""
    names = F.filter(
        F.concat(F.regexp_extract_all(sentence, F.lit(r"`([A-Za-z_][\w.\-]{2,})`"), 1), F.regexp_extract_all(sentence, F.lit(r"(?<!\w)([A-Z][A-Z0-9_]{3,})(?!\w)"), 1)), lambda x: F.length(x) > 0
    )
    verb = F.regexp_extract_all(sentence, F.lit(ROUTE), 1)
    path = F.transform(F.regexp_extract_all(sentence, F.lit(ROUTE), 2), lambda p: F.regexp_replace(p, F.lit(r"\.+$"), F.lit("")))
    return F.struct(
        F.array_distinct(names).alias("names"),
        F.regexp_extract_all(sentence, F.lit(r"(?<!\w)(\d+(?:\.\d+)?)(?!\w)"), 1).alias("numbers"),
        F.zip_with(verb, path, lambda v, p: F.concat_ws(" ", v, p)).alias("routes"),
        F.regexp_extract_all(sentence, F.lit(r"`(/[^\s`]*)`"), 1).alias("paths"),
    )
