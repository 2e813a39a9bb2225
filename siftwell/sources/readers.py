"""Readers of files as tables; each has a form for columns, so that any store that Spark reads will do."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import schemas
from siftwell.functions import redact as R
from siftwell.functions import text as T

SIZE_CAP = 1_500_000
IGNORED = r"(^|/)(\.git|node_modules|vendor|dist|build|target|\.venv|venv|__pycache__|\.tox)/"


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-16 by its mark, else UTF-8 without one; newlines made alike."""
    mark = F.hex(F.substring(content, 1, 2))
    return T.normal_newlines(F.when(mark.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).otherwise(F.decode(content, "UTF-8")))


def text_files(spark: SparkSession, folder: str, pattern: str = "*", most: int = SIZE_CAP) -> DataFrame:
    """(path, text, modified) of the files below a folder: ignored folders, secret and oversized files stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    files = files.where((F.col("length") <= most) & ~F.col("path").rlike(IGNORED) & ~R.secret_file(F.col("path")))
    return files.select("path", decoded(F.col("content")).alias("text"), F.col("modificationTime").alias("modified"))


def head_lines(text: Column, n: int = 40) -> Column:
    return F.slice(T.lines(text), 1, n)


def logs(spark: SparkSession, folder: str, pattern: str = "*.log", most: int = 25_000_000) -> DataFrame:
    """(file, text, cut): the last `most` bytes of each log, from a line's start."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    cut = F.col("length") > most
    text = F.decode(F.when(cut, F.substring("content", -most, most)).otherwise(F.col("content")), "UTF-8")
    return files.select(F.col("path").alias("file"), F.when(cut, F.regexp_replace(text, F.lit(r"^[^\n]*\n"), F.lit(""))).otherwise(text).alias("text"), cut.alias("cut"))


def junit_failures(reports: DataFrame) -> DataFrame:
    """(file, test, kind, message, tail, problem) of reports(file, xml): one row a failed test case, or one with why a report can't be read.

    A report never needs a DTD; one that declares it or entities is refused unparsed.
    """
    refused = reports.where(F.col("xml").rlike(r"(?i)<!(DOCTYPE|ENTITY)"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        for part in parts:
            rows = []
            for file, xml in zip(part["file"], part["xml"]):
                try:
                    root = ElementTree.fromstring(xml or "")
                except ElementTree.ParseError as e:
                    rows.append((file, None, None, None, None, f"not XML: {e}"))
                    continue
                for tc in root.iter("testcase"):
                    bad = next((c for c in tc if c.tag in ("failure", "error")), None)
                    if bad is not None:
                        test = "::".join(x for x in (tc.get("file") or tc.get("classname"), tc.get("name")) if x)
                        rows.append((file, test[:160], bad.get("type", bad.tag), bad.get("message", ""), "\n".join((bad.text or "").splitlines()[-25:]), None))
            yield pd.DataFrame(rows, columns=["file", "test", "kind", "message", "tail", "problem"])

    read = reports.where(~F.col("xml").rlike(r"(?i)<!(DOCTYPE|ENTITY)")).select("file", "xml").mapInPandas(run, "file string, test string, kind string, message string, tail string, problem string")
    read = read.withColumn("message", F.substring(R.scrub(R.light_clean(F.col("message"))), 1, 240)).withColumn("tail", F.array_join(F.transform(F.split("tail", "\n"), lambda x: R.scrub(R.light_clean(x))), "\n"))
    none = F.lit(None).cast("string")
    return read.unionByName(refused.select("file", none.alias("test"), none.alias("kind"), none.alias("message"), none.alias("tail"), F.lit("declares a DTD or entities").alias("problem")))


def openapi_routes(contracts: DataFrame) -> DataFrame:
    """(file, verb, path, operation_id) of JSON contracts(file, text), below the first server's path."""
    doc = F.from_json("text", "basePath string, servers array<struct<url:string>>, paths map<string,map<string,string>>")
    rows = contracts.select("file", doc.alias("d")).where("d.paths is not null")
    base = F.coalesce("d.basePath", F.regexp_replace(F.get("d.servers", F.lit(0))["url"], F.lit("^https?://[^/]+"), F.lit("")), F.lit(""))
    rows = rows.select("file", F.regexp_replace(base, F.lit("/+$"), F.lit("")).alias("base"), F.explode("d.paths").alias("path", "ops"))
    rows = rows.select("file", "base", "path", F.explode("ops").alias("verb", "op")).where(F.lower("verb").isin("get", "post", "put", "patch", "delete", "head", "options"))
    return rows.select("file", F.upper("verb").alias("verb"), F.concat("base", "path").alias("path"), F.get_json_object("op", "$.operationId").alias("operation_id"))


def settings(files: DataFrame) -> DataFrame:
    """(file, line, key, value, profile) of .properties and environment templates in files(path, text).

    A line that ends with a backslash goes on in the next; a real environment file is never read.
    """
    plain = files.where(F.col("path").rlike(r"\.properties$|\.env\.(example|sample|template|dist)$") & ~R.secret_file(F.col("path")))
    joined = F.regexp_replace(T.normal_newlines(F.col("text")), F.lit(r"\\\n[ \t]*"), F.lit("\u0001"))
    rows = plain.select(F.col("path").alias("file"), F.posexplode(F.split(joined, "\n", -1)).alias("i", "raw"), joined.alias("_t"))
    before = F.slice(F.split("_t", "\n", -1), F.lit(1), F.col("i"))
    skipped = F.aggregate(before, F.lit(0), lambda a, x: a + F.length(x) - F.length(F.replace(x, F.lit("\u0001"), F.lit(""))))
    rows = rows.withColumn("line", F.col("i") + 1 + skipped).withColumn("raw", F.regexp_replace(F.replace("raw", F.lit("\u0001"), F.lit("")), F.lit("^export +"), F.lit(""))).where(~F.trim("raw").rlike("^([#!]|$)"))
    key = F.regexp_extract("raw", r"^\s*((?:[^=:\s\\]|\\.)+)\s*[=:\s]", 1)
    value = F.trim(F.regexp_extract("raw", r"^\s*(?:[^=:\s\\]|\\.)+\s*[=:\s]\s*(.*)$", 1))
    profile = F.nullif(F.regexp_extract("file", r"application-([\w-]+)\.properties$", 1), F.lit(""))
    return rows.where(key != "").select("file", "line", key.alias("key"), value.alias("value"), profile.alias("profile"))


def yaml_settings(files: DataFrame) -> DataFrame:
    """(file, key, value, profile) of YAML files in files(path, text), nested keys joined by dots; unreadable ones give no rows."""

    def flat(prefix: str, node: object) -> Iterator[tuple[str, str | None]]:
        if isinstance(node, dict):
            for k, v in node.items():
                yield from flat(f"{prefix}.{k}" if prefix else str(k), v)
        elif isinstance(node, list):
            for i, v in enumerate(node):
                yield from flat(f"{prefix}[{i}]", v)
        else:
            yield prefix, None if node is None else str(node).lower() if isinstance(node, bool) else str(node)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for part in parts:
            rows = []
            for path, text in zip(part["path"], part["text"]):
                try:
                    docs = [d for d in yaml.safe_load_all(text or "") if isinstance(d, dict)]
                except yaml.YAMLError:
                    continue
                for d in docs:
                    profile = (((d.get("spring") or {}).get("config") or {}).get("activate") or {}).get("on-profile") if isinstance(d.get("spring"), dict) else None
                    rows += [(path, k, v, profile) for k, v in flat("", d) if k]
            yield pd.DataFrame(rows, columns=["file", "key", "value", "profile"])

    yaml_files = files.where(F.col("path").rlike(r"\.ya?ml$") & ~R.secret_file(F.col("path")))
    return yaml_files.select("path", "text").mapInPandas(run, "file string, key string, value string, profile string")


def spec_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, problems) of a spec map: every bad entry has a line in problems, none is dropped unseen."""
    schema = schemas.SPEC_MAP.replace("code array<string>", "code string").replace("alternatives array<string>", "alternatives string")
    rows = spark.read.schema(f"entries array<struct<{', '.join(x.replace(' ', ':', 1) for x in schema.split(', '))}>>").option("multiLine", "true").json(path)
    rows = rows.select(F.posexplode("entries").alias("i", "e")).select("i", "e.*")
    as_list = lambda c: F.when(F.col(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.when(F.col(c).isNotNull(), F.array(c)))
    rows = rows.withColumn("code", as_list("code")).withColumn("alternatives", as_list("alternatives"))
    why = F.when(F.col("spec").isNull() | (F.trim("spec") == ""), "no spec").when(F.col("text").isNull() | (F.trim("text") == ""), "no text")
    why = why.when(F.col("line") < 1, "the line is not a line number").when(~F.coalesce("status", F.lit("draft")).isin("draft", "reviewed", "excluded"), "unknown status")
    why = why.when((F.coalesce("status", F.lit("draft")) == "reviewed") & (F.coalesce(F.size("code"), F.lit(0)) < 1), "reviewed without code")
    rows = rows.withColumn("problem", why)
    return rows.where("problem is null").drop("i", "problem"), rows.where("problem is not null").select("i", "problem")


def rule_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rules, problems) of a rule map, like spec_map."""
    fields = ", ".join(x.replace(" ", ":", 1) for x in schemas.RULE_MAP.split(", "))
    rows = spark.read.schema(f"version int, entries array<struct<{fields}>>").option("multiLine", "true").json(path).select(F.posexplode("entries").alias("i", "e")).select("i", "e.*")
    why = F.when(F.coalesce(F.trim("rule"), F.trim("text"), F.lit("")) == "", "no rule").when(~F.coalesce("status", F.lit("draft")).isin("draft", "reviewed", "excluded"), "unknown status")
    rows = rows.withColumn("problem", why.when(F.size(F.filter(F.coalesce("scope", F.array()), lambda g: F.trim(g) == "")) > 0, "an empty glob in the scope"))
    return rows.where("problem is null").drop("i", "problem"), rows.where("problem is not null").select("i", "problem")


def rule_files(files: DataFrame) -> DataFrame:
    """Files that hold rules by their names: agents' files, contribution and style guides."""
    name = r"(?i)(^|/)(AGENTS|CLAUDE|GEMINI|CONTRIBUTING|STYLE(?:_?GUIDE)?|CODING[-_ ]?(?:STYLE|STANDARDS|GUIDELINES)|CONVENTIONS)[^/]*\.(md|rst|txt|mdx)$|(^|/)(\.cursor/rules|\.clinerules|\.claude/rules)/[^/]+$"
    return files.where(F.col("path").rlike(name) & ~F.col("path").rlike(IGNORED) & ~R.secret_file(F.col("path")))
