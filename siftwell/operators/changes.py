"""Changes: diffs by file and line, tokens that they add or remove, and claims of their descriptions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import redact as R
from siftwell.functions import text as T

ROOM, LEAST_WORDS = 2600, 4
COMMENT_ONLY = r"^\s*(?:#(?!\[|include|define|if|endif|pragma)|//|/\*|\*(?:\s|/|$)|<!--)"


def sections(diffs: DataFrame) -> DataFrame:
    """(change_id, file_no, path, section) of diffs(change_id, diff): one row a file; files of secrets are left out."""
    rows = diffs.select("change_id", F.posexplode(F.split("diff", "(?m)^(?=diff --git )")).alias("file_no", "section")).where(F.col("section").startswith("diff --git "))
    new, old = F.regexp_extract("section", r"(?m)^\+\+\+ (?:b/)?([^\t\n]+)", 1), F.regexp_extract("section", r"(?m)^--- (?:a/)?([^\t\n]+)", 1)
    head = F.regexp_extract("section", r"^diff --git a/(.+?) b/\1(?:\n|$)", 1)
    renamed = F.regexp_extract("section", r"(?m)^rename to (.+)$", 1)
    path = F.when((new != "") & (new != "/dev/null"), new).when((old != "") & (old != "/dev/null"), old).when(renamed != "", renamed).otherwise(head)
    path = F.regexp_replace(F.regexp_replace(path, F.lit('^"|"$'), F.lit("")), F.lit("^b/"), F.lit(""))
    rows = rows.withColumn("path", path)
    return rows.where((F.col("path") != "") & ~R.secret_file(F.col("path"))).select("change_id", "file_no", "path", "section")


def diff_lines(section_rows: DataFrame) -> DataFrame:
    """(change_id, path, sign, line_no, line): added lines with their new number, removed ones with the old.

    Hunk headers tell how many lines follow, so a line that looks like a header inside a hunk is data.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        head = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
        for part in parts:
            rows = []
            for change, path, text in zip(part["change_id"], part["path"], part["section"]):
                old = new = left_old = left_new = 0
                for ln in text.split("\n"):
                    if left_old <= 0 and left_new <= 0:
                        if m := head.match(ln):
                            old, new = int(m[1]), int(m[3])
                            left_old, left_new = int(m[2] or 1), int(m[4] or 1)
                        continue
                    if ln.startswith("+"):
                        rows.append((change, path, "+", new, ln[1:]))
                        new, left_new = new + 1, left_new - 1
                    elif ln.startswith("-"):
                        rows.append((change, path, "-", old, ln[1:]))
                        old, left_old = old + 1, left_old - 1
                    elif not ln.startswith("\\"):
                        old, new, left_old, left_new = old + 1, new + 1, left_old - 1, left_new - 1
            yield pd.DataFrame(rows, columns=["change_id", "path", "sign", "line_no", "line"])

    return section_rows.select("change_id", "path", "section").mapInPandas(run, "change_id string, path string, sign string, line_no int, line string")


def distinctive_names(line: Column) -> Column:
    """Dotted, snake and camel names of six letters or more, no file names."""
    found = F.regexp_extract_all(line, F.lit(r"([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)"), 1)
    parts = F.flatten(F.transform(found, lambda t: F.concat(F.array(t), F.split(t, r"\."))))
    keep = lambda t: (F.length(t) >= 6) & (t.rlike(r"[a-z][A-Z]") | t.rlike(r"[A-Za-z0-9]_[A-Za-z0-9]") | t.contains(".")) & ~t.rlike(r"\.[a-z]{1,4}$")
    return F.array_distinct(F.filter(parts, keep))


def literal_texts(line: Column) -> Column:
    """Texts of string literals: 12 characters or more between placeholders, with 8 letters."""
    found = F.concat(F.regexp_extract_all(line, F.lit(r"\"([^\"\\]{12,})\""), 1), F.regexp_extract_all(line, F.lit(r"'([^'\\]{12,})'"), 1))
    pieces = F.flatten(F.transform(found, lambda s: F.split(s, r"\$?\{[^}]*\}|%[sdrif]")))
    trimmed = F.transform(pieces, lambda p: F.trim(p))
    return F.array_distinct(F.filter(trimmed, lambda p: (F.length(p) >= 12) & (F.length(F.regexp_replace(p, F.lit(r"[^\p{L}]"), F.lit(""))) >= 8)))


def change_tokens(line_rows: DataFrame) -> DataFrame:
    """(change_id, path, token, verb): names and texts that a file's added lines have and its removed ones lack, and the reverse."""
    code = line_rows.where(~F.col("line").rlike(COMMENT_ONLY)).withColumn("line", F.substring("line", 1, 2000))
    tokens = code.select("change_id", "path", "sign", F.explode(F.array_union(distinctive_names(F.col("line")), literal_texts(F.col("line")))).alias("token"))
    per = tokens.groupBy("change_id", "path", "token").agg(F.max((F.col("sign") == "+").cast("int")).alias("a"), F.max((F.col("sign") == "-").cast("int")).alias("r"))
    return per.where("a + r = 1").select("change_id", "path", "token", F.when(F.col("a") == 1, "adds").otherwise("removes").alias("verb"))


def description_claims(descriptions: DataFrame) -> DataFrame:
    """(change_id, claim_no, claim) of descriptions(change_id, text): sentences of four words or more, cleaned, each once.

    Headings, fences, trailers, check boxes and tables are no claims; a list item stands alone.
    """
    text = T.normal_newlines(F.col("text"))
    text = F.regexp_replace(text, F.lit(r"(?ms)^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\z)"), F.lit(""))
    lines = F.filter(T.lines(text), lambda x: ~F.trim(x).rlike(r"^(?:[A-Z][\w-]+-[Bb]y:|Co-authored-by:|Fixes:? #|Closes:? #|#|\||[-*] \[[ xX]\])"))
    body = F.array_join(F.transform(lines, lambda x: F.regexp_replace(F.rtrim(x), F.lit(r"^\s*(?:[-*+]|\d+[.)])\s+"), F.lit("\n\n"))), "\n")
    paras = F.transform(F.split(body, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, F.lit(r"\s+"), F.lit(" "))))
    said = F.flatten(F.transform(paras, T.sentences))
    said = F.transform(said, lambda s: R.scrub(F.trim(F.regexp_replace(s, F.lit(r"^[ \-*>]+|[ \-*>]+$"), F.lit("")))))
    claims = F.array_distinct(F.filter(said, lambda s: T.word_count(s) >= LEAST_WORDS))
    return descriptions.select("change_id", F.posexplode(claims).alias("_i", "claim")).select("change_id", (F.col("_i") + 1).alias("claim_no"), "claim")


def pair_claims(claim_rows: DataFrame, section_rows: DataFrame) -> DataFrame:
    """(change_id, claim_no, claim, path): the files of its own change that a claim names by path, name, stem or changed identifier."""
    stem = F.lower(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1))
    changed = F.array_join(F.filter(T.lines(F.col("section")), lambda x: x.rlike(r"^[+-](?!\+\+|--)")), "\n")
    files = section_rows.select("change_id", "path", stem.alias("_stem"), changed.alias("_changed"))
    low = F.lower("claim")
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    idents = F.array_union(F.regexp_extract_all("claim", F.lit(r"`([^`\s]+)`"), 1), distinctive_names(F.col("claim")))
    hit = F.contains(low, F.lower("path")) | F.contains(low, name) | (F.length("_stem") >= 4) & F.expr(r"lower(claim) rlike concat('\\b', regexp_replace(_stem, '([^a-z0-9_])', '\\\\$1'), '\\b')")
    met = claim_rows.join(files, "change_id").withColumn("_idents", idents)
    return met.where(hit | F.exists("_idents", lambda t: F.contains(F.col("_changed"), t))).select("change_id", "claim_no", "claim", "path")


def unmentioned_files(section_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Files of a change that no claim pairs with."""
    return section_rows.select("change_id", "path").join(pairs.select("change_id", "path"), ["change_id", "path"], "left_anti")


def files_not_in_change(claim_rows: DataFrame, section_rows: DataFrame) -> DataFrame:
    """(change_id, claim_no, file): files that a claim names and the change doesn't touch."""
    named = F.regexp_extract_all("claim", F.lit(r"(?<![\w/.-])((?:[\w.-]+/)*[\w-]+\.(?:py|js|ts|tsx|go|rs|java|kt|rb|php|cs|c|cc|cpp|h|swift|sh|sql|ya?ml|toml|json|md))(?!\w)"), 1)
    rows = claim_rows.select("change_id", "claim_no", F.explode(F.array_distinct(named)).alias("file")).withColumn("_n", F.element_at(F.split("file", "/"), -1))
    files = section_rows.select("change_id", "path", F.element_at(F.split("path", "/"), -1).alias("_n"))
    hits = rows.join(files, ["change_id", "_n"]).where((F.col("path") == F.col("file")) | F.col("path").endswith(F.concat(F.lit("/"), "file"))).select("change_id", "claim_no", "file")
    return rows.drop("_n").join(hits, ["change_id", "claim_no", "file"], "left_anti")


def within_budget(section_rows: DataFrame, named: DataFrame, most: int = 5000) -> DataFrame:
    """What fits `most` characters of a change, files that errors name first: (change_id, file_no, path, section, named).

    Files are taken hunk by hunk; the first that is kept of a file brings the file's header along. A hunk
    that doesn't fit what room is left is passed over, and later ones that fit are kept. Where none fits at
    all, the first keeps those of its lines, from its header on, that fit. A file without hunks is one piece.
    """
    marks = named.select("change_id", "path", F.lit(True).alias("_named")).distinct()
    rows = section_rows.join(marks, ["change_id", "path"], "left").withColumn("named", F.coalesce("_named", F.lit(False))).drop("_named")
    cut = F.split("section", r"(?m)^(?=@@ )")
    head = F.when(F.size(cut) < 2, F.lit("")).otherwise(cut[0])
    hunks = F.when(F.size(cut) < 2, cut).otherwise(F.slice(cut, F.lit(2), F.greatest(F.lit(0), F.size(cut) - 1)))
    pieces = rows.select("change_id", "file_no", "path", "named", head.alias("_head"), F.posexplode(hunks).alias("_no", "_piece"))
    sizes = pieces.groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct((~F.col("named")).alias("later"), "file_no", "_no", F.length("_head").alias("head"), F.length("_piece").alias("size")))).alias("_all"))
    none = F.struct(F.lit(most).alias("room"), F.lit(-1).cast("long").alias("begun"), F.array().cast("array<struct<file_no:long,no:int>>").alias("kept"))

    def take(acc: Column, x: Column) -> Column:
        need = x["size"] + F.when(acc["begun"] == x["file_no"], 0).otherwise(x["head"])
        one = F.struct(x["file_no"].cast("long").alias("file_no"), x["_no"].alias("no"))
        more = F.struct((acc["room"] - need).alias("room"), x["file_no"].cast("long").alias("begun"), F.concat(acc["kept"], F.array(one)).alias("kept"))
        return F.when(need <= acc["room"], more).otherwise(acc)

    # a running sum can't pass over what doesn't fit, so each change is folded in order; only sizes are in the array
    taken = sizes.select("change_id", F.aggregate("_all", none, take)["kept"].alias("_kept"), F.get("_all", F.lit(0)).alias("_first"))
    whole = F.array(F.struct(F.col("_first.file_no").cast("long").alias("file_no"), F.col("_first._no").alias("no")))
    chosen = taken.select("change_id", (F.size("_kept") == 0).alias("_part"), F.explode(F.when(F.size("_kept") == 0, whole).otherwise(F.col("_kept"))).alias("k"))
    kept = pieces.join(chosen.select("change_id", F.col("k.file_no").alias("file_no"), F.col("k.no").alias("_no"), "_part"), ["change_id", "file_no", "_no"])
    text = F.concat(F.first("_head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_piece"))), lambda x: x["_piece"]), ""))
    out = kept.groupBy("change_id", "file_no", "path", "named").agg(text.alias("section"), F.max("_part").alias("_part"))
    lines = F.regexp_extract(F.substring("section", 1, most), r"(?s)\A(.*\n)", 1)
    return out.withColumn("section", F.when(F.col("_part"), lines).otherwise(F.col("section"))).drop("_part")


def named_by_change(error_rows: DataFrame, tokens: DataFrame, most: int = 3) -> DataFrame:
    """(change_id, line_no, token, verb, path): for each error line the longest token in it that the change adds or removes; at most three a change."""
    words = F.array_union(distinctive_names(F.col("line")), literal_texts(F.col("line")))
    met = error_rows.select("change_id", "line_no", F.explode(words).alias("token")).join(tokens, ["change_id", "token"])
    longest = Window.partitionBy("change_id", "line_no").orderBy(F.length("token").desc(), "token", "path")
    met = met.withColumn("_r", F.row_number().over(longest)).where("_r = 1").drop("_r")
    first = Window.partitionBy("change_id").orderBy("line_no")
    return met.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most).drop("_r")
