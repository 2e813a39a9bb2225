"""Sentences, paragraphs and word counts as column expressions; a document's lines never leave its row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a Latin sentence ends, what begins a block, and the ranges of dense scripts.
SENTENCE_END = r"(?<=[.!?:])\s+(?=[A-Z`#\-*\d])|\n(?=[-*|#])"
BLOCK_START = r"^\s*(#|[-*+]\s|\d+[.)]\s|[a-z][.)]\s|\||>|```|---+\s*$)"
HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}"
HIRAGANA = r"\x{3041}-\x{3096}\x{309d}-\x{309f}"
KATAKANA = r"\x{30a1}-\x{30fa}\x{30fc}-\x{30ff}\x{31f0}-\x{31ff}\x{ff66}-\x{ff9f}"
HANGUL = r"\x{ac00}-\x{d7a3}\x{1100}-\x{11ff}\x{3130}-\x{318f}"
#: Characters to a word in dense scripts.
HAN_PER_WORD, HIRAGANA_PER_WORD, KATAKANA_PER_WORD = 1.5, 2.5, 4.0
STATEMENT = r"(?i)\b(is|are|was|were|do|does|can|will|never|always|must|should|leaves?|goes|happens|stores?|sends?|sent|kept|stored|checked)\b"


def lit(pattern: str) -> Column:
    return F.lit(pattern)


def normal_newlines(text: Column) -> Column:
    """CR LF and CR as LF, without a byte-order mark."""
    return F.regexp_replace(F.regexp_replace(text, lit("^\ufeff"), lit("")), lit("\r\n?"), lit("\n"))


def lines(text: Column) -> Column:
    """Array of lines; null for null."""
    return F.split(text, "\n", -1)


def sentences(text: Column) -> Column:
    """Array of sentences of Latin text, empty ones left out."""
    return F.filter(F.split(text, SENTENCE_END, -1), lambda s: F.length(s) > 0)


def has_cjk(text: Column) -> Column:
    return text.rlike(f"[{HAN}{HIRAGANA}{KATAKANA}{HANGUL}]")


def _matches(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, lit(f"[{chars}]"), lit("")))


def word_count(text: Column) -> Column:
    """Words as a double: spaced ones, and characters of dense scripts by so many to a word."""
    spaced = F.size(F.filter(F.split(text, r"\s+", -1), lambda w: F.length(w) > 0)).cast("double")
    gaps = F.regexp_replace(text, lit(f"[{HAN}{HIRAGANA}{KATAKANA}\\x{{3000}}-\\x{{303f}}\\x{{ff01}}-\\x{{ff65}}]"), lit(" "))
    dense = _matches(text, HAN) / HAN_PER_WORD + _matches(text, HIRAGANA) / HIRAGANA_PER_WORD + _matches(text, KATAKANA) / KATAKANA_PER_WORD
    rest = F.size(F.filter(F.split(gaps, r"\s+", -1), lambda w: F.length(w) > 0)).cast("double")
    return F.when(has_cjk(text), rest + dense).otherwise(spaced)


def long_enough(text: Column, least: float = 5) -> Column:
    """Whether a sentence has the words of a requirement; three do for one in a CJK script that ends with a stop."""
    short = has_cjk(text) & text.rlike("[。．｡.][」』）)】\"'*_`]*$")
    return word_count(text) >= F.when(short, F.least(F.lit(3.0), F.lit(float(least)))).otherwise(F.lit(float(least)))


def is_statement(heading: Column) -> Column:
    """A heading that says something, rather than one that names a part."""
    return heading.rlike(STATEMENT)


def normalised(text: Column) -> Column:
    """For comparing: lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), lit(r"[^\p{L}\p{N}_]+"), lit(" ")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it (lambdas compute what stands in them for each element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Array of struct(line, text): wrapped lines joined to the line they continue, fences as they are.

    line counts from 1 and is where the paragraph starts. Row-local: no line is shuffled.
    """

    def begins(all_lines: Column, fences: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            above = F.trim(F.coalesce(F.get(all_lines, i - 1), F.lit("")))
            joins = (above != "") & ~above.rlike(r"^(```|\||#)") & ~above.rlike("^-{3,}$") & (F.trim(line) != "") & ~line.rlike(BLOCK_START)
            inside = (F.size(fences) > 0) & (F.size(F.filter(fences, lambda f: f < i)) % 2 == 1)
            return F.when((i == 0) | ~joins | inside, i)

        return F.filter(F.transform(all_lines, one), lambda x: x.isNotNull())

    def joined(all_lines: Column, begin: Column) -> Column:
        def one(a: Column, j: Column) -> Column:
            z = F.coalesce(F.get(begin, j + 1), F.size(all_lines))
            rest = F.transform(F.slice(all_lines, a + 2, z - a - 1), lambda x: F.trim(x))
            head = F.get(all_lines, a)
            return F.struct((a + 1).alias("line"), F.when(z - a > 1, F.concat_ws(" ", F.rtrim(head), F.array_join(rest, " "))).otherwise(head).alias("text"))

        return F.transform(begin, one)

    def of(all_lines: Column) -> Column:
        fences = F.filter(F.transform(all_lines, lambda x, i: F.when(F.trim(x).startswith("```"), i)), lambda x: x.isNotNull())
        return let(fences, lambda f: let(begins(all_lines, f), lambda b: joined(all_lines, b)))

    return let(lines(text), of)


def table_cells(row: Column) -> Column:
    """A table row as a sentence: its cells joined by ' - '."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(row), lit(r"^\|+|\|+$"), lit("")), r"\|", -1), lambda c: F.trim(c))
    return F.array_join(F.filter(cells, lambda c: F.length(c) > 0), " - ")


def tidy(source: Column) -> Column:
    """Runs of blank lines as one blank line."""
    return F.regexp_replace(source, lit("\n{3,}"), lit("\n\n"))


def unmarked(text: Column) -> Column:
    """Text without the marks of bold; names such as __init__, masks, globs and code spans keep theirs."""
    spans = F.regexp_extract_all(text, lit("(`[^`\n]+`)"), 1)
    held = F.regexp_replace(text, lit("`[^`\n]+`"), lit("\u0002"))
    out = F.regexp_replace(held, lit(r"(?<![\w*/])\*\*(?=[^\s*/])((?:(?!\*\*)[^\n])+?)(?<=[^\s*/])\*\*(?![\w*/])"), lit("$1"))
    out = F.regexp_replace(out, lit(r"(?<![\w_])__(?=[^\s_])(?!\w+__(?!\w))((?:(?!__)[^\n])+?)(?<=[^\s_])__(?![\w_])"), lit("$1"))
    parts = F.split(out, "\u0002", -1)
    return F.array_join(F.flatten(F.transform(parts, lambda p, i: F.array(p, F.coalesce(F.get(spans, i), lit(""))))), "")
