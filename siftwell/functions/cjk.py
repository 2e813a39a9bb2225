"""Sentences of texts in Chinese, Japanese and Korean: full stops outside brackets, quotes and code."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Ranges of the scripts, their stops and brackets.
_DENSE = "\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_HANGUL = "\uac00-\ud7a3\u1100-\u11ff\u3130-\u318f"
_ANY = re.compile(f"[{_DENSE}{_HANGUL}]")
_STOPS, _OPEN, _CLOSE = "。！？．｡", "「『（(【〔［[｛{〈《“‘", "」』）)】〕］]｝}〉》”’"
_LATIN = re.compile(rf"(?<=[.!?])\s+(?=[A-Z`#\-*\d{_DENSE}{_HANGUL}])|\n(?=[-*|#])")
_PLAIN = re.compile(r"(?<=[.!?:])\s+(?=[A-Z`#\-*\d])|\n(?=[-*|#])")
_CODE = re.compile(r"(`+)[^\n]+?\1")
_DECIMAL = re.compile("[0-9A-Za-z０-９Ａ-Ｚａ-ｚ]．[0-9A-Za-z０-９Ａ-Ｚａ-ｚ]")
_ABBREVIATION = re.compile(r"(?<![A-Za-z])(?:vs|e\.g|i\.e|cf|viz|approx|fig|eq|ref)\.$", re.I)


def split_sentences(text: str) -> list[str]:
    """Sentences in order, empty ones left out; texts without such letters are split as Latin ones."""
    if not _ANY.search(text):
        return [s for s in _PLAIN.split(text) if s]
    shut = bytearray(len(text))  # positions inside code, or brackets that close again
    for m in _CODE.finditer(text):
        shut[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    stack: list[int] = []
    for i, ch in enumerate(text):
        if shut[i]:
            continue
        if ch in _OPEN:
            stack.append(i)
        elif ch in _CLOSE and stack and text[stack[-1]] == _OPEN[_CLOSE.index(ch)]:
            a = stack.pop()
            if not stack:
                shut[a : i + 1] = b"\1" * (i + 1 - a)
    cuts = set()
    for i, ch in enumerate(text):
        if ch in _STOPS and not shut[i] and text[i + 1 : i + 2] not in tuple(_STOPS) and not (i and _DECIMAL.match(text, i - 1)) and not (ch in "！？" and text[i + 1 : i + 2] in ("と", "っ")):
            k = i + 1
            while k < len(text) and text[k] in _CLOSE:
                k += 1
            cuts.add(k)
    for m in _LATIN.finditer(text):
        stop = m.start() - 1
        if stop >= 0 and not shut[stop] and not _ABBREVIATION.search(text[max(0, stop - 10) : stop + 1]):
            cuts.add(m.end())
    at, out = 0, []
    for c in [*sorted(cuts), len(text)]:
        if text[at:c].strip():
            out.append(text[at:c])
        at = c
    return out


@F.pandas_udf(ArrayType(StringType()))
def _split(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else split_sentences(t))


def sentences(text: Column) -> Column:
    """Array of sentences of a text in any script; null for null."""
    return _split(text)
