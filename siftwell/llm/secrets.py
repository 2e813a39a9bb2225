"""Secret scans: known shapes by pattern, further ones by inferred grammars.

`scan` finds the base spans of three kinds and the candidates: runs of CANDIDATE_LENGTH or more
credential characters that aren't within a base span. `fit` learns one probabilistic automaton
a kind from the labelled credentials (the base spans), and two from the candidates that touch no base
span, one with and one without digits: the strings
make a prefix tree whose states merge where a Hoeffding bound can't tell their next symbols and ends
apart (`Automaton.infer`). `add_formats` scores every candidate under all automata; it is a span of
kind "format" where the likeliest credential format beats the other tokens by MARGIN nats and is about as likely a
symbol as the labelled credentials are. Base spans stay as they are; a format span may overlap them.

The automata are fitted on at most `most_each` distinct strings a kind of at most SAMPLE_LENGTH characters,
by a hash, and on however few there are; scanning and scoring take every whole text. Where there are no other
tokens at all, their symbols count as alike (log 1/64, about -4.2).

Cases: null and empty texts have no spans; repeated rows get equal spans; without labelled
credentials nothing is added to the base; further columns stay, but for columns named like those
added, which are replaced. Positions count code points, ends are exclusive. Empty tables give empty
results.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

KINDS = ("assign", "access", "hex", "format")
#: Fixed patterns of the three base kinds; the group or match must have the given length.
ASSIGN = re.compile(
    r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE_LENGTH, SAMPLE_LENGTH, MARGIN = 12, 128, 8.0
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE_LENGTH)
_DIGIT = re.compile(r"[0-9]")

SPAN = "array<struct<kind:string,start:int,end:int,secret:string>>"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret) by start, then kind as listed."""
    out = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(k in low for k in _KEYWORDS):
            out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]))) if len(out) > 1 else out


def candidates(text: str, taken: list[tuple[str, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, token) of every run that may be a credential and isn't within a base span; taken is in order of starts."""
    out = [(m.start(), m.end(), m[0]) for m in _RUN.finditer(text)]
    if not taken or not out:
        return out
    starts, reach = [s for _, s, _, _ in taken], [0, *accumulate((e for _, _, e, _ in taken), max)]
    return [c for c in out if reach[bisect_right(starts, c[0])] < c[1]]


# ---------------------------------------------------------------- grammars


@dataclass
class Automaton:
    """A deterministic probabilistic automaton over characters."""

    count: list[int] = field(default_factory=lambda: [0])
    end: list[int] = field(default_factory=lambda: [0])
    next: list[dict[str, int]] = field(default_factory=lambda: [{}])
    freq: list[dict[str, int]] = field(default_factory=lambda: [{}])

    @classmethod
    def infer(cls, strings: list[str], alpha: float = 0.05) -> Automaton:
        """The prefix tree of the strings, with statistically compatible states merged."""
        a = cls()
        for s in strings:
            a._insert(s)
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red, order = {0}, [0]
        while True:
            edge = next(((p, c) for p in order for c in sorted(a.next[p]) if a.next[p][c] not in red), None)
            if edge is None:
                return a._compact(order)
            p, c = edge
            blue = a.next[p][c]
            for r in order:
                if a._compatible(r, blue, bound):
                    a.next[p][c] = r
                    a._fold(r, blue)
                    break
            else:
                red.add(blue)
                order.append(blue)

    def _insert(self, s: str) -> None:
        at = 0
        for ch in s:
            self.count[at] += 1
            self.freq[at][ch] = self.freq[at].get(ch, 0) + 1
            if ch not in self.next[at]:
                self.next[at][ch] = len(self.count)
                for x, new in ((self.count, 0), (self.end, 0), (self.next, {}), (self.freq, {})):
                    x.append(new)
            at = self.next[at][ch]
        self.count[at] += 1
        self.end[at] += 1

    def _compatible(self, r: int, b: int, bound: float) -> bool:
        stack = [(r, b)]
        while stack:
            r, b = stack.pop()
            n, m = self.count[r], self.count[b]
            slack = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.end[r] / n - self.end[b] / m) > slack:
                return False
            for ch in self.freq[r].keys() | self.freq[b].keys():
                if abs(self.freq[r].get(ch, 0) / n - self.freq[b].get(ch, 0) / m) > slack:
                    return False
                if ch in self.next[r] and ch in self.next[b]:
                    stack.append((self.next[r][ch], self.next[b][ch]))
        return True

    def _fold(self, r: int, b: int) -> None:
        stack = [(r, b)]
        while stack:
            r, b = stack.pop()
            self.count[r] += self.count[b]
            self.end[r] += self.end[b]
            for ch, n in self.freq[b].items():
                self.freq[r][ch] = self.freq[r].get(ch, 0) + n
            for ch, below in self.next[b].items():
                if ch in self.next[r]:
                    stack.append((self.next[r][ch], below))
                else:
                    self.next[r][ch] = below

    def _compact(self, states: list[int]) -> Automaton:
        number = {s: i for i, s in enumerate(states)}
        return Automaton(
            [self.count[s] for s in states], [self.end[s] for s in states],
            [{c: number[t] for c, t in self.next[s].items()} for s in states], [self.freq[s] for s in states],
        )

    def scorer(self, smooth: float = 0.5, unseen: float = -9.0):
        """A function from a string to its log-likelihood; a symbol without a transition costs `unseen` and starts anew."""
        step = [{c: (math.log((n + smooth / 64) / (k + smooth)), t[c]) for c, n in f.items()} for k, f, t in zip(self.count, self.freq, self.next)]
        ends = [math.log((e + smooth / 64) / (k + smooth)) for k, e in zip(self.count, self.end)]
        lost = (unseen, 0)

        def score(s: str) -> float:
            at, total = 0, 0.0
            for ch in s:
                p, at = step[at].get(ch, lost)
                total += p
            return total + ends[at]

        return score


@dataclass
class Formats:
    """Automata of the credential kinds with the least likelihood a symbol of each, and of other tokens with and without digits."""

    kinds: dict[str, tuple[Automaton, float]]
    other: Automaton | None
    words: Automaton | None = None

    def scorers(self):
        """A function from a token to (likeliest kind, margin over other tokens, whether it is a credential's format)."""
        own = [(k, a.scorer(), floor) for k, (a, floor) in sorted(self.kinds.items())]
        others = [a.scorer() for a in (self.other, self.words) if a] or [lambda s: -4.2 * (len(s) + 1)]

        def judge(token: str) -> tuple[str, float, bool]:
            ll, kind, floor = max((f(token), k, floor) for k, f, floor in own)
            margin = ll - max(f(token) for f in others)
            return kind, margin, margin >= MARGIN and ll / (len(token) + 1) >= floor

        return judge


def learn(labelled: dict[str, list[str]], others: list[str]) -> Formats | None:
    """Formats from credentials by kind and from other tokens, of any number; None without credentials."""
    kinds = {}
    for kind, strings in labelled.items():
        if strings:
            a = Automaton.infer(sorted(strings))
            f = a.scorer()
            each = sorted(f(s) / (len(s) + 1) for s in strings)
            kinds[kind] = (a, each[len(each) // 100] - 0.3)
    background = [[t for t in others if bool(_DIGIT.search(t)) == digit] for digit in (True, False)]
    return Formats(kinds, *(Automaton.infer(sorted(b)) if b else None for b in background)) if kinds else None


# ---------------------------------------------------------------- tables


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the columns base_spans and candidates; text_col stays."""
    fields = [f for f in df.schema.fields if f.name not in ("base_spans", "candidates")]
    at = [f.name for f in fields].index(text_col)
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("secret", pa.string())]))
    tokens = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = [], []
            for x in batch.column(at):
                text = x.as_py() or ""
                found = base_spans(text)
                base.append([dict(zip(("kind", "start", "end", "secret"), s)) for s in found])
                more.append([dict(zip(("start", "end", "token"), c)) for c in candidates(text, found)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base, kinds), pa.array(more, tokens)], [*batch.schema.names, "base_spans", "candidates"])

    added = _parse_datatype_string(f"base_spans {SPAN}, candidates array<struct<start:int,end:int,token:string>>")
    return df.select(*[f"`{f.name}`" for f in fields]).mapInArrow(run, StructType([*[StructField(f.name, f.dataType, True) for f in fields], *added.fields]))


def fit(scanned: DataFrame, most_each: int = 1000) -> Formats | None:
    """Formats from at most most_each distinct labelled credentials a kind, and as many other candidates with and without digits."""
    labelled = scanned.select(F.explode("base_spans").alias("s")).select(F.col("s.kind").alias("kind"), F.col("s.secret").alias("token"))
    free = F.filter("candidates", lambda c: ~F.exists("base_spans", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    others = scanned.select(F.explode(free).alias("s")).select(F.when(F.col("s.token").rlike(_DIGIT.pattern), "other").otherwise("word").alias("kind"), F.col("s.token").alias("token"))
    strings = labelled.unionByName(others).where(F.length("token") <= SAMPLE_LENGTH).distinct()
    got = {k: [r["token"] for r in strings.where(F.col("kind") == k).orderBy(F.xxhash64("token"), "token").limit(most_each).collect()] for k in ("assign", "access", "hex", "other", "word")}
    return learn({k: got[k] for k in KINDS[:3]}, got["other"] + got["word"])


def add_formats(scanned: DataFrame, formats: Formats | None) -> DataFrame:
    """scanned with the column spans: the base spans and the candidates whose format is a credential's, by start and kind."""
    fields = [f for f in scanned.schema.fields if f.name != "spans"]
    kept = scanned.select(*[f"`{f.name}`" for f in fields])
    if formats is None:
        return kept.withColumn("spans", F.col("base_spans"))
    judged_type = "array<struct<start:int,end:int,token:string>>"

    @F.pandas_udf(judged_type)
    def judged(column):
        judge = formats.scorers()
        return column.map(lambda cs: [dict(c) for c in cs if judge(c["token"])[2]] if len(cs) else [])

    more = F.transform(judged(F.col("candidates")), lambda c: F.struct(F.lit("format").alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["token"].alias("secret")))
    place = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("n"), s.alias("s"))
    both = F.transform(F.array_sort(F.transform(F.concat("base_spans", more), place)), lambda x: x["s"])
    return kept.withColumn("spans", both)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the first stands for all."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(df: DataFrame, formats: Formats | None, text_col: str = "text") -> DataFrame:
    """df with every secret of text_col replaced by its kind in angle brackets. Null texts stay null."""

    @F.pandas_udf("string")
    def masked(texts):
        judge = formats.scorers() if formats else None

        def one(text):
            if text is None:
                return None
            found = base_spans(text)
            spans = [s[:3] for s in found]
            if judge:
                spans += [("format", a, z) for a, z, token in candidates(text, found) if judge(token)[2]]
            return mask(text, spans) if spans else text

        return texts.map(one)

    return df.withColumn(text_col, masked(F.col(text_col)))
