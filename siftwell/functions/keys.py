"""Keys that make things comparable: masks, signatures, config keys, routes, paths and globs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sub(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(to))


def masked(text: Column) -> Column:
    """Lower case with system names, hexadecimal, numbers, slashes and spaces made alike."""
    # fixed values: the patterns that are masked
    out = _sub(F.lower(text), r"\b(?:ubuntu|macos|windows)(?:-latest|-\d+[.\d]*)?\b", "<os>")
    out = _sub(_sub(out, r"0x[0-9a-f]+|\b[0-9a-f]{7,}\b", "#"), r"\d+", "#")
    return _sub(_sub(out, r"\\", "/"), r"\s+", " ")


def signature(kind: Column, first_line: Column) -> Column:
    return F.concat(kind, F.lit("|"), F.substring(masked(first_line), 1, 160))


def step_key(name: Column) -> Column:
    """A step's name with versions and system names alike, so that the jobs of a matrix meet."""
    out = masked(_sub(name, r"(?i)\blinux\b", "<os>"))
    out = _sub(out, r"#(?:\.#)+(?:t(?!\w))?", "#")
    return _sub(out, r"#(?:[.-]?#)*(?:[.-]?(?:dev|alpha|beta|rc|pre|preview|ea|nightly|canary)|[ab](?=#))(?:[.-]?#)*t?(?!\w)", "#")


def config_key(name: Column) -> Column:
    """Relaxed binding: max-items, maxItems and max_items are one key; upper-case names stay."""
    name = F.trim(name)
    return F.when(name.rlike("^[A-Z][A-Z0-9_]*$"), name).otherwise(F.lower(_sub(name, "[-_]", "")))


def route_key(path: Column) -> Column:
    """A path with its parameters as {} and single slashes."""
    out = _sub(F.trim(path), r"\$\{[^}]*\}|\{[^{}]*\}|:[A-Za-z_]\w*\??|<[^<>]*>|\[\.{0,3}[^\]]*\]|\(\?P<\w+>[^)]*\)", "{}")
    out = _sub(_sub(out, r"[\^$]", ""), "/+", "/")
    return F.concat(F.lit("/"), _sub(out, "^/|/$", ""))


def path_key(path: Column) -> Column:
    """Forward slashes and no leading ./"""
    return _sub(_sub(path, r"\\+", "/"), r"^(\./)+", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def glob_pattern(glob: Column) -> Column:
    """A glob as an anchored expression; * crosses slashes, and **/ may stand for nothing."""
    out = _sub(glob, r"([.+^$(){}|\\])", r"\\$1")
    out = _sub(out, r"\[!", "[^")
    out = _sub(_sub(out, r"\*\*/", "\u0001"), r"\*+", ".*")
    out = _sub(_sub(out, r"\?", "."), "\u0001", "(?:.*/)?")
    return F.concat(F.lit("^"), out, F.lit("$"))


def name_parts(name: Column) -> Column:
    """The words of a camel, snake or path name, longer than two letters, lower case."""
    spaced = _sub(_sub(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.array_distinct(F.filter(F.transform(F.split(spaced, " "), lambda w: F.lower(w)), lambda w: F.length(w) > 2))


def request_key(*parts: Column) -> Column:
    """A hash of a request, whose field order is fixed."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)
