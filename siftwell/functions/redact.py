"""Redaction as nested regular expressions: secret shapes in any text, and broader rules for logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import let

MASK = "<redacted>"
#: Shapes of credentials, by who issues them.
SHAPES = {
    "stripe": r"\b(?:sk|rk|pk)_(?:live|test)_[0-9A-Za-z]{8,}",
    "github": r"\b(?:ghp|gho|ghu|ghs|github_pat)_[0-9A-Za-z_]{20,}",
    "slack": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "google": r"\bAIza[0-9A-Za-z_\-]{30,}",
    "model_api": r"\bsk-(?:ant-|proj-)?[0-9A-Za-z_\-]{20,}",
    "jwt": r"eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}",
    "aws": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "gitlab": r"\bgl(?:pat|dt|rt|ptt|cbt|imt|soat|ft|oas)-[0-9A-Za-z_\-]{20,}",
    "npm": r"\bnpm_[0-9A-Za-z]{36}\b",
    "pypi": r"\bpypi-[0-9A-Za-z_\-]{50,}",
    "slack_hook": r"https://hooks\.slack\.com/services/[0-9A-Za-z/]{20,}",
    "vault": r"\bhv[sb]\.[0-9A-Za-z_\-]{24,}",
}
URL_LOGIN = r"://[^/\s:@]+:[^/\s@]+@"
PEM = r"(?s)-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY(?: BLOCK)?-----.*?-----END (?:[A-Z0-9 ]+ )?PRIVATE KEY(?: BLOCK)?-----"
KEY_BEGIN = r"-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY(?: BLOCK)?-----"
KEY_END = r"-----END (?:[A-Z0-9 ]+ )?PRIVATE KEY(?: BLOCK)?-----"
#: What may stand before a line's own text: a job, a step and a time in logs, then the mark of a diff.
LINE_LEAD = r"(?:[^\t\n]{0,200}\t[^\t\n]{0,200}\t)?(?:\d{4}-\d\d-\d\dT[\d:.]+Z ?)?[ +\-]?"
#: Where a key without an end stops: before a line that isn't of its characters, a header of it, or blank.
KEY_STOP = rf"\n(?!{LINE_LEAD}[ \t#*/\"'>|]*(?:[A-Za-z0-9+/=]{{16,}}(?:\\[nr])*[\"',;+\\ \t]*(?:\n|\z)|[A-Za-z0-9+/=]{{0,15}}\z|(?<=[A-Za-z0-9+/=]{{16}}\n)[A-Za-z0-9+/=]{{1,15}}[ \t]*\n|(?:Proc-Type|DEK-Info|Version|Comment|Hash): [^\n]*(?:\n|\z)|[ \t]*\n))"
EMAIL = r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"
HOME = r"(/home/|/Users/|[A-Za-z]:\\+[Uu]sers\\+)[^/\\\s]+"
SECRET_NAME = r"(?:pass(?:word|wd|phrase)|secret|token|api[-_.]?key|private[-_.]?key|credential|access[-_.]?key)"
#: A quoted value of a secret-named variable, four characters or more, that isn't a placeholder.
NAMED_VALUE = rf"(?i)((?<![\w.\-])[\w.\-]*{SECRET_NAME}[\w.\-]*[\"']?\s*(?::=|:|=>|=)\s*)([\"'])(?!\$\{{)[^\"'\n]{{4,}}\2"
PLACEHOLDER_DEFAULT = rf"(?i)((?<![\w.\-])[\w.\-]*{SECRET_NAME}[\w.\-]*[\"']?\s*(?::=|:|=>|=)\s*[\"']?\$\{{[^}}:]+:-?)[^}}]+(\}})"
LOG_RULES = (
    r"(?i)\b(bearer |basic |token )[A-Za-z0-9._~+/=\-]{12,}",
    r"(?i)(_authToken\s*=\s*)\S+",
    r"(?i)\b([\w.\-]*(?:password|passwd|secret|token|api[-_]?key|access[-_]?key|private[-_]?key|client[-_]?secret|credentials?)[\w.\-]*\s*[:=]\s*)(?!\*\*\*|<redacted>|\$\{)[^\s'\"`,;]{4,}",
)
ANSI = r"\x1b\[[0-9;?]*[A-Za-z]"
TIMESTAMP = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?Z ?"
INVISIBLE = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2069}\x{feff}]"


#: What a text must hold for a pattern to match at all; a plain search is far cheaper than the pattern.
MARKS = {
    "stripe": ("_live_", "_test_"), "github": ("ghp_", "gho_", "ghu_", "ghs_", "github_pat_"), "slack": ("xox",), "google": ("AIza",), "model_api": ("sk-",), "jwt": ("eyJ",), "aws": ("AKIA", "ASIA"),
    "gitlab": ("glpat-", "gldt-", "glrt-", "glptt-", "glcbt-", "glimt-", "glsoat-", "glft-", "gloas-"), "npm": ("npm_",), "pypi": ("pypi-",), "slack_hook": ("hooks.slack.com",), "vault": ("hvs.", "hvb."),
}


def _sub(text: Column, pattern: str, to: str, *marks: str) -> Column:
    """text with the pattern replaced; with marks, searched only where the text holds one of them."""
    if not marks:
        return F.regexp_replace(text, F.lit(pattern), F.lit(to))

    def where_marked(t: Column) -> Column:
        some = F.contains(t, F.lit(marks[0]))
        for m in marks[1:]:
            some = some | F.contains(t, F.lit(m))
        return F.when(some, F.regexp_replace(t, F.lit(pattern), F.lit(to))).otherwise(t)

    return let(text, where_marked)


def shapes(text: Column) -> Column:
    """text without credentials of known shapes."""
    for name, pattern in SHAPES.items():
        text = _sub(text, pattern, MASK, *MARKS[name])
    return _sub(text, URL_LOGIN, f"://{MASK}@", "://")


def _split_keys(text: Column) -> Column:
    """Array of struct(key, rest): the text cut before each key's beginning, and after its end; a key without one goes on as long as its lines look like it."""

    def one(seg: Column) -> Column:
        end = F.regexp_instr(seg, F.lit(KEY_END))
        closed = end + F.length(F.regexp_extract(seg, KEY_END, 0)) - 1
        stop = F.regexp_instr(seg, F.lit(KEY_STOP))
        size = F.when(~seg.startswith("-----BEGIN "), 0).when(end > 0, closed).when(stop > 0, stop - 1).otherwise(F.length(seg))
        # a lambda that reads another's variable can't stand under a Python function, so both values go in
        return let(F.struct(seg.alias("t"), size.alias("n")), lambda x: F.struct(F.substring(x["t"], F.lit(1), x["n"]).alias("key"), F.substring(x["t"], x["n"] + 1, F.length(x["t"])).alias("rest")))

    return F.transform(F.split(text, f"(?={KEY_BEGIN})", -1), one)


def private_keys(text: Column) -> Column:
    """Array of the private keys in a text, with or without an end."""
    return F.filter(_split_keys(text)["key"], lambda k: k != "")


def hide_keys(text: Column) -> Column:
    """text with private keys hidden line by line: their number of lines, the marks of a diff and the times of a log stay.

    Row-local and in one direction: the text is cut at each key's beginning, so no expression backtracks over lines.
    """
    masked = lambda k: F.regexp_replace(F.regexp_replace(k, F.lit(r"^[^\n]+"), F.lit(MASK)), F.lit(rf"\n({LINE_LEAD})[^\n]+"), F.lit(f"\n$1{MASK}"))
    hidden = lambda t: F.array_join(F.transform(_split_keys(t), lambda x: F.concat(masked(x["key"]), x["rest"])), "")
    return let(text, lambda t: F.when(F.contains(t, F.lit("PRIVATE KEY")), hidden(t)).otherwise(t))


def redact_lines(text: Column) -> Column:
    """A file, log or diff as redact() leaves it, with as many lines as before. For whole texts, before anything is cut from them."""
    return redact(hide_keys(text))


def redact(text: Column) -> Column:
    """text without private keys, values of secret names (placeholders stay, their defaults go) and credential shapes. A key without an end is hidden line by line."""
    out = hide_keys(_sub(text, PEM, MASK, "PRIVATE KEY"))
    out = _sub(_sub(out, PLACEHOLDER_DEFAULT, f"$1{MASK}$2", "${"), NAMED_VALUE, f"$1$2{MASK}$2", "=", ":")
    return shapes(out)


def light_clean(line: Column, most: int = 4000) -> Column:
    """The layout of a log line: no colours, time stamp, invisible or control characters. Cut first, so that no expression sees a longer one."""
    out = _sub(_sub(_sub(F.substring(line, 1, most), ANSI, ""), TIMESTAMP, ""), INVISIBLE, "")
    return F.rtrim(_sub(out, r"[\p{Cc}&&[^\t\n]]", ""))


def scrub(line: Column) -> Column:
    """A log line without home directories, e-mail addresses and secrets; labels stay."""
    out = redact(_sub(_sub(line, HOME, "$1<user>", "/home/", "/Users/", ":\\"), EMAIL, "<email>", "@"))
    for pattern in LOG_RULES:
        out = _sub(out, pattern, f"$1{MASK}")
    return F.rtrim(out)


def secret_file(path: Column) -> Column:
    """Files that are never read: keys and environment files by name, but for templates."""
    name = F.lower(F.element_at(F.split(path, r"[/\\]"), -1))
    template = name.rlike(r"\.(example|sample|template|dist)$|^\.env\.(example|sample|template|dist)$")
    return name.rlike(r"^\.env(\..+)?$|\.(pem|key|p12|pfx|jks|keystore|kdbx)$|^id_(rsa|dsa|ecdsa|ed25519)$|^(credentials|secrets?)(\.(json|ya?ml|toml|ini))?$|^\.(npmrc|pypirc|netrc)$") & ~template


def redact_settings(text: Column) -> Column:
    """Settings of YAML, TOML or .properties without the values of secret names, line by line; placeholders stay.

    A block that follows a secret name (| or >) is blanked as far as it is indented, and a TOML string in three
    quotes line by line to its end, or to the text's.
    """
    name = rf"(?im)^([ \t]*(?:export[ \t]+)?[\"']?[\w.\-]*{SECRET_NAME}[\w.\-]*[\"']?[ \t]*[:=][ \t]*+)"
    text = _without_long_strings(text, name)
    out = F.regexp_replace(text, F.lit(name + r"[|>][+-]?[ \t]*\n((?:[ \t]+[^\n]*\n?|\n)+)"), F.lit(f"$1{MASK}\n"))
    out = F.regexp_replace(out, F.lit(name + r"(?!$|[\"']?\$\{|<redacted>|[|>][+-]?[ \t]*$)[^\n]+"), F.lit(f"$1{MASK}"))
    return redact(out)


def _without_long_strings(text: Column, name: str) -> Column:
    """text without what stands in three quotes after a secret name; lines stay."""
    head = name.replace("(?im)^", "(?i)\\A") + r"(?:\"{3}|'{3})"

    def closed(x: Column) -> Column:
        inside = F.substring(x["rest"], F.lit(1), x["n"])
        return F.concat(x["head"], F.regexp_replace(inside, F.lit(r"[^\n]+"), F.lit(MASK)), F.substring(x["rest"], x["n"] + 1, F.length(x["rest"])))

    def one(seg: Column) -> Column:
        start = F.regexp_extract(seg, head, 0)
        parts = F.struct(start.alias("head"), F.substring(seg, F.length(start) + 1, F.length(seg)).alias("rest"))
        at = lambda x: F.instr(x["rest"], F.right(x["head"], F.lit(3)))
        sized = lambda x: F.struct(x["head"].alias("head"), x["rest"].alias("rest"), F.when(x["head"] == "", 0).when(at(x) > 0, at(x) - 1).otherwise(F.length(x["rest"])).alias("n"))
        return let(let(parts, sized), closed)

    return F.array_join(F.transform(F.split(text, name.replace("(?im)^(", "(?im)^(?=(") + r"(?:\"{3}|'{3}))", -1), one), "")
