"""Queries over small inline inputs, for operators whose inputs the given tables don't hold: code, diffs, logs, reports.

Their SQL states the expected rows, written by hand from the rules, so a change of behaviour shows.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import cjk, redact
from siftwell.functions import keys as K
from siftwell.functions import text as T
from siftwell.operators import changes, code, documents, lines, logs, merging, runs
from siftwell.plans import checks
from siftwell.sources import readers

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

PYTHON = '"""Words of the module stand here."""\nimport os\n\nTTL = 30 * 24 * 3600  # a month\n\n\n# Loads the order by its id\n@app.get("/orders/{id}")\ndef load_order(id):\n    """Return the order of the given id."""\n    return os.environ.get("ORDER_DB")\n'
SCRIPT = "export const MAX = 30\nexport class Store {\n  put(x) { return x }\n}\napp.get('/orders/:id', (q, r) => {\n  r.send(process.env.PORT)\n})\n"
DIFF = 'diff --git a/src/app.py b/src/app.py\n--- a/src/app.py\n+++ b/src/app.py\n@@ -3,2 +3,3 @@ def f():\n-    old_helper_name("nothing to say here at all")\n+    new_helper_name("the order could not be loaded")\n+++ looks_like_header\n     same\ndiff --git a/.env b/.env\n--- a/.env\n+++ b/.env\n@@ -1 +1 @@\n-A=1\n+A=2\ndiff --git a/docs/x.md b/docs/x.md\nnew file mode 100644\n--- /dev/null\n+++ b/docs/x.md\n@@ -0,0 +1 @@\n+words\n'
LOG = "\n".join(
    f"2026-01-01T00:00:{i:02d}.5Z {x}"
    for i, x in enumerate(["##[group]Run make test", "make test", "##[endgroup]", "collecting ...", "FAILED tests/test_a.py::test_x - AssertionError: 1 != 2", "src/app.py:12: AssertionError", "##[error]Process completed with exit code 2."])
)
SPEC = "# Orders\n\n| name | rule |\n|---|---|\n| MAX_ITEMS | at most 50 items per order |\n\n## What is never sent\n\n- The key of any other project in use\n\nThe service must return HTTP 404 for\nunknown ids.\n\ntotal = compute(alpha, beta, gamma, delta, eps)\n"


def _quoted(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def fixture(columns: str, *rows: tuple) -> Callable:
    """Registers a query with the rows that it must give; columns as 'name type, ...' in DuckDB's types."""

    def add(f: Callable[[SparkSession], DataFrame]) -> Callable:
        names = [c.split()[0] for c in columns.split(", ")]
        casts = ", ".join(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in columns.split(", "))
        values = ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows)
        _queries[f.__name__] = lambda spark, sf_dir: f(spark).select(*names)
        _sql[f.__name__] = f"SELECT {casts} FROM (VALUES {values}) t({', '.join(names)})"
        return f

    return add


def _one(spark: SparkSession, ddl: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), ddl)


@fixture("name VARCHAR, kind VARCHAR, line INTEGER", ("TTL", "constant", 4), ("load_order", "function", 8), ("GET /orders/{id}", "route", 8), ("ORDER_DB", "config", 11), ("MAX", "constant", 1), ("Store", "class", 2), ("GET /orders/:id", "route", 5), ("PORT", "config", 6))
def fixture_code_symbols(spark):
    """Symbols of a Python and a JavaScript file."""
    return code.symbols(_one(spark, "path string, text string", ("a.py", PYTHON), ("b.js", SCRIPT)))


@fixture("start INTEGER, end_line INTEGER", (1, 6), (7, 12))
def fixture_code_units(spark):
    """Units of a Python file: definitions with what stands above them."""
    return code.code_units(_one(spark, "path string, text string", ("a.py", PYTHON))).withColumnRenamed("end", "end_line")


@fixture("kind VARCHAR, claim VARCHAR", ("comment + docstring", "comment: Loads the order by its id | docstring: Return the order of the given id."), ("test name", "refund writes one entry"))
def fixture_doc_claims(spark):
    """What units say about themselves."""
    files = _one(spark, "path string, text string", ("a.py", PYTHON), ("t.py", "def test_refund_writes_one_entry():\n    pass\n"))
    return code.claims(code.code_units(files))


@fixture("n_lines INTEGER, has_comment BOOLEAN", (12, False))
def fixture_comment_removal(spark):
    """Comments and docstrings go, lines stay."""
    bare = code.stripped(_one(spark, "path string, text string", ("a.py", PYTHON)))
    return bare.select(F.size(T.lines(F.col("text"))).alias("n_lines"), F.col("text").rlike("month|Words|Return the|Loads").alias("has_comment"))


@fixture("said VARCHAR", ("`30 * 24 * 3600` = 2,592,000  (= 30 days if this is seconds)",), ("`2 * 1024 * 1024` = 2,097,152  (= 2 MiB if this is bytes)",))
def fixture_arithmetic(spark):
    """Sums done in advance, outermost expressions only."""
    done = F.pandas_udf("array<string>")(lambda s: s.map(code.arithmetic))
    return _one(spark, "x string", (PYTHON,), ("size = 2 * 1024 * 1024",), ("y = 9**9**9",), ("z = a * b",)).select(F.explode(done("x")).alias("said"))


@fixture("path VARCHAR, sign VARCHAR, line_no INTEGER, line VARCHAR", ("src/app.py", "-", 3, '    old_helper_name("nothing to say here at all")'), ("src/app.py", "+", 3, '    new_helper_name("the order could not be loaded")'), ("src/app.py", "+", 4, "++ looks_like_header"), ("docs/x.md", "+", 1, "words"))
def fixture_diff_lines(spark):
    """Changed lines of a diff with their numbers; files of secrets are left out."""
    return changes.diff_lines(changes.sections(_one(spark, "change_id string, diff string", ("c", DIFF))))


@fixture("token VARCHAR, verb VARCHAR", ("new_helper_name", "adds"), ("old_helper_name", "removes"), ("the order could not be loaded", "adds"), ("nothing to say here at all", "removes"), ("looks_like_header", "adds"))
def fixture_change_tokens(spark):
    """Names and texts that a change adds or removes."""
    return changes.change_tokens(changes.diff_lines(changes.sections(_one(spark, "change_id string, diff string", ("c", DIFF)))))


@fixture("claim_no INTEGER, claim VARCHAR, path VARCHAR", (1, "This loads orders in app.py from now on.", "src/app.py"), (2, "Another item stands on its own here", None))
def fixture_change_claims(spark):
    """Claims of a description with the files that they name."""
    text = "# Title\n\nThis loads orders in app.py from now on. Short one.\n\n- Another item stands on its own here\n- [ ] no claim at all here\n\nCo-Authored-By: a b c d\n"
    said = changes.description_claims(_one(spark, "change_id string, text string", ("c", text)))
    return said.join(changes.pair_claims(said, changes.sections(_one(spark, "change_id string, diff string", ("c", DIFF)))).drop("claim"), ["change_id", "claim_no"], "left")


@fixture("jobs VARCHAR, step VARCHAR, kind VARCHAR, exit_code INTEGER, tests VARCHAR, files VARCHAR", ("job", "make test", "test", 2, "tests/test_a.py::test_x", "src/app.py"))
def fixture_log_failures(spark):
    """One failure from a log."""
    found = logs.failures(logs.step_lines(_one(spark, "file string, text string", ("f", LOG))))
    return found.select(*[F.array_join(c, ",").alias(c) for c in ("jobs", "tests", "files")], "step", "kind", "exit_code")


@fixture("step_key VARCHAR", ("set up python #",), ("set up python #",), ("install on <os>",))
def fixture_step_keys(spark):
    """Names of steps with versions and systems alike."""
    return _one(spark, "x string", ("Set up Python 3.12",), ("Set up Python 3.14.0-beta.2",), ("Install on ubuntu-24.04",)).select(K.step_key(F.col("x")).alias("step_key"))


@fixture("file VARCHAR, test VARCHAR, problem VARCHAR", ("g", "a.B::t", None), ("d", None, "declares a DTD or entities"))
def fixture_junit(spark):
    """Failed cases of a report; one with a DTD is refused."""
    good = '<testsuite><testcase classname="a.B" name="t"><failure type="E" message="m">x</failure></testcase><testcase name="ok"/></testsuite>'
    return readers.junit_failures(_one(spark, "file string, xml string", ("g", good), ("d", "<!DOCTYPE x><a/>")))


@fixture("verb VARCHAR, path VARCHAR, operation_id VARCHAR", ("GET", "/v1/ping", "ping"), ("POST", "/v1/o/{id}", None))
def fixture_openapi_routes(spark):
    """Routes of a contract below its server's path."""
    doc = '{"servers": [{"url": "https://h/v1"}], "paths": {"/ping": {"get": {"operationId": "ping"}}, "/o/{id}": {"post": {}}}}'
    return readers.openapi_routes(_one(spark, "file string, text string", ("o.json", doc)))


@fixture("line INTEGER, key VARCHAR, value VARCHAR, profile VARCHAR", (2, "a.b", "onetwo", "dev"), (4, "c", "3", "dev"), (1, "K", "1", None))
def fixture_settings(spark):
    """Settings with continued lines; real environment files stay unread."""
    return readers.settings(_one(spark, "path string, text string", ("application-dev.properties", "# c\na.b = one\\\n  two\nc: 3\n"), (".env", "S=1"), (".env.example", "export K=1")))


@fixture("clean VARCHAR", ("db:\n  user: ann\n  password: <redacted>\n  token: ${T}\nprivate_key: <redacted>\nnext: 1\n",))
def fixture_settings_redaction(spark):
    """Settings without the values of secret names."""
    return _one(spark, "x string", ("db:\n  user: ann\n  password: hunter2\n  token: ${T}\nprivate_key: |\n  l1\n  l2\nnext: 1\n",)).select(redact.redact_settings(F.col("x")).alias("clean"))


@fixture("clean VARCHAR", ('password = "${DB_PASSWORD}"',), ('password = "${DB_PASSWORD:<redacted>}"',), ("see https://<redacted>@host/x",), ("<redacted>!",))
def fixture_redaction(spark):
    """Placeholders stay, their defaults, logins and keys go."""
    rows = ('password = "${DB_PASSWORD}"',), ('password = "${DB_PASSWORD:hunter2}"',), ("see https://u:pw12@host/x",), ("-----BEGIN RSA PRIVATE KEY-----\nMII\n-----END RSA PRIVATE KEY-----!",)
    return _one(spark, "x string", *rows).select(redact.redact(F.col("x")).alias("clean"))


@fixture("n INTEGER, sentence VARCHAR", (1, "要件を満たす。"), (2, "次は必ず検証する。"), (1, "「保存。完了」と表示する。"))
def fixture_cjk_sentences(spark):
    """Sentences end at stops outside quotes."""
    rows = _one(spark, "x string", ("要件を満たす。次は必ず検証する。",), ("「保存。完了」と表示する。",))
    return rows.select(F.posexplode(cjk.sentences(F.col("x"))).alias("i", "sentence")).select((F.col("i") + 1).alias("n"), "sentence")


@fixture("line_no INTEGER, sentence VARCHAR, is_code BOOLEAN", (5, "MAX_ITEMS - at most 50 items per order", False), (9, "What is never sent: The key of any other project in use", False), (11, "The service must return HTTP 404 for unknown ids.", False), (14, "total = compute(alpha, beta, gamma, delta, eps)", True))
def fixture_requirements(spark):
    """Requirement sentences of a specification."""
    return lines.requirement_rows(_one(spark, "doc string, text string", ("d", SPEC)), ["doc"])


@fixture("doc VARCHAR, says VARCHAR", ("a", "Status: Superseded by ADR-7"), ("b", "# Payments (DEPRECATED)"), ("c", None), ("d", None))
def fixture_declared_old(spark):
    """Documents that say they are old themselves."""
    rows = ("a", "# Spec\n\nStatus: Superseded by ADR-7\n"), ("b", "# Payments (DEPRECATED)\n"), ("c", "Superseded by: N/A\n"), ("d", "Section 3 of this spec has been superseded.\n")
    return _one(spark, "doc string, text string", *rows).select("doc", documents.declared_old(F.col("text")).alias("says"))


@fixture("path VARCHAR, family VARCHAR, newest VARCHAR", ("docs/spec-v1.md", "docs/spec", "docs/spec-v10.md"), ("docs/spec-v10.md", "docs/spec", "docs/spec-v10.md"), ("docs/old/spec-v11.md", "docs/spec", "docs/spec-v10.md"), ("a/note.md", "a/note", None), ("a/note-copy.md", "a/note", None))
def fixture_document_survey(spark):
    """Editions of documents and the newest of each."""
    at = datetime.datetime(2026, 1, 1)
    return documents.survey(_one(spark, "path string, text string, last_commit timestamp", *[(p, "# T\n", at) for p in ("docs/spec-v1.md", "docs/spec-v10.md", "docs/old/spec-v11.md", "a/note.md", "a/note-copy.md")]))


@fixture("line INTEGER, found_line INTEGER", (1, 3), (9, 8), (2, None))
def fixture_snapshot_search(spark):
    """Where reviewed sentences stand now, whatever their wrapping."""
    docs = _one(spark, "doc string, text string", ("d", "# One\n\nThe *value* is\nkept for `30` days.\n\nother\n\nThe value is kept for 30 days.\n"))
    return documents.find_snapshots(docs, _one(spark, "doc string, line int, text string", ("d", 1, "the value is kept for 30 days"), ("d", 9, "The value is kept for 30 days."), ("d", 2, "gone")))


@fixture("name VARCHAR, by_fail_fast BOOLEAN", ("t (b)", True), ("t (c)", False), ("u", False))
def fixture_fail_fast(spark):
    """Cancelled jobs, and whether a failure of their matrix cancelled them."""
    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    return runs.cancelled_jobs(_one(spark, "run int, name string, conclusion string, completed_at timestamp", (1, "t (a)", "failure", at(100)), (1, "t (b)", "cancelled", at(110)), (1, "t (c)", "cancelled", at(900)), (1, "u", "cancelled", at(101))))


@fixture("job VARCHAR, passed_before BOOLEAN", ("j", True), ("k", False), ("l", None))
def fixture_default_branch(spark):
    """How jobs ended in the default branch's last own run of another commit."""
    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    mine = _one(spark, "run int, sha string, created_at timestamp", (1, "s1", at(50)))
    past = _one(spark, "past int, sha string, created_at timestamp, event string, own boolean", (10, "s0", at(10), "push", True), (11, "s1", at(40), "push", True), (12, "s2", at(45), "pull_request", True), (13, "s3", at(60), "push", True))
    return runs.default_branch_record(mine, past, _one(spark, "past int, job string, conclusion string", (10, "j", "success"), (10, "k", "failure"), (10, "l", "cancelled"), (11, "j", "failure")))


@fixture("path VARCHAR", ("tmp/case/x.py",))
def fixture_outside_project(spark):
    """Files named by errors that are none of the project's."""
    named = _one(spark, "path string", ("src\\App.py",), ("tmp/case/x.py",), ("lib/sub/y.c",))
    return runs.outside_project(named, _one(spark, "path string", ("svc/src/app.py",)), _one(spark, "folder string", ("lib",)))


@fixture("line INTEGER, scope VARCHAR, flags VARCHAR, twin BOOLEAN", (3, "svc/**/*.py", "negation", False), (5, "svc/**/*.py", "negation", True), (6, "svc/**/*.go,svc/**/*.py,tests-only", "exception", False))
def fixture_rule_drafts(spark):
    """Rules drafted from a file, with flags, scopes and twins."""
    text = "# Rules\n\n- Never use `eval` in Python code.\n- The weather was fine that day\n- never use eval, in Python code!\n- Every test must close its fixtures unless it fails.\n"
    drafts = checks.draft_rule_map(_one(spark, "doc string, text string", ("svc/AGENTS.md", text)), ["py", "go"])
    return drafts.select("line", F.array_join("scope", ",").alias("scope"), F.array_join("flags", ",").alias("flags"), F.col("duplicate_of").isNotNull().alias("twin"))


@fixture("kind VARCHAR, line INTEGER", ("moved", 4), ("changed", 9), ("no such code", 9), ("not covered", 5))
def fixture_map_validation(spark):
    """What is wrong with a specification's map."""
    docs = _one(spark, "doc string, text string", ("s.md", "# Orders\n\nThe `load_order` function returns the order of an id.\n\nA month is `TTL` seconds long in all places.\n"))
    symbols = code.symbols(_one(spark, "path string, text string", ("src/app.py", PYTHON)))
    entries = _one(spark, "spec string, line int, text string, code array<string>, status string", ("s.md", 4, "The `load_order` function returns the order of an id.", ["src/app.py:load_order"], "reviewed"), ("s.md", 9, "Gone from the text it was.", ["nope"], "reviewed"))
    return checks.validate_spec_map(entries, docs, symbols)


@fixture("key VARCHAR", ("maxitems",), ("maxitems",), ("maxitems",), ("MAX_ITEMS",))
def fixture_config_keys(spark):
    """Relaxed names of settings."""
    return _one(spark, "x string", ("max-items",), ("maxItems",), ("max_items",), ("MAX_ITEMS",)).select(K.config_key(F.col("x")).alias("key"))


@fixture("rule VARCHAR, false_positives BIGINT, verdicts BIGINT, poor BOOLEAN", ("r", 3, 5, True), ("q", 4, 4, False))
def fixture_rule_records(spark):
    """Records of rules: the last verdict of each finding, and when a record is poor."""
    v = [("r", "f", str(i), "false_positive" if i < 3 else "confirmed", i) for i in range(5)] + [("q", "f", str(i), "false_positive", i) for i in range(4)] + [("r", "f", "0", "nonsense", 99)]
    return merging.rule_records(_one(spark, "rule string, file string, code_sha string, verdict string, seq long", *v))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
