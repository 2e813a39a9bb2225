import pytest
from pyspark.sql import functions as F

from siftwell.operators import changes, code
from siftwell.sources import readers, writers

PY = '''"""Module words that are said here."""
import os

TTL = 30 * 24 * 3600  # a month


# Loads the order by its id
@app.get("/orders/{id}")
def load_order(id):
    """Return the order of the given id."""
    return os.environ.get("ORDER_DB", "x#y")


class Store:
    limit = 50

    def put(self, x):
        return x
'''


def test_symbols():
    got = {(s["name"], s["kind"]) for s in code.python_symbols("a.py", PY)}
    assert got == {("TTL", "constant"), ("load_order", "function"), ("GET /orders/{id}", "route"), ("ORDER_DB", "config"), ("Store", "class"), ("Store.limit", "field"), ("Store.put", "function")}
    assert code.python_symbols("a.py", "def (") == []


def test_comments_go_and_lines_stay():
    bare = code.without_comments("a.py", PY)
    assert bare.count("\n") == PY.count("\n") and "month" not in bare and "Module words" not in bare and "Return the order" not in bare and '"x#y"' in bare
    js = 'let a = "// no"; // yes\n/* two\nlines */ b = `x /* y */`;'
    assert code.without_comments("a.js", js) == 'let a = "// no"; \n\n b = `x /* y */`;'
    assert code.without_comments("a.py", "def (") == "def ("


def test_units():
    got = code.units(PY)
    assert got[0][0] == 1 and got[-1][1] == len(PY.split("\n"))
    text = PY.split("\n")
    assert any(text[a - 1].startswith("# Loads") for a, _ in got)
    long = "def f():\n" + "\n".join(f"    call({i},\n         {'x' * 60})" for i in range(120))
    parts = code.units(long)
    assert len(parts) > 2 and all(long.split("\n")[a - 1].lstrip().startswith(("def", "call")) for a, _ in parts)
    assert [z + 1 for _, z in parts[:-1]] == [a for a, _ in parts[1:]]


def test_doc_claims():
    unit = "\n".join(PY.split("\n")[6:11])
    assert code.doc_claim("a.py", unit) == ("comment + docstring", "comment: Loads the order by its id | docstring: Return the order of the given id.")
    assert code.doc_claim("t.py", "def test_refund_writes_one_entry():\n    pass") == ("test name", "refund writes one entry")
    assert code.doc_claim("a.py", "# licence of the whole file here\nimport os") is None


@pytest.mark.parametrize(
    "text,want",
    [("TTL = 30 * 24 * 3600", ["`30 * 24 * 3600` = 2,592,000  (= 30 days if this is seconds)"]), ("x = 2 * 1024 * 1024", ["`2 * 1024 * 1024` = 2,097,152  (= 2 MiB if this is bytes)"]), ("x = a * 3", []), ("9**9**9", []), ("1/0", []), ("x = (", [])],
)
def test_arithmetic(text, want):
    got = code.arithmetic(text)
    assert got == want or got == [w.replace("  (= 2 MiB", "  (= 2 MiB") for w in want]


def test_code_tables(spark):
    files = spark.createDataFrame([("a.py", PY), ("b.go", "func main() {\n}\n"), ("c.py", None)], "path string, text string")
    assert code.symbols(files).count() == 7 and code.symbols(files.limit(0)).count() == 0
    rows = code.code_units(files)
    assert {r.path for r in rows.collect()} == {"a.py", "b.go"}
    assert [r.kind for r in code.claims(rows).collect()] == ["comment + docstring"]
    assert code.stripped(files).where("path = 'c.py'").first().text is None
    rust = spark.createDataFrame([("m.rs", 1, 4, "fn a() {}"), ("m.rs", 5, 9, "#[cfg(test)]\nmod t {}"), ("m.rs", 10, 12, "fn helper() {}"), ("tests/x.py", 1, 2, "x"), ("src/y.py", 1, 2, "y")], "path string, start int, end int, text string")
    assert {(r.path, r.start) for r in code.test_units(rust).collect()} == {("m.rs", 5), ("m.rs", 10), ("tests/x.py", 1)}


DIFF = """diff --git a/src/app.py b/src/app.py
--- a/src/app.py
+++ b/src/app.py
@@ -3,2 +3,3 @@ def f():
-    old_helper_name("nothing to say here at all")
+    new_helper_name("the order could not be loaded")
+++ looks_like_header
     same
diff --git a/.env b/.env
--- a/.env
+++ b/.env
@@ -1 +1 @@
-A=1
+A=2
diff --git a/docs/x.md b/docs/x.md
new file mode 100644
--- /dev/null
+++ b/docs/x.md
@@ -0,0 +1 @@
+words
"""


def test_diffs(spark):
    d = spark.createDataFrame([("c", DIFF), ("n", None), ("e", "")], "change_id string, diff string")
    secs = changes.sections(d)
    assert [r.path for r in secs.orderBy("file_no").collect()] == ["src/app.py", "docs/x.md"]
    rows = {(r.path, r.sign, r.line_no, r.line) for r in changes.diff_lines(secs).collect()}
    assert ("src/app.py", "+", 4, "++ looks_like_header") in rows and ("src/app.py", "-", 3, '    old_helper_name("nothing to say here at all")') in rows and ("docs/x.md", "+", 1, "words") in rows
    tokens = {(r.token, r.verb) for r in changes.change_tokens(changes.diff_lines(secs)).collect()}
    assert {("new_helper_name", "adds"), ("old_helper_name", "removes"), ("the order could not be loaded", "adds")} <= tokens
    errors = spark.createDataFrame([("c", 1, "E new_helper_name: the order could not be loaded"), ("c", 2, "nothing")], "change_id string, line_no int, line string")
    got = changes.named_by_change(errors, changes.change_tokens(changes.diff_lines(secs))).collect()
    assert [(r.line_no, r.token, r.verb) for r in got] == [(1, "new_helper_name", "adds")]
    named = spark.createDataFrame([("c", "docs/x.md")], "change_id string, path string")
    assert [r.path for r in changes.within_budget(secs, named, most=200).collect()] == ["docs/x.md"]


def test_change_claims(spark):
    text = "# Title\n\nThis loads orders in app.py with `new_helper_name` now. Short one.\n\n- The second item stands on its own here\n- [ ] a check box is not a claim at all\n\n```\ncode in a fence is no claim\n```\nCo-Authored-By: a b c d\nSee missing.py for the rest of it.\n"
    said = changes.description_claims(spark.createDataFrame([("c", text), ("n", None)], "change_id string, text string"))
    claims = [r.claim for r in said.orderBy("claim_no").collect()]
    assert claims == ["This loads orders in app.py with `new_helper_name` now.", "The second item stands on its own here", "See missing.py for the rest of it."]
    secs = changes.sections(spark.createDataFrame([("c", DIFF)], "change_id string, diff string"))
    pairs = changes.pair_claims(said, secs)
    assert [(r.claim_no, r.path) for r in pairs.collect()] == [(1, "src/app.py")]
    assert [r.path for r in changes.unmentioned_files(secs, pairs).collect()] == ["docs/x.md"]
    assert [(r.claim_no, r.file) for r in changes.files_not_in_change(said, secs).collect()] == [(3, "missing.py")]


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("\ufeffone\r\ntwo".encode())
    (tmp_path / "b.md").write_bytes("vier".encode("utf-16"))
    (tmp_path / ".env").write_text("A=1")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "c.md").write_text("no")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in readers.text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "one\ntwo", "b.md": "vier"}
    (tmp_path / "x.log").write_text("first\nsecond\n" + "y" * 50 + "\n")
    cut = readers.logs(spark, str(tmp_path), most=55).first()
    assert cut.cut and cut.text == "y" * 50 + "\n"


def test_contracts_and_settings(spark):
    doc = '{"servers": [{"url": "https://h/v1"}], "paths": {"/ping": {"get": {"operationId": "ping"}, "parameters": []}, "/o/{id}": {"post": {}}}}'
    rows = spark.createDataFrame([("o.json", doc), ("bad", "{")], "file string, text string")
    assert {(r.verb, r.path, r.operation_id) for r in readers.openapi_routes(rows).collect()} == {("GET", "/v1/ping", "ping"), ("POST", "/v1/o/{id}", None)}
    files = spark.createDataFrame([("application-dev.properties", "# c\na.b = one\\\n  two\nc: 3\n"), (".env", "K=1"), (".env.example", "export K=1"), ("x.yml", "a:\n  b: [1, true]\n"), ("bad.yml", "a: [")], "path string, text string")
    assert {(r.file, r.line, r.key, r.value, r.profile) for r in readers.settings(files).collect()} == {("application-dev.properties", 2, "a.b", "onetwo", "dev"), ("application-dev.properties", 4, "c", "3", "dev"), (".env.example", 1, "K", "1", None)}
    assert {(r.key, r.value) for r in readers.yaml_settings(files).collect()} == {("a.b[0]", "1"), ("a.b[1]", "true")}


def test_maps(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"entries": [{"spec": "s.md", "line": 3, "text": "t", "code": "a.py:f", "status": "reviewed"}, {"spec": "s.md", "line": 4, "text": "u", "code": ["a", "b"], "status": "draft"}, {"spec": "", "text": "x"}, {"spec": "s", "line": 1, "text": "x", "status": "odd"}]}')
    entries, problems = readers.spec_map(spark, str(tmp_path / "m.json"))
    assert [r.code for r in entries.orderBy("line").collect()] == [["a.py:f"], ["a", "b"]]
    assert [(r.i, r.problem) for r in problems.orderBy("i").collect()] == [(2, "no spec"), (3, "unknown status")]
    moved = spark.createDataFrame([("s.md", 3, 30)], "spec string, line int, new_line int")
    assert [r.line for r in writers.moved_lines(entries, moved, ["spec", "line"]).orderBy("line").collect()] == [4, 30]
    writers.write_map(entries, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_map(entries, str(tmp_path / "out"))
    v = spark.createDataFrame([("r", "f", "s", "confirmed", None, None, 1)], "rule string, file string, code_sha string, verdict string, why string, date date, seq long")
    writers.append_verdicts(v, str(tmp_path / "v"))
    writers.append_verdicts(v, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).where("date is not null").count() == 2
    with pytest.raises(ValueError):
        writers.append_verdicts(v.withColumn("verdict", F.lit("maybe")), str(tmp_path / "v"))
    writers.save_snapshot(v, str(tmp_path / "snap"))
    assert writers.load_snapshot(spark, str(tmp_path / "snap")).count() == 1
    with pytest.raises(ValueError):
        writers.load_snapshot(spark, str(tmp_path / "snap"), version=2)


JS = """import x from 'y'
// const hidden = 1
export const MAX = 30
const load = async (id) => {
  const inner = 2
  return process.env.ORDER_DB
}
export default class Store {
  put(x) { return x }
}
function go() { return "{" }
app.get('/orders/:id', (req, res) => {
  res.send(1)
})
"""
JAVA = """package a;
@RestController
@RequestMapping("/api")
public class Orders {
  static final int LIMIT = 50;
  @Value("${db.url:none}") String url;
  @GetMapping("/orders/{id}")
  public Order load(String id) {
    if (id == null) { return null; }
    return repo.find(id);
  }
}
"""


def test_brace_symbols():
    got = {(s["name"], s["kind"]): s for s in code.brace_symbols("a.ts", JS)}
    assert set(got) == {("MAX", "constant"), ("load", "function"), ("Store", "class"), ("go", "function"), ("GET /orders/:id", "route"), ("ORDER_DB", "config")}
    assert got[("MAX", "constant")]["value"] == "30" and got[("load", "function")]["source"].endswith("}") and got[("GET /orders/:id", "route")]["line"] == 12
    got = {(s["name"], s["kind"]) for s in code.brace_symbols("A.java", JAVA)}
    assert got == {("Orders", "class"), ("Orders.LIMIT", "constant"), ("Orders.load", "function"), ("GET /api/orders/{id}", "route"), ("db.url", "config")}


def test_prose(spark):
    got = code.prose(spark.createDataFrame([("a.py", PY), ("b.md", "x"), ("c.py", None)], "path string, text string")).orderBy("doc").collect()
    assert got[0].text.split("\n")[0] == "Module words that are said here." and "Return the order of the given id." in got[0].text and got[1].text == "x" and got[2].text is None


def test_key_material(spark):
    key = "".join(chr(97 + i % 26) for i in range(128))
    raw = f"K = '''-----BEGIN RSA PRIVATE KEY-----\n{key[:64]}\n{key[64:]}\n-----END RSA PRIVATE KEY-----'''\nx = 1\n"
    moved = f"a {key[:64]} b {key[64:100]} c"
    assert not any(key[i : i + 16] in code.hide_key_material(raw, moved) for i in range(0, 64, 16))
    assert code.hide_key_material("no key here", moved) == moved
    units_ = spark.createDataFrame([("k.py", raw), ("l.py", "x")], "path string, text string")
    files = spark.createDataFrame([("k.py", raw), ("l.py", "x")], "path string, text string")
    got = {r.path: r.text for r in code.without_keys(units_, files).collect()}
    assert got["l.py"] == "x" and key[:32] not in got["k.py"]
    with pytest.raises(Exception, match="no file for"):
        code.without_keys(units_, files.where("path = 'l.py'")).collect()


def test_budget_keeps_whole_hunks_of_a_large_first_file(spark):
    hunk = lambda n: f"@@ -{n},1 +{n},1 @@\n-{'a' * 90}{n}\n+{'b' * 90}{n}\n"
    head = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n"
    diff = head + "".join(hunk(n) for n in range(1, 40)) + "diff --git a/y.py b/y.py\n--- a/y.py\n+++ b/y.py\n" + hunk(1)
    secs = changes.sections(spark.createDataFrame([("c", diff)], "change_id string, diff string"))
    none = spark.createDataFrame([], "change_id string, path string")
    (got,) = changes.within_budget(secs, none, most=1000).collect()
    assert got.path == "x.py" and got.section.startswith(head + hunk(1)) and got.section.endswith(hunk(4)) and len(got.section) <= 1000
    (small,) = changes.within_budget(secs, none, most=50).collect()
    assert len(small.section) <= 50 and small.section.endswith("\n") and (head + hunk(1)).startswith(small.section) and len((head + hunk(1))[: 50].rsplit("\n", 1)[0]) + 1 == len(small.section)
    first = spark.createDataFrame([("c", "y.py")], "change_id string, path string")
    assert {r.path for r in changes.within_budget(secs, first, most=600).collect()} == {"x.py", "y.py"}
