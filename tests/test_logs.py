from pyspark.sql import functions as F

from siftwell.operators import logs
from siftwell.sources import readers

T = "2026-01-01T00:{:02d}:{:02d}.5Z "


def _log(*lines, start=0):
    return "\n".join(T.format((start + i) // 60, (start + i) % 60) + x for i, x in enumerate(lines))


SHAPE = ["##[group]Run make test", "make test", "##[endgroup]", "collecting ...", "FAILED tests/test_a.py::test_x - AssertionError: 1 != 2", "src/app.py:12: AssertionError", "##[error]Process completed with exit code 2."]


def _failures(spark, *texts):
    rows = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, text string")
    return logs.failures(logs.step_lines(rows)).collect()


def test_three_shapes_give_one_failure(spark):
    raw = _log(*SHAPE)
    tabbed = "\n".join("job\tstep\t" + x for x in raw.split("\n"))
    headed = "===== job: job =====\n" + raw
    got = [_failures(spark, x) for x in (raw, tabbed, headed)]
    assert all(len(g) == 1 for g in got)
    for (f,) in got:
        assert (f.jobs, f.step, f.kind, f.exit_code) == (["job"], "make test", "test", 2)
        assert f.tests == ["tests/test_a.py::test_x"] and "src/app.py" in f.files
        assert f.candidates[0].startswith("FAILED tests/test_a.py") and "make test" not in f.tail


def test_matrix_is_one_failure(spark):
    logs_ = [f"===== job: py{v} =====\n" + _log(f"##[group]Run Set up Python 3.{v}", "x", "##[endgroup]", "Error: no such version 3.1", "##[error]Process completed with exit code 1.") for v in (12, 13)]
    (f,) = _failures(spark, "\n".join(logs_))
    assert f.jobs == ["py12", "py13"]


def test_steps_and_silence(spark):
    text = _log("##[group]Run a", "##[endgroup]", "one") + "\n" + _log("two", start=65) + "\n" + _log("##[group]Run b", "##[endgroup]", "##[error]Process completed with exit code 3.", start=80)
    rows = logs.steps(logs.step_lines(spark.createDataFrame([("f", text)], "file string, text string"))).orderBy("step_no").collect()
    assert [(r.step, r.failed, r.exit_code, r.silent) for r in rows][-2:] == [("a", False, None, 63), ("b", True, 3, 0)]


def test_neighbour_rule_and_repeats(spark):
    text = ["error: first", "pad one", "pad two", "x.py:3: near by", "x.py:4: too far away", "error: first", "error: item 1", "error: item 2"]
    df = spark.createDataFrame([("k", i + 1, t) for i, t in enumerate(text)], "k string, line_no int, line string")
    got = [r.line for r in logs.candidates(df.where("line_no <= 5"), ["k"]).orderBy("line_no").collect()]
    assert got == ["error: first", "x.py:3: near by"]
    assert [r.line_no for r in logs.candidates(df, ["k"]).orderBy("line_no").collect()] == [1, 4, 5, 7]


def test_top_candidates(spark):
    df = spark.createDataFrame([("k", i, f"error: thing {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(1, 90)], "k string, line_no int, line string")
    got = logs.candidates(df, ["k"]).collect()
    assert len(got) == 30 and min(r.line_no for r in got) == 29


def test_tail_fits(spark):
    df = spark.createDataFrame([("k", i, "x" * 99) for i in range(100)], "k string, line_no int, line string")
    assert [r.line_no for r in logs.tail(df, ["k"]).orderBy("line_no").collect()] == list(range(50, 100))


def test_frames(spark):
    lines = ["Traceback (most recent call last):", '  File "src/app.py", line 3, in run', "    go()", '  File "/usr/lib/python3/x.py", line 9, in go', "    raise E", "E: no"]
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(lines)], "k string, line_no int, line string")
    assert [tuple(r)[1:] for r in logs.innermost_frames(df, ["k"]).collect()] == [(1, "src/app.py:3 in run: go()")]


def test_junit(spark):
    good = '<testsuite><testcase classname="a.B" name="t"><failure type="E" message="bad token: abcdef123456">line\nmore</failure></testcase><testcase name="ok"/></testsuite>'
    rows = spark.createDataFrame([("g", good), ("d", "<!DOCTYPE x><a/>"), ("b", "<a"), ("n", None)], "file string, xml string")
    got = {(r.file, r.test, r.problem is None) for r in readers.junit_failures(rows.where("xml is not null")).collect()}
    assert got == {("g", "a.B::t", True), ("d", None, False), ("b", None, False)}
    assert "abcdef" not in readers.junit_failures(rows.where("file = 'g'")).first().message


def test_empty(spark):
    none = spark.createDataFrame([], "file string, text string")
    assert logs.failures(logs.step_lines(none)).count() == 0
    assert logs.failures(logs.step_lines(spark.createDataFrame([("f", ""), ("g", None)], "file string, text string"))).where(F.size("jobs") > 1).count() == 0


#: A line of each format, and what it is: an error by itself, a hint, an end without a cause, a summary, noise, or nothing.
FORMS = [
    ("FAILED tests/test_a.py::test_x - assert 1 == 2", "strong"),
    ("E       AssertionError: no", "strong"),
    ("builtins.KeyboardInterrupt", "strong"),
    ("pkg.errors.ParseError", "strong"),
    ("Caused by: java.io.IOException", "strong"),
    ("org.junit.ComparisonFailure: expected", "strong"),
    ("FAILURE: nothing", "strong"),
    ("test_failure: passed", ""),
    ("[ERROR] Failed to execute goal", "strong"),
    ("> Task :compileJava FAILED", "strong"),
    ("Some FAILED thing", "strong"),
    ("reading failed.log", ""),
    ("writing out/FAILED/x", ""),
    ("12 failed, 3 passed", "strong"),
    ("0 failed, 3 passed", ""),
    ("--- FAIL: TestA (0.00s)", "strong"),
    ("panic: nil map", "strong"),
    ("error[E0425]: cannot find value", "strong"),
    ("  --> src/main.rs:3", "strong"),
    ("✕ adds numbers (3 ms)", "strong"),
    ("npm ERR! missing script", "strong"),
    ("src/a.ts(3,1): error TS2304: no name", "strong"),
    ("mypy.....................................Failed", "strong"),
    ("- hook id: mypy", "strong"),
    ("Found 3 errors in 1 file", "strong"),
    ("CVE-2024-12 x", "strong"),
    ("   Total: 4 (HIGH: 1)", "strong"),
    ("x: the name of a cmdlet", ""),
    ("'x' is not recognized as an internal or external command", "strong"),
    ("E: Failed to fetch http://x", "strong"),
    ("src/app.py:12: in run", "weak"),
    ("F401 unused import", "weak"),
    ("expected 3 but found 4, got 5", "weak"),
    ("job x ERROR y", "weak"),
    ("at frame src/app/x.py:12", "weak"),
    ("all is well", ""),
    ("issues found", "terminal"),
    ("##[error]Process completed with exit code 2.", "terminal"),
    ("make: *** [all] Error 2", "terminal"),
    ("npm ERR! code ELIFECYCLE", "terminal"),
    ("=== short test summary info ===", "summary"),
    ("Results:", "summary"),
    ("Downloading x-1.0.whl", "noise"),
    ("2026-01-01T00:00:00Z INFO error: none", "noise"),
    ("    --- PASS: TestB", "noise"),
]


def test_forms_of_lines(spark):
    df = spark.createDataFrame(list(enumerate(FORMS)), "i int, f struct<line: string, kind: string>").select("i", "f.*")
    line = F.col("line")
    trimmed = F.trim(line)
    kind = (
        F.when(line.rlike(logs.NOISE), "noise").when(trimmed.rlike(logs.TERMINAL), "terminal").when(line.rlike(logs.SUMMARY) & ~line.rlike(logs.STRONG), "summary")
        .when(line.rlike(logs.STRONG), "strong").when(line.rlike(logs.WEAK), "weak").otherwise("")
    )
    wrong = [(r.line, r.kind, r.got) for r in df.withColumn("got", kind).collect() if r.got != r.kind]
    assert not wrong


def test_kinds_of_steps(spark):
    rows = [("Run make test", None, "test"), ("x", "E: Failed to fetch http://a", "install"), ("unit test", "TypeError: Failed to fetch", "test"), ("x", "[3]E: failed to fetch", "install"), (None, None, "other"), ("Lint", "1 ERROR TS2304", "type"), ("compile", "", "build")]
    df = spark.createDataFrame(rows, "name string, tail string, kind string")
    assert [(r.name, r.got) for r in df.withColumn("got", logs.step_kind(F.col("name"), F.col("tail"))).collect()] == [(n, k) for n, _, k in rows]


def test_names_of_tests(spark):
    rows = [
        ("FAILED a/b.py::C::d - x", "a/b.py::C::d"), ("--- FAIL: TestA (0.1s)", "TestA"), ("test m::t ... FAILED", "m::t"), ("● adds (3 ms)", "adds"),
        ("[ERROR] t(a.B)  Time elapsed: 1 s  <<< FAILURE!", "t(a.B)"), ("BTest > adds FAILED", "BTest > adds"), ("ok", None),
    ]
    df = spark.createDataFrame(rows, "line string, want string")
    assert [r.got for r in df.withColumn("got", logs.test_name(F.col("line"))).collect()] == [w for _, w in rows]
