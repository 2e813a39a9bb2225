import datetime
import random

import pytest
from pyspark.sql import functions as F

from siftwell.functions import redact
from siftwell.operators import documents as D
from siftwell.operators import runs


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "x string").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "text,old",
    [
        ("# Spec\n\nStatus: Superseded by ADR-7\n", True), ("> **Deprecated:** see v2\n", True), ("# Payments (DEPRECATED)\n", True), ("This document is obsolete.\n", True),
        ("Superseded by: N/A\n", False), ("Deprecated endpoints return 410 to all.\n", False), ("## Deprecated fields\n\nwords\n", False), ("Section 3 of this spec has been superseded.\n", False),
        ("```\nStatus: deprecated\n```\n", False), ("all of it until symbols have been\nreplaced by terminal characters.\n", False), ("Superseded-By: 3333\n", True), ("", False),
    ],
)
def test_declared_old(spark, text, old):
    assert (one(spark, text, D.declared_old) is not None) == old


def test_names(spark):
    assert one(spark, "docs/2024-05-17-spec", D.dates) == [datetime.date(2024, 5, 17)] and one(spark, "a-2024-02-30", D.dates) == [] and one(spark, "x-2024-05", D.dates) == [datetime.date(2024, 5, 1)]
    names = ["spec-v1.2", "spec-v1.10", "spec-2.0-rc1", "spec-2.0", "0001-use"]
    rows = spark.createDataFrame([(n,) for n in names], "x string").select("x", D.version(F.col("x")).alias("v")).where("v is not null").orderBy("v").collect()
    assert [r.x for r in rows] == ["spec-v1.2", "spec-v1.10", "spec-2.0-rc1", "spec-2.0"]
    assert one(spark, "infra-database-backups-bucket", D.age_words) == [] and one(spark, "spec-old", D.age_words) == ["old"]
    assert {one(spark, p, D.family_of) for p in ("docs/spec-v2.md", "docs/archive/spec.md", "docs/2024-05/spec.md")} == {"docs/spec"}
    assert one(spark, "0001-use-postgres.md", D.family_of) != one(spark, "0002-use-redis.md", D.family_of)


def test_survey(spark):
    t = datetime.datetime(2026, 1, 1)
    rows = [("docs/spec-v1.md", "# The spec\n", t), ("docs/spec-v2.md", "# The spec\n", t), ("docs/old/spec-v3.md", "x", t), ("a/note.md", "", t), ("a/note-copy.md", "", t)]
    got = {r.path: (r.family, r.newest, r.is_spec) for r in D.survey(spark.createDataFrame(rows, "path string, text string, last_commit timestamp")).collect()}
    assert got["docs/spec-v1.md"] == ("docs/spec", "docs/spec-v2.md", True) and got["a/note.md"][1] is None


def test_snapshots(spark):
    docs = spark.createDataFrame([("d", "# One\n\nThe *value* is\nkept for `30` days.\n\nother\n\nThe value is kept for 30 days.\n")], "doc string, text string")
    snips = spark.createDataFrame([("d", 1, "the value is kept for 30 days"), ("d", 9, "The value is kept for 30 days."), ("d", 1, "gone from here"), ("e", 1, "x")], "doc string, line int, text string")
    got = {(r.doc, r.line, r.text[:4]): r.found_line for r in D.find_snapshots(docs, snips).collect()}
    assert got == {("d", 1, "the "): 3, ("d", 9, "The "): 8, ("d", 1, "gone"): None, ("e", 1, "x"): None}


def test_settings_redaction(spark):
    text = "db:\n  user: ann\n  password: hunter2\n  token: ${TOKEN}\nprivate_key: |\n  line1\n  line2\nnext: 1\n"
    assert one(spark, text, redact.redact_settings) == "db:\n  user: ann\n  password: <redacted>\n  token: ${TOKEN}\nprivate_key: <redacted>\nnext: 1\n"


def test_runs(spark):
    at = lambda s: datetime.datetime(2026, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=s)
    jobs = spark.createDataFrame(
        [(1, "t (a)", "failure", at(100)), (1, "t (b)", "cancelled", at(110)), (1, "t (c)", "cancelled", at(900)), (1, "u", "cancelled", at(101)), (1, "t (d)", "cancelled", None), (2, "v", "cancelled", at(1)), (2, "w", "success", at(1))],
        "run int, name string, conclusion string, completed_at timestamp",
    )
    assert {(r.run, r.name) for r in runs.to_triage(jobs).collect()} == {(1, "t (a)"), (2, "v")}
    assert {r.name: r.by_fail_fast for r in runs.cancelled_jobs(jobs.where("run = 1")).collect()} == {"t (b)": True, "t (c)": False, "u": False, "t (d)": True}
    steps = spark.createDataFrame([(1, "t (b)", "s", "success"), (1, "u", "s", "success"), (1, "t (c)", "s", "failure")], "run int, job string, step string, conclusion string")
    failed = spark.createDataFrame([(1, "t (a)", "s"), (1, "x", "s")], "run int, job string, step string")
    assert {r.job: r.passed_in for r in runs.passed_in(failed, steps).collect()} == {"t (a)": ["t (b)"], "x": []}
    mine = spark.createDataFrame([(1, "s1", at(50)), (2, "s9", at(5))], "run int, sha string, created_at timestamp")
    past = spark.createDataFrame([(10, "s0", at(10), "push", True), (11, "s1", at(40), "push", True), (12, "s2", at(45), "pull_request", True), (13, "s3", at(60), "push", True)], "past int, sha string, created_at timestamp, event string, own boolean")
    done = spark.createDataFrame([(10, "j", "success"), (10, "k", "failure"), (10, "l", "cancelled"), (11, "j", "failure")], "past int, job string, conclusion string")
    assert {(r.run, r.job): r.passed_before for r in runs.default_branch_record(mine, past, done).collect()} == {(1, "j"): True, (1, "k"): False, (1, "l"): None}


def test_cancelled_jobs_against_brute_force(spark):
    r, at = random.Random(5), lambda s: None if s is None else datetime.datetime(1970, 1, 1, 0, 0, 0, 999, datetime.timezone.utc) + datetime.timedelta(seconds=s)
    rows = [(i % 5, r.choice("tu") + f" ({i})", r.choice(["failure", "timed_out", "cancelled", "cancelled", "success", None]), r.choice([None, r.randint(-9000, 9000)])) for i in range(400)]
    rows += [(9, "e (0)", "failure", 0)] + [(9, f"e ({d})", "cancelled", d) for d in (-306, -305, -6, -5, 0, 300, 301, 305, 306)] + [(8, "n (a)", "timed_out", None), (8, "n (b)", "cancelled", 7), (8, "m", "cancelled", None)]

    def near(run, name, end):
        ends = [e for k, n, c, e in rows if k == run and n.split(" (")[0] == name.split(" (")[0] and c in ("failure", "timed_out")]
        known = [e for e in ends if e is not None]
        return bool(ends) and (end is None or not known or any(-5 <= end - e <= 300 for e in known))

    got = runs.cancelled_jobs(spark.createDataFrame([(*x[:3], at(x[3])) for x in rows], "run int, name string, conclusion string, completed_at timestamp"))
    assert sorted(map(tuple, got.collect())) == sorted((k, n, near(k, n, e)) for k, n, c, e in rows if c == "cancelled")
    # no row carries the ends of all its matrix's failures
    assert "collect_set" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "collect_list" not in plan


def test_outside(spark):
    named = spark.createDataFrame([("src\\App.py",), ("tmp/case/x.py",), ("lib/sub/y.c",)], "path string")
    project = spark.createDataFrame([("svc/src/app.py",)], "path string")
    subs = spark.createDataFrame([("lib",)], "folder string")
    assert [r.path for r in runs.outside_project(named, project, subs).collect()] == ["tmp/case/x.py"]
    assert runs.outside_project(named, project).count() == 2
