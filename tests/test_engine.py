import datetime

import pytest
from pyspark.sql import functions as F

from siftwell import schemas
from siftwell.functions import gates
from siftwell.operators import merging, pairing
from siftwell.plans import engine


def gate(spark, family, choice, confidence, noul=0.0, cause=None):
    df = spark.createDataFrame([((choice, confidence, noul, cause),)], f"a {schemas.ANSWER}")
    return df.select(engine.FAMILIES[family].gate(F.col("a"))["action"].alias("x")).first().x


@pytest.mark.parametrize(
    "family,choice,confidence,noul,want",
    [
        ("drift", "drifted", 0.90, 0, "review"), ("drift", "drifted", 0.91, 0, "act"), ("drift", "accurate", 0.98, 0, "review"), ("drift", "accurate", 0.99, 0, "clean"),
        ("drift", "accurate", 0.99, 0.70, "review"), ("drift", "unrelated", 0.99, 0, "unverifiable"), ("drift", None, 0.99, 0, "error"), ("drift", "accurate", float("nan"), 0, "error"),
        ("audit", "not_applicable", 0.5, 0.29, "na"), ("audit", "not_applicable", 0.99, 0.30, "review"), ("audit", "follows", 0.91, 0.29, "clean"), ("audit", "breaks", 0.91, 0, "act"),
        ("doc", "stale_behaviour", 0.91, 0, "act"), ("doc", "cannot_tell", 0.99, 0, "unverifiable"), ("doc", "too_general", 0.2, 0.1, "na"),
        ("change", "not_shown", 0.90, 0, "review"), ("change", "implemented", 0.91, 0.2, "clean"),
    ],
)
def test_gates(spark, family, choice, confidence, noul, want):
    assert gate(spark, family, choice, confidence, float(noul)) == want


def test_triage_answers_must_agree(spark):
    assert gate(spark, "triage", "the_change", 0.99, cause="environment") == "review"
    assert gate(spark, "triage", "the_change", 0.91, cause="change_broke_code") == "act"
    assert gate(spark, "triage", "not_the_change", 0.99, cause="change_broke_code") == "review"


def _scripted(spark, rows):
    """rows: (request_key, n) -> (choice, confidence, noul) or an error."""
    table = spark.createDataFrame([(k, n, None if isinstance(v, str) else (*v, None), v if isinstance(v, str) else None) for (k, n), v in rows.items()], schemas.ANSWERS)
    asked = []

    def score(requests, n):
        asked.append(sorted(r.request_key for r in requests.collect()))
        return requests.select("request_key").join(table.where(F.col("n") == n).drop("n"), "request_key")

    return score, asked


def test_screening(spark):
    answers = {("agree", n): ("accurate", 0.9, 0.1) for n in range(3)}
    answers |= {("low", 0): ("accurate", 0.9, 0.0), ("low", 1): ("accurate", 0.84, 0.0), ("low", 2): ("accurate", 0.9, 0.0)}
    answers |= {("abstain", n): ("not_enough_information", 0.9, 0.0) for n in range(3)}
    answers |= {("sure", 0): ("drifted", 0.99, 0.0), ("fails", 0): ("accurate", 0.9, 0.0), ("fails", 1): "timeout", ("fails", 2): ("accurate", 0.9, 0.0), ("bad", 0): "refused", ("nan", 0): ("accurate", float("nan"), 0.0)}
    keys = ["agree", "low", "abstain", "sure", "fails", "bad", "nan"]
    requests = spark.createDataFrame([(f"i{i}", k, "b", i) for i, k in enumerate([*keys, "sure"])], "item_id string, request_key string, body string, seq long")
    scorer, asked = _scripted(spark, answers)
    out, kept = engine.screen(requests, "drift", scorer)
    got = {(r.request_key, r.label) for r in out.collect()}
    assert got == {("agree", "ok"), ("low", "review"), ("abstain", "??"), ("sure", "DRIFT"), ("fails", "review"), ("bad", "not checked"), ("nan", "not checked")}
    assert out.count() == 8  # items asked alike share an answer
    assert all(set(a) <= {"agree", "low", "fails"} for a in asked[1:]) and any(asked[1:])
    cache = engine.merged_cache(spark.createDataFrame([], "request_key string, n int, answer " + schemas.ANSWER), kept)
    assert {r.request_key for r in cache.collect()} == {"agree", "low", "abstain", "sure", "fails"}
    again, asked = _scripted(spark, {})
    out, _ = engine.screen(requests.where("request_key in ('agree', 'sure')"), "drift", again, cache)
    assert {(r.request_key, r.label) for r in out.collect()} == {("agree", "ok"), ("sure", "DRIFT")} and not any(asked)


def test_unreadable(spark):
    df = spark.createDataFrame([(1, ("x", 0.5, 0.1, None)), (2, None), (3, (None, 0.5, 0.1, None)), (4, ("x", None, 0.1, None)), (5, ("x", 0.5, float("inf"), None))], f"i int, a {schemas.ANSWER}")
    got = {r.i: r.u is None for r in df.select("i", engine.unreadable(F.col("a")).alias("u")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert df.where("i = 1").select(engine.unreadable(F.col("a"), ["y"]).alias("u")).first().u is not None


def test_exit_codes(spark):
    df = spark.createDataFrame([("DRIFT",), ("ok",)], "label string")
    assert (engine.exit_code(df, "DRIFT"), engine.exit_code(df, "BREAKS"), engine.exit_code(df, "DRIFT", problems=1), engine.exit_code(df, "DRIFT", unusable=True)) == (1, 0, 2, 3)


def test_records_and_verdicts(spark):
    v = [("r", "f", str(i), "false_positive" if i < 3 else "confirmed", i) for i in range(5)] + [("q", "f", str(i), "false_positive", i) for i in range(4)] + [("r", "f", "0", "nonsense", 99), ("s", "f", "1", "false_positive", 1), ("s", "f", "1", "confirmed", 2)]
    verdicts = spark.createDataFrame(v, "rule string, file string, code_sha string, verdict string, seq long")
    assert {(r.rule, r.false_positives, r.verdicts, r.poor) for r in merging.rule_records(verdicts).collect()} == {("r", 3, 5, True), ("q", 4, 4, False), ("s", 0, 1, False)}
    results = spark.createDataFrame([("r", "f", "0", "BREAKS"), ("s", "f", "1", "review"), ("s", "f", "1", "ok"), ("t", "f", "1", "BREAKS")], "rule string, file string, code_sha string, label string")
    got = {(r.rule, r.label, r.recorded, r.poor_record) for r in merging.apply_verdicts(results, verdicts).collect()}
    assert got == {("r", "BREAKS", "false_positive", True), ("s", "review", "confirmed", False), ("s", "ok", None, False), ("t", "BREAKS", None, False)}


def test_labels_cover_every_action():
    for family, f in engine.FAMILIES.items():
        assert set(f.settled) | {"review"} == set(gates.LABELS[family])


def test_as_of_and_ranges(spark):
    t = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    left = spark.createDataFrame([(1, "a", t(5)), (2, "a", t(1)), (3, "b", t(9))], "id int, k string, ts timestamp")
    right = spark.createDataFrame([("a", t(3), 30, 1), ("a", t(5), 50, 2), ("c", t(1), 10, 3)], "k string, at timestamp, v int, tie int")
    assert {(r.id, r.last_value) for r in pairing.last_before(left, "ts", right, "at", ["k"], "v", "tie").collect()} == {(1, 50), (2, None), (3, None)}
    assert {(r.id, r.last_value) for r in pairing.last_before(left, "ts", right, "at", ["k"], "v", "tie", strict=True).collect()} == {(1, 30), (2, None), (3, None)}
    points = spark.createDataFrame([("f", i) for i in (1, 5, 64, 200)], "k string, p int")
    ranges = spark.createDataFrame([("f", 5, 64, "x"), ("f", 60, 300, "y"), ("g", 0, 999, "z")], "k string, a int, z int, name string")
    assert {(r.p, r.name) for r in pairing.in_range(points, "p", ranges, "a", "z", ["k"]).collect()} == {(5, "x"), (64, "x"), (64, "y"), (200, "y")}


def test_suffix_globs_routes_mounts(spark):
    a = spark.createDataFrame([("src/app.py",), ("lib/x.py",)], "named_path string")
    b = spark.createDataFrame([("svc/src/app.py",), ("other/bapp.py",)], "known_path string")
    assert [tuple(r) for r in pairing.by_suffix(a, b).collect()] == [("src/app.py", "svc/src/app.py")]
    files = spark.createDataFrame([("a.py",), ("x/b.py",), ("x/vendor/c.py",), ("d.go",)], "path string")
    rules = spark.createDataFrame([("py", ["**/*.py", "!**/vendor/*"]), ("x", ["x/*"]), ("all", [])], "rule string, scope array<string>")
    got = {(r.rule, r.path) for r in pairing.in_scope(files, rules).collect()}
    assert got == {("py", "a.py"), ("py", "x/b.py"), ("x", "x/b.py"), ("x", "x/vendor/c.py"), ("all", "a.py"), ("all", "x/b.py"), ("all", "x/vendor/c.py"), ("all", "d.go")}
    want = spark.createDataFrame([("GET", "/orders/123"), ("PUT", "/orders/9"), (None, "/v1/ping")], "verb string, path string")
    routes = spark.createDataFrame([("GET", "/orders/{id}"), ("ANY", "/orders/{id}"), ("GET", "/${api.version}/ping"), ("GET", "/orders/{id}/x")], "route_verb string, route_path string")
    assert {(r.path, r.route_verb) for r in pairing.by_route(want, routes).collect()} == {("/orders/123", "GET"), ("/orders/9", "ANY"), ("/v1/ping", "GET")}
    edges = spark.createDataFrame([("app", "api", "/api"), ("api", "v1", "/v1"), ("app", "v1", "/old"), ("x", "y", "/y"), ("y", "x", "/x")], "parent string, child string, prefix string")
    assert {(r.node, r.prefix) for r in pairing.mounted_prefixes(edges).collect()} == {("app", ""), ("api", "/api"), ("v1", "/api/v1"), ("v1", "/old")}


def test_contract_routes(spark):
    symbols = spark.createDataFrame(
        [("GET /a/{x}", "route", "app.py", 1, "GET"), ("listOrders", "function", "src/orders_controller.py", 5, None), ("listOrders", "function", "tests/test_controller.py", 1, None), ("ping", "function", "src/client_api.py", 1, None)],
        "name string, kind string, file string, line int, value string",
    )
    routes = spark.createDataFrame([("GET", "/a/{id}", "a"), ("GET", "/orders", "listOrders"), ("GET", "/orders/", "listOrders"), ("GET", "/ping", "ping")], "verb string, path string, operation_id string")
    assert [tuple(r) for r in pairing.contract_routes(routes, symbols).collect()] == [("GET", "/orders", "listOrders", "listOrders", "src/orders_controller.py")]


def test_reading_plan_against_one_running_sum(spark, monkeypatch):
    import random

    from siftwell.operators import budget

    r = random.Random(3)
    rows = [(i, r.choice(["DRIFT", "review", "??", "ok"]), r.choice([None, 0.1, 0.3, 0.3004, 0.9, r.random()]), "x" * r.randint(1, 40), r.choice("abcdef")) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label string, p double, body string, source string")
    part = lambda label, p: 0 if label == "DRIFT" else 1 if label == "review" and (p or 0) >= budget.REVIEW_LEAST else 2 if label == "??" else 3 if label == "review" else 4
    units = {}
    for i, label, p, body, source in rows:
        k = part(label, p)
        u = units.setdefault((k, source if k == 1 else f"#{i}"), [0.0, 0, []])
        units[(k, source if k == 1 else f"#{i}")] = [max(u[0], p or 0.0), u[1] + len(body), [*u[2], i]]
    for most in (0, 700, 3000, 10**6):
        total, want = 0, set()
        for (k, name), (p, size, ids) in sorted(units.items(), key=lambda x: (x[0][0], -x[1][0], x[0][1])):
            total += size
            want |= set(ids) if total <= most else set()
        assert {x.id for x in budget.reading_plan(df, "source", most).where("listed").collect()} == want
