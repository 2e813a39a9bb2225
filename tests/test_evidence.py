import random

from pyspark.sql import functions as F

from siftwell import tables
from siftwell.operators import budget, closure, history, matching


def test_long_chains_cycles_and_several_parents(spark):
    chain = [(f"n{i}", f"n{i + 1}", f"/{i % 10}") for i in range(1000)]
    rest = [("a", "b", "/b"), ("a", "c", "/c"), ("b", "d", "/d"), ("c", "d", "/e"), ("x", "y", "/1"), ("y", "x", "/2"), ("y", "z", "/3"), ("d", "d", "/self"), (None, "q", ""), ("a", "b", "/b"), ("r", "s", None)]
    got = {(r.node, r.root, r.depth, r.prefix) for r in closure.prefixes_above(spark.createDataFrame(chain + rest, "parent string, child string, prefix string")).collect()}
    assert {g for g in got if g[1] == "n0"} == {(f"n{i}", "n0", i, "".join(f"/{j % 10}" for j in range(i))) for i in range(1001)}
    assert {g for g in got if g[1] != "n0"} == {("a", "a", 0, ""), ("b", "a", 1, "/b"), ("c", "a", 1, "/c"), ("d", "a", 2, "/b/d"), ("d", "a", 2, "/c/e"), ("r", "r", 0, ""), ("s", "r", 1, "")}
    # a cycle below a root is entered once
    loop = spark.createDataFrame([("r", "a", "/a"), ("a", "b", "/b"), ("b", "a", "/x"), ("b", "c", "/c")], "parent string, child string, prefix string")
    assert {(r.node, r.prefix) for r in closure.prefixes_above(loop).collect()} == {("r", ""), ("a", "/a"), ("b", "/a/b"), ("c", "/a/b/c")}
    assert closure.prefixes_above(loop.limit(0)).count() == 0


def test_paths_take_as_many_tasks_as_their_size_asks_for(spark, monkeypatch):
    edges = spark.createDataFrame([(c * 100 + i, c * 100 + i + 1, f"/{i}") for c in range(50) for i in range(20)], "parent long, child long, prefix string")
    want = {(c * 100 + i, c * 100, i, "".join(f"/{j}" for j in range(i))) for c in range(50) for i in range(21)}
    monkeypatch.setattr(tables, "TASK_BYTES", 10_000)
    got = closure.prefixes_above(edges)
    assert {(r.node, r.root, r.depth, r.prefix) for r in got.collect()} == want
    assert len(got.inputFiles()) > 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_newest_names(spark):
    rows = [(f"v{i}", f"v{i + 1}") for i in range(70)] + [("a", "b"), ("b", "a"), ("x", "x"), (None, "y"), ("p", "q"), ("p", "r")]
    got = {r.name: r.newest for r in closure.newest_names(spark.createDataFrame(rows, "old string, new string")).collect()}
    assert got == {f"v{i}": "v70" for i in range(70)} | {"p": "q"}


def test_containment_and_names(spark):
    texts = [(1, "the quick brown fox jumps"), (2, "a\nquick  brown"), (3, None), (4, ""), (5, "über alles und mehr"), (1, "the quick brown fox jumps")]
    needles = [("n1", "uick brown fo"), ("n2", "ck bro"), ("n3", "q"), ("n4", ""), ("n5", None), ("n6", "über"), ("n7", "nowhere to be found"), ("n8", "lles und m"), ("n9", "wn")]
    got = matching.contained(spark.createDataFrame(needles, "nid string, needle string"), "nid", spark.createDataFrame(texts, "tid long, text string"), "tid").collect()
    assert sorted((r.nid, r.tid) for r in got) == sorted({(n, t) for n, x in needles if x for t, y in texts if y and x in y})
    r = random.Random(4)
    names = ["".join(r.choices("abc", k=r.randint(0, 6))) for _ in range(60)] + [None]
    wanted = ["".join(r.choices("abcd", k=r.randint(1, 6))) for _ in range(30)] + [None]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {(w, n, d, i + 1) for w in set(wanted) - {None} for i, (d, n) in enumerate(sorted((distance(w, n), n) for n in set(names) - {None} if distance(w, n) <= 2)[:3])}
    got = matching.close_names(spark.createDataFrame([(w,) for w in wanted], "wanted string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert {(x.wanted, x.name, x.distance, x.place) for x in got} == want


def test_key_material_is_dealt_by_its_size_and_streams(spark, monkeypatch):
    r = random.Random(6)
    rand = lambda n: "".join(r.choices("ABCDEFabcdef0123456789+/=", k=n))
    key = [rand(40) for _ in range(30)]
    texts = [(i, f"{rand(i)} x{key[i % 30][3 : 3 + i % 40]} {key[i % 7]}{rand(5)}\n{key[i % 7]}") for i in range(90)] + [(90, None), (91, ""), (91, key[0]), (None, key[1])]
    pieces = {k[i : i + 16] for k in key for i in (0, 16, 24)}
    monkeypatch.setattr(tables, "TASK_BYTES", 10_000)
    got = matching.key_material(spark.createDataFrame(texts, "tid long, text string"), "tid", spark.createDataFrame([(p,) for p in [*pieces, "A" * 16]], "piece string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted({str((i, p)) for i, t in texts for p in pieces if t and p in t})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "REPARTITION_BY_NUM" in plan


def test_versions(spark):
    files = lambda rows: spark.createDataFrame(rows, "path string, text string")
    a, b = files([("same", "x"), ("gone", "y"), ("new text", "1"), (None, "z"), ("null", None)]), files([("same", "x"), ("new text", "2"), ("added", ""), ("null", "")])
    diff = history.changed_files(history.snapshot(a), history.snapshot(b))
    assert {(r.path, r.state) for r in diff.collect()} == {("gone", "removed"), ("new text", "changed"), ("added", "added")}
    index = lambda f: f.select("path", F.col("text").alias("seen"))
    got = history.refreshed(index(a.where("path is not null")), diff, index(b)).collect()
    assert {(r.path, r.seen) for r in got} == {("same", "x"), ("new text", "2"), ("added", ""), ("null", None)}


def test_shares_and_budgets(spark):
    r = random.Random(2)
    rows = [(g, i, r.choice([0, 3, 10, 50, 400])) for g in range(8) for i in range(r.randint(1, 9))] + [(99, 0, None)]
    df = spark.createDataFrame(rows, "g int, i int, s int")
    shares = {(x.g, x.i): x.share for x in budget.fair_shares(df, ["g"], F.col("s"), 100).collect()}
    kept = {(x.g, x.i) for x in budget.passing_over(df, ["g"], [F.col("i")], F.col("s"), 100).collect()}
    for g in {x[0] for x in rows}:
        own = [(i, s or 0) for k, i, s in rows if k == g]
        given, room, left = {}, 100, sorted(own, key=lambda x: x[1])
        while left:  # the smallest takes what it needs, at most an equal part of what is left
            i, s = left[0]
            if s > room // len(left):
                given |= {j: min(t, room // len(left)) for j, t in left}
                break
            given[i], room, left = s, room - s, left[1:]
        assert {i: shares[g, i] for i, _ in own} == given and sum(given.values()) <= 100
        room = 100
        for i, s in own:
            assert ((g, i) in kept) == (s <= room)
            room -= s if s <= room else 0
