import re

from siftwell.operators import pairing
from siftwell.plans import catalog


def _fits(a, b):
    return a == b or a.endswith("/" + b) or b.endswith("/" + a)


def test_suffixes_against_brute_force(spark):
    paths = ["", "/", "a", "a/", "b/a", "c/b/a", "ba", "/a", "x//a", "a/b", "/b/a", "a/b/", "b/", "日/a"]
    a = spark.createDataFrame([*enumerate(paths), (90, None), (91, "b/a")], "id int, named_path string")
    b = spark.createDataFrame([(p,) for p in [*paths, None, "a"]], "known_path string")
    got = sorted((r.id, r.named_path, r.known_path) for r in pairing.by_suffix(a, b).collect())
    assert got == sorted((i, p, k) for i, p in [*enumerate(paths), (91, "b/a")] for k in [*paths, "a"] if _fits(p, k))


def test_all_pages_against_brute_force(spark, sf_dir):
    rows = [(r.page_id, re.sub("^https?://[^/]*/", "", r.url)) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    known = {re.sub("[?#].*$", "", p, flags=re.S) for _, p in rows}
    want = sorted((i, k) for i, p in rows for k in known if _fits(p, k))
    assert sorted(map(tuple, catalog.pages_by_suffix_all(spark, sf_dir).collect())) == want


def test_known_paths_of_any_page(spark, tmp_path):
    rows = [(1, "https://a.org/en/5"), (2, "http://b.org/x/en/5?p=1"), (4, "https://c.org/x/en/5"), (5, "https://d.org/fr/7/")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, catalog.pages_by_suffix_all(spark, str(tmp_path)).collect()))
    assert got == [(1, "en/5"), (1, "x/en/5"), (4, "en/5"), (4, "x/en/5"), (5, "fr/7/")]


def test_scores_that_differ_by_the_order_of_sums_are_ties(spark):
    # each text has one word of every frequency, so all weigh alike; the words come in another order in each
    texts = [(i, [f"{f}-{(i * (2 * f + 1) + f) % 20}" for f in range(12)]) for i in range(40)]
    fill = [(10**6 * f + 1000 * j + k + 10**7, [f"{f}-{j}"]) for f in range(12) for j in range(20) for k in range(3 * f + 10 - sum(f"{f}-{j}" in w for _, w in texts))]
    t = spark.createDataFrame(texts + fill, "id long, words array<string>")
    q = spark.createDataFrame([(7, [f"{f}-{j}" for f in range(12) for j in range(20)])], "q long, words array<string>")
    got = pairing.word_overlap(q, "q", t, "id", most=10).collect()
    assert sorted((r.place, r.id) for r in got) == [(i + 1, i) for i in range(10)]


def test_files_of_one_path_all_meet_a_rule_once(spark):
    rows = [(1, "a/x.py"), (2, "a/x.py"), (2, "a/x.py"), (3, "a/test.py"), (4, "b.go"), (5, None)]
    files = spark.createDataFrame(rows, "id long, path string")
    rules = spark.createDataFrame([("two", ["**/*.py", "a/*", "*x*", "!*test*"]), ("twice", ["*.go"]), ("twice", ["b*"]), ("all", ["!*.go"])], "rule string, scope array<string>")
    got = pairing.in_scope(files, rules).select("rule", "id", "path").collect()
    x = rows[:3]
    assert sorted(map(tuple, got)) == sorted([("two", *r) for r in x] + [("twice", 4, "b.go")] + [("all", *r) for r in rows[:4]])


def test_pages_of_one_url_all_count(spark, tmp_path):
    spark.createDataFrame([(3, "http://a.example.com/en/1"), (2, "http://a.example.com/en/1"), (2, "http://a.example.com/en/1")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {tuple(r) for r in catalog.rules_in_scope(spark, str(tmp_path)).collect()} == {("news", 3, 2), ("english", 3, 2)}
