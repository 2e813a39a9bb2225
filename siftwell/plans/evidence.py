"""Queries of the operators for paths, names, versions, containment and shares of room, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.operators import budget, changes, closure, history, matching, merging, runs
from siftwell.tables import dealt, tasks_for

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# ---------------------------------------------------------------- paths and versions


@query("""
WITH RECURSIVE o AS (
  SELECT o_orderkey AS node, o_orderpriority AS p, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders
), up(node, root, depth, prefix) AS (
  SELECT node, node, 0, '' FROM o WHERE parent IS NULL AND node IN (SELECT parent FROM o)
  UNION ALL
  SELECT o.node, up.root, up.depth + 1, up.prefix || '/' || o.p FROM up JOIN o ON o.parent = up.node
)
SELECT node, root, depth, prefix FROM up
""")
def mounted_orders(spark, sf_dir):
    """Path closure by doubling: each order hangs below the customer's order before it; the path above every one."""
    along = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    edges = dealt(orders, tasks_for(orders, F.lit(64)), "o_custkey").select(F.lag("o_orderkey").over(along).alias("parent"), F.col("o_orderkey").alias("child"), F.concat(F.lit("/"), "o_orderpriority").alias("prefix"))
    return closure.prefixes_above(edges)


@query("""
WITH RECURSIVE e AS (
  SELECT event_id, user_id, event_type, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events
), r AS (
  SELECT user_id || '/' || (k - 1) AS old, user_id || '/' || k AS new FROM e WHERE event_type = 'signup'
), w(name, now) AS (
  SELECT old, new FROM r UNION ALL SELECT w.name, r.new FROM w JOIN r ON r.old = w.now
), f AS (
  SELECT name, now FROM w WHERE now NOT IN (SELECT old FROM r)
)
SELECT coalesce(f.now, e.user_id || '/' || e.k) AS path, max(event_id) AS last, count(*) AS n FROM e LEFT JOIN f ON f.name = e.user_id || '/' || e.k GROUP BY 1
""")
def last_commit_by_path(spark, sf_dir):
    """Last commit by path, renames followed: each user is a file that events touch and sign-ups rename."""
    along = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("k", F.sum((F.col("event_type") == "signup").cast("long")).over(along))
    name = lambda k: F.concat_ws("/", F.col("user_id").cast("string"), k.cast("string"))
    renames = e.where("event_type = 'signup'").select(name(F.col("k") - 1).alias("old"), name(F.col("k")).alias("new"))
    return history.last_commits(e.select(name(F.col("k")).alias("path"), F.col("event_id").alias("at")), renames)


_VERSIONS = """
a AS (SELECT url AS path, max(coalesce(html, '')) AS text FROM pages WHERE url IS NOT NULL GROUP BY url),
b AS (SELECT path, text || CASE WHEN length(text) % 7 = 1 THEN '<!-- new -->' ELSE '' END AS text FROM a WHERE length(text) % 7 <> 0 UNION ALL SELECT path || '/new', text FROM a WHERE length(text) % 7 = 2)
"""


@query(f"""
WITH {_VERSIONS}
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS state
FROM a FULL JOIN b ON a.path = b.path WHERE a.text IS DISTINCT FROM b.text
""")
def changed_pages(spark, sf_dir):
    """Incremental re-index: pages added, changed or removed between two versions of the crawl."""
    return history.changed_files(*[history.snapshot(v) for v in _versions(spark, sf_dir)])


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "pages").where("url is not null").groupBy(F.col("url").alias("path")).agg(F.max(F.coalesce("html", F.lit(""))).alias("text"))
    m = F.length("text") % 7
    b = a.where(m != 0).select("path", F.concat("text", F.when(m == 1, "<!-- new -->").otherwise("")).alias("text"))
    return a, b.unionByName(a.where(m == 2).select(F.concat("path", F.lit("/new")).alias("path"), "text"))


@query(f"WITH {_VERSIONS} SELECT path, (length(text) - length(replace(text, '<', ''))) AS n_tags FROM b")
def refreshed_page_index(spark, sf_dir):
    """An index of pages kept up to date: only pages that were added or changed are parsed again."""
    a, b = _versions(spark, sf_dir)
    parse = lambda files: files.select("path", (F.length("text") - F.length(F.replace("text", F.lit("<"), F.lit("")))).cast("long").alias("n_tags"))
    diff = history.changed_files(history.snapshot(a), history.snapshot(b))
    return history.refreshed(parse(a), diff, parse(b.join(diff.where("state <> 'removed'").select("path"), "path", "left_semi")))


# ---------------------------------------------------------------- names and containment


@query("""
WITH w AS (SELECT DISTINCT left(p_name, p_size % length(p_name)) || CASE p_size % 3 WHEN 0 THEN 'q' WHEN 1 THEN '' ELSE 'zz' END || substr(p_name, p_size % length(p_name) + 2) AS wanted FROM part),
n AS (SELECT DISTINCT p_name AS name FROM part),
d AS (SELECT wanted, name, cast(levenshtein(wanted, name) AS INT) AS distance FROM w, n WHERE levenshtein(wanted, name) <= 2)
SELECT * FROM (SELECT wanted, name, distance, cast(row_number() OVER (PARTITION BY wanted ORDER BY distance, name) AS INT) AS place FROM d) WHERE place <= 3
""")
def close_part_names(spark, sf_dir):
    """Suggestions for names that name nothing: part names with a letter changed, lost or doubled, and the three nearest real ones."""
    p = table(spark, sf_dir, "part").select("p_name", (F.col("p_size") % F.length("p_name")).alias("i"), "p_size")
    new = F.when(F.col("p_size") % 3 == 0, "q").when(F.col("p_size") % 3 == 1, "").otherwise("zz")
    wanted = p.select(F.concat(F.expr("left(p_name, i)"), new, F.expr("substring(p_name, i + 2)")).alias("wanted"))
    return matching.close_names(wanted, p.select(F.col("p_name").alias("name")))


@query(r"""
WITH s AS (SELECT item_id, unnest(list_filter(string_split_regex(text, '\n'), lambda x: length(x) > 0)) AS line FROM benchmark)
SELECT DISTINCT s.item_id || ':' || s.line AS needle_id, d.doc_id FROM s JOIN documents d ON contains(d.text, s.line)
""")
def lines_in_documents(spark, sf_dir):
    """Containment join: lines of benchmark items that stand in a document, wherever they begin."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.filter(F.split("text", "\n", -1), lambda x: x != "")).alias("needle"))
    return matching.contained(b.withColumn("needle_id", F.concat_ws(":", F.col("item_id").cast("string"), "needle")), "needle_id", table(spark, sf_dir, "documents"), "doc_id")


_KEYS = """
k AS (SELECT doc_id, list_transform(range(6), lambda i: sha256(doc_id || ':' || i)) AS rows FROM documents WHERE doc_id % 50 = 0),
t AS (
  SELECT d.doc_id, coalesce(d.text, '') || CASE WHEN k.doc_id IS NOT NULL THEN chr(10) || '-----BEGIN PRIVATE KEY-----' || chr(10) || array_to_string(k.rows, chr(10)) || chr(10) || '-----END PRIVATE KEY-----' ELSE '' END
    || CASE WHEN m.doc_id IS NOT NULL THEN ' moved=' || substr(m.rows[3], 6, 40) || m.rows[4] || ' ' || substr(m.rows[5], 17, 20) ELSE '' END AS text
  FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN k m ON m.doc_id = d.doc_id - 7
)
"""


@query(f"""
WITH {_KEYS},
p AS (SELECT DISTINCT substr(r, i, 16) AS piece FROM (SELECT unnest(rows) AS r FROM k), (SELECT unnest([1, 17, 33, 49]) AS i))
SELECT t.doc_id, p.piece FROM t JOIN p ON contains(t.text, p.piece)
""")
def moved_key_material(spark, sf_dir):
    """Pieces of private keys anywhere in the texts: keys planted in every fiftieth document, parts of them moved to another."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = lambda c: [F.sha2(F.concat(c.cast("string"), F.lit(f":{i}")).cast("binary"), 256) for i in range(6)]
    key, moved = rows(F.col("doc_id")), rows(F.col("doc_id") - 7)
    has = F.col("doc_id") % 50 == 0
    # parts move only from documents that exist
    giver = docs.where(has).select((F.col("doc_id") + 7).alias("doc_id"), F.lit(True).alias("_gets"))
    planted = F.when(has, F.concat(F.lit("\n-----BEGIN PRIVATE KEY-----\n"), F.concat_ws("\n", *key), F.lit("\n-----END PRIVATE KEY-----"))).otherwise("")
    parts = F.when(F.col("_gets"), F.concat(F.lit(" moved="), F.substring(moved[2], 6, 40), moved[3], F.lit(" "), F.substring(moved[4], 17, 20))).otherwise("")
    # the ids are the side that is held, so texts stream past and are not sorted
    texts = docs.join(giver.hint("shuffle_hash"), "doc_id", "left").select("doc_id", F.concat("text", planted, parts).alias("text"))
    return matching.key_material(texts, "doc_id", matching.key_pieces(texts))


# ---------------------------------------------------------------- budgets


@query("""
WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f(conv_id, i, room, turn, kept) AS (
  SELECT conv_id, i, CASE WHEN s <= 1500 THEN 1500 - s ELSE 1500 END, turn, s <= 1500 FROM t WHERE i = 1
  UNION ALL
  SELECT t.conv_id, t.i, CASE WHEN s <= f.room THEN f.room - s ELSE f.room END, t.turn, s <= f.room FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1
)
SELECT conv_id, turn FROM f WHERE kept
""")
def turns_that_fit(spark, sf_dir):
    """Greedy budget: turns in order within 1,500 characters, passing over those that don't fit."""
    return budget.passing_over(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn")], F.length("text"), 1500).select("conv_id", "turn")


@query("""
WITH t AS (SELECT conv_id, turn, length(text) AS s FROM conversations),
g AS (SELECT conv_id, list_sort(list(s)) AS a FROM t GROUP BY conv_id),
c AS (SELECT conv_id, k, a[k] AS s, floor((2000 - list_sum(list_concat([0], a[:k - 1]))) / (len(a) - k + 1)) AS level FROM (SELECT conv_id, a, unnest(range(1, len(a) + 1)) AS k FROM g)),
l AS (SELECT conv_id, min_by(level, k) FILTER (WHERE s > level) AS level FROM c GROUP BY conv_id)
SELECT t.conv_id, t.turn, cast(least(t.s, coalesce(l.level, t.s)) AS BIGINT) AS share FROM t JOIN l ON l.conv_id = t.conv_id
""")
def fair_room(spark, sf_dir):
    """Max-min fair shares: 2,000 characters of each conversation dealt to its turns, none less than another but by need."""
    return budget.fair_shares(table(spark, sf_dir, "conversations"), ["conv_id"], F.length("text"), 2000).select("conv_id", "turn", "share")


# ---------------------------------------------------------------- runs

_JOBS = """
j AS (
  SELECT event_id, user_id % 40 AS run, CASE WHEN event_id % 2 = 0 THEN 'build' ELSE 'test' END AS base, event_id % 3 AS variant, 's' || (event_id % 5) AS step,
    CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'timed_out' WHEN 'purchase' THEN 'cancelled' ELSE 'success' END AS conclusion, ts AS completed_at
  FROM events
), jobs AS (SELECT *, base || ' (' || variant || ')' AS name FROM j)
"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs of runs: a matrix of builds and tests, each with an end and a conclusion."""
    kinds = F.create_map(*[F.lit(x) for x in ("error", "failure", "signup", "timed_out", "purchase", "cancelled")])
    base = F.when(F.col("event_id") % 2 == 0, "build").otherwise("test")
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 40).alias("run"), F.concat(base, F.lit(" ("), (F.col("event_id") % 3).cast("string"), F.lit(")")).alias("name"),
        F.concat(F.lit("s"), (F.col("event_id") % 5).cast("string")).alias("step"), F.coalesce(kinds[F.col("event_type")], F.lit("success")).alias("conclusion"), F.col("ts").cast("timestamp").alias("completed_at"),
    )


@query(f"""
WITH {_JOBS}
SELECT event_id, name, conclusion FROM (SELECT *, bool_or(conclusion IN ('failure', 'timed_out')) OVER (PARTITION BY event_id // 3) AS any_failed FROM jobs)
WHERE conclusion IN ('failure', 'timed_out') OR (NOT any_failed AND conclusion = 'cancelled')
""")
def jobs_to_triage(spark, sf_dir):
    """Which jobs of each run are looked into: failed ones, else the cancelled."""
    rows = _jobs(spark, sf_dir).withColumn("run", F.floor(F.col("event_id") / 3))  # three jobs a run, so that some have no failure
    return runs.to_triage(rows).select("event_id", "name", "conclusion")


@query(f"""
WITH {_JOBS},
e AS (SELECT *, cast(floor(epoch(completed_at)) AS BIGINT) AS t FROM jobs)
SELECT run, name, EXISTS (SELECT 1 FROM e f WHERE f.run = e.run AND f.base = e.base AND f.conclusion IN ('failure', 'timed_out') AND e.t - f.t BETWEEN -5 AND 300) AS by_fail_fast
FROM e WHERE conclusion = 'cancelled'
""")
def cancelled_by_a_failure(spark, sf_dir):
    """Interval join of ends: jobs that were cancelled from 5 seconds before to 300 after a failure of their matrix."""
    return runs.cancelled_jobs(_jobs(spark, sf_dir))


@query(f"""
WITH {_JOBS},
f AS (SELECT DISTINCT run, base, name, step FROM jobs WHERE conclusion = 'failure'),
p AS (SELECT DISTINCT run, base, name, step FROM jobs WHERE conclusion = 'success')
SELECT f.run, f.name AS job, f.step, coalesce(string_agg(p.name, ',' ORDER BY p.name), '') AS passed_in
FROM f LEFT JOIN p ON p.run = f.run AND p.base = f.base AND p.step = f.step AND p.name <> f.name GROUP BY ALL
""")
def steps_passed_elsewhere(spark, sf_dir):
    """For each failed step, the jobs of its matrix in which it passed."""
    steps = _jobs(spark, sf_dir).select("run", F.col("name").alias("job"), "step", "conclusion").distinct()
    out = runs.passed_in(steps.where("conclusion = 'failure'").drop("conclusion"), steps)
    return out.withColumn("passed_in", F.array_join("passed_in", ","))


# ---------------------------------------------------------------- changes


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a change: a file a turn, whose role is replaced by the lines of its text."""
    path = F.concat(F.lit("t"), F.col("turn").cast("string"), F.lit(".txt"))
    n = F.size(F.split("text", "\n", -1)).cast("string")
    part = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1,1 +1,"), n, F.lit(" @@\n-"), "role", F.lit("\n+"), F.replace("text", F.lit("\n"), F.lit("\n+")), F.lit("\n"))
    per = table(spark, sf_dir, "conversations").where("text is not null").groupBy(F.col("conv_id").cast("string").alias("change_id")).agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("x"))
    return per.select("change_id", F.array_join("x.p", "").alias("diff"))


@query(r"""
WITH l AS (SELECT cast(conv_id AS VARCHAR) AS change_id, 't' || turn || '.txt' AS path, role, string_split(text, chr(10)) AS ls FROM conversations WHERE text IS NOT NULL)
SELECT change_id, path, '-' AS sign, 1 AS line_no, role AS line FROM l
UNION ALL
SELECT change_id, path, '+', cast(i AS INT), ls[i] FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l)
""")
def changed_lines(spark, sf_dir):
    """Diffs by line: the lines that each turn adds and the one it removes, with their numbers."""
    return changes.diff_lines(changes.sections(_diffs(spark, sf_dir)))


@query(r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
    4 * length('t' || turn || '.txt') + length('diff --git a/ b/--- a/+++ b/@@ -1,1 +1, @@-+') + 6 + length(cast(len(string_split(text, chr(10))) AS VARCHAR)) + length(role) + length(text) + length(text) - length(replace(text, chr(10), '')) AS s
  FROM conversations WHERE text IS NOT NULL
), f(conv_id, i, turn, s, room, kept) AS (
  SELECT conv_id, i, turn, s, CASE WHEN s <= 5000 THEN 5000 - s ELSE 5000 END, s <= 5000 FROM t WHERE i = 1
  UNION ALL
  SELECT t.conv_id, t.i, t.turn, t.s, CASE WHEN t.s <= f.room THEN f.room - t.s ELSE f.room END, t.s <= f.room FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1
)
SELECT cast(conv_id AS VARCHAR) AS change_id, 't' || turn || '.txt' AS path, cast(s AS INT) AS n_chars FROM f WHERE kept
""")
def change_budget(spark, sf_dir):
    """The files of each change that fit 5,000 characters, passing over those that don't."""
    secs = changes.sections(_diffs(spark, sf_dir))
    none = secs.select("change_id", "path").where("false")
    return changes.within_budget(secs, none).select("change_id", "path", F.length("section").alias("n_chars"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def most_paired_places(spark, sf_dir):
    """Health of a map: the five places that most results are paired with."""
    return merging.health(table(spark, sf_dir, "documents").withColumn("label", F.lit("ok")), "source")[1]
