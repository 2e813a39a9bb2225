"""Joins that pair things with what they are about: by name, route, glob, suffix, range and time.

Each is an equi-join on a derived key first and a condition after it, so that no pair of tables is
multiplied: routes meet by their number of segments, suffixes by their ends, ranges by bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import keys as K


def by_name(left: DataFrame, name: str, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, unpaired) of left and symbols(name, ...) by exact name; unpaired rows are listed, not lost."""
    named = symbols.withColumnRenamed("name", "_name")
    return left.join(named, F.col(name) == F.col("_name")).drop("_name"), left.join(named.select("_name"), F.col(name) == F.col("_name"), "left_anti")


def by_route(wanted: DataFrame, routes: DataFrame) -> DataFrame:
    """wanted(verb, path) joined with routes(route_verb, route_path): the same path, else the same but for parameters.

    A verb must agree exactly, or the route's is ANY; a null verb takes every route.
    """
    w = wanted.withColumn("_key", K.route_key(F.col("path"))).withColumn("_n", F.size(F.split("_key", "/")))
    r = routes.withColumn("_rkey", K.route_key(F.col("route_path"))).withColumn("_rn", F.size(F.split("_rkey", "/")))
    fits = F.forall(F.zip_with(F.split("_key", "/"), F.split("_rkey", "/"), lambda a, b: (a == b) | (a == "{}") | (b == "{}")), lambda x: x)
    met = w.join(r, F.col("_n") == F.col("_rn")).where(fits)
    best = Window.partitionBy("verb", "path")
    met = met.withColumn("_exact", F.max((F.col("_key") == F.col("_rkey")).cast("int")).over(best)).where((F.col("_exact") == 0) | (F.col("_key") == F.col("_rkey")))
    met = met.withColumn("_verb", F.max((F.upper("verb") == F.col("route_verb")).cast("int")).over(best))
    keep = F.col("verb").isNull() | (F.col("_verb") == 1) & (F.upper("verb") == F.col("route_verb")) | (F.col("_verb") == 0) & (F.col("route_verb") == "ANY")
    return met.where(keep).drop("_key", "_n", "_rkey", "_rn", "_exact", "_verb")


def in_scope(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files(path, ...) and rules(rule, scope): a rule meets the files that a glob of its scope names and no '!' glob excludes.

    Each row of files meets a rule once, at the first glob that fits, whatever rows share its path. The join is
    on the globs' fixed last extension where they have one; rules without globs meet all files.
    """

    def named(scope: Column) -> Column:
        return F.filter(scope, lambda g: ~g.startswith("!"))

    def tests(rule: Column) -> Column:
        """The globs of a row of rules, each with its extension and all exclusions."""
        skips = F.transform(F.filter(rule["scope"], lambda g: g.startswith("!")), lambda g: K.glob_pattern(F.substring(g, 2, 10_000)))
        globs = F.when(F.size(named(rule["scope"])) > 0, named(rule["scope"])).otherwise(F.array(F.lit("**/*")))
        return F.transform(globs, lambda g: F.struct(rule.alias("rule"), F.regexp_extract(g, r"\.([A-Za-z0-9]+)$", 1).alias("ext"), K.glob_pattern(g).alias("pattern"), skips.alias("skips")))

    per = rules.groupBy("rule").agg(F.collect_list(F.struct(*rules.columns)).alias("_rows"))
    globs = per.select(F.flatten(F.transform("_rows", tests)).alias("_tests"))
    globs = globs.select(F.posexplode("_tests").alias("_i", "_glob"), F.transform("_tests", lambda t: F.struct(t["pattern"].alias("pattern"), t["skips"].alias("skips"))).alias("_tests"))
    globs = globs.select("_glob.rule.*", F.col("_glob.ext").alias("_ext"), F.expr("slice(_tests, 1, _i)").alias("_before"), F.struct("_glob.pattern", "_glob.skips").alias("_glob"))
    ext = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    f = files.withColumn("_fext", F.explode(F.array_distinct(F.array(ext, F.lit("")))))
    fits = lambda t: f"path rlike {t}.pattern and not exists({t}.skips, s -> path rlike s)"
    met = f.join(globs, F.col("_fext") == F.col("_ext")).where(F.expr(f"{fits('_glob')} and not exists(_before, t -> {fits('t')})"))
    return met.drop("_glob", "_ext", "_before", "_fext")


def by_suffix(named: DataFrame, known: DataFrame) -> DataFrame:
    """named(named_path) and known(known_path): equal, or one ends with the other at a slash.

    Each side's ends meet the other's whole paths, so only pairs that fit are ever made.
    """

    def ends(path: str) -> Column:
        parts = F.split(path, "/")
        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).otherwise(F.array().cast("array<string>"))

    longer = named.withColumn("_end", F.explode(F.concat(F.array("named_path"), ends("named_path")))).join(known, F.col("_end") == F.col("known_path")).drop("_end")
    shorter = named.join(known.withColumn("_end", F.explode(ends("known_path"))), F.col("named_path") == F.col("_end")).drop("_end")
    return longer.union(shorter)


def in_range(points: DataFrame, at: str, ranges: DataFrame, start: str, end: str, keys: list[str], bin_size: int = 64) -> DataFrame:
    """Points and the ranges (ends included) that hold them, within equal keys.

    Ranges are dealt to bins of bin_size, so a point meets the ranges of its bin alone.
    """
    r = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(end) / bin_size))))
    p = points.withColumn("_bin", F.floor(F.col(at) / bin_size))
    return p.join(r, [*keys, "_bin"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_bin")


def last_before(left: DataFrame, at: str, right: DataFrame, right_at: str, keys: list[str], value: str, tie: str, strict: bool = False) -> DataFrame:
    """As-of join: each left row with right's last `value` at or before it (strictly before it with strict), null if there is none.

    Both sides are merged in time order, and the last value is carried along each key: one sort, no pairs.
    """
    l = left.withColumns({"_at": F.col(at), "_side": F.lit(0 if strict else 1), "_value": F.lit(None).cast(dict(right.dtypes)[value]), "_tie": F.lit(None).cast(dict(right.dtypes)[tie])})
    r = right.select(*keys, F.col(right_at).alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.col(value).alias("_value"), F.col(tie).alias("_tie"))
    own = [c for c in left.columns if c not in keys]
    r = r.withColumns({c: F.lit(None).cast(dict(left.dtypes)[c]) for c in own}).withColumn("_left", F.lit(False))
    both = l.withColumn("_left", F.lit(True)).unionByName(r)
    along = Window.partitionBy(*keys).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(~F.col("_left"), F.struct("_value")), ignorenulls=True).over(along)
    return both.withColumn("last_value", carried["_value"]).where("_left").select(*left.columns, "last_value")


def word_overlap(queries: DataFrame, query_id: str, texts: DataFrame, text_id: str, most: int = 3) -> DataFrame:
    """(query_id, text_id, score, place): texts that share the rarest words with each query, by an inverted index.

    queries and texts have an array column words of distinct words. A word in df texts weighs
    1 + 1 / (1 + df / 5). Sums in another order differ in their last digits, so scores rank by six decimals.
    """
    index = texts.select(text_id, F.explode("words").alias("word"))
    weight = index.groupBy("word").agg(F.count(F.lit(1)).alias("df")).select("word", (1 + 1 / (1 + F.col("df") / 5)).alias("weight"))
    asked = queries.select(query_id, F.explode("words").alias("word")).join(weight, "word")
    scores = asked.join(index, "word").groupBy(query_id, text_id).agg(F.sum("weight").alias("score"), F.count(F.lit(1)).alias("shared"))
    order = Window.partitionBy(query_id).orderBy(F.col("shared").desc(), F.round("score", 6).desc(), F.col(text_id).asc_nulls_last())
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def mounted_prefixes(edges: DataFrame, most: int = 64) -> DataFrame:
    """(node, prefix): the path above every node, along edges(parent, child, prefix); cycles are cut.

    Each round extends the paths by one edge; it ends when no path grows, or after `most` edges.
    """
    roots = edges.join(edges.select(F.col("child").alias("parent")).distinct(), "parent", "left_anti").select(F.col("parent").alias("node")).distinct()
    paths = roots.select("node", F.lit("").alias("prefix"), F.array("node").alias("seen"))
    out = paths
    for _ in range(most):
        step = edges.select("parent", "child", F.col("prefix").alias("_more"))
        paths = paths.join(step, F.col("node") == F.col("parent")).where(~F.array_contains("seen", F.col("child")))
        paths = paths.select(F.col("child").alias("node"), F.concat("prefix", "_more").alias("prefix"), F.concat("seen", F.array("child")).alias("seen"))
        if paths.isEmpty():
            break
        out = out.unionByName(paths)
    return out.select("node", "prefix")


def mentions_in(text: Column, words: Column) -> Column:
    """Those of the words that stand in the text."""
    return F.filter(words, lambda w: F.contains(text, w))


def contract_routes(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Routes of a contract, routes(verb, path, operation_id), that no code route serves and whose operation names a handler in symbols.

    The handler is a function outside tests and clients; the first by file and line wins, and the first contract entry of a verb and path.
    """
    served = symbols.where("kind = 'route'").select(F.col("value").alias("verb"), K.route_key(F.regexp_extract("name", " (.*)$", 1)).alias("_key"))
    free = routes.withColumn("_key", K.route_key(F.col("path"))).join(served, ["verb", "_key"], "left_anti")
    outside = F.lower("file").rlike(r"(^|/)(tests?|__tests__|clients?)(/|$)|(^|[/_.-])(test|spec|client)[^/]*$")
    handlers = symbols.where((F.col("kind") == "function") & ~outside & F.lower("file").rlike(r"controller|handler|route|api|view|endpoint|resource"))
    handlers = handlers.withColumn("operation_id", F.element_at(F.split("name", r"\."), -1)).groupBy("operation_id").agg(F.min(F.struct("file", "line", "name")).alias("h"))
    met = free.join(handlers, "operation_id")
    return met.groupBy("verb", "_key").agg(F.min(F.struct("path", "operation_id", "h")).alias("r")).select("verb", "r.path", "r.operation_id", F.col("r.h.name").alias("handler"), F.col("r.h.file").alias("file"))
