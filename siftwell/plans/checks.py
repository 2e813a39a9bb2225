"""The checks that users run: each pairs things, builds requests, screens them and orders the results.

A preview is the requests alone; `save_snapshot` keeps them, and the check run on a snapshot asks
exactly what was previewed. The scorer is a parameter (see engine).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import gates
from siftwell.functions import keys as K
from siftwell.functions import redact as R
from siftwell.functions import text as T
from siftwell.operators import budget, changes, code, lines, logs, merging, pairing
from siftwell.plans import engine
from siftwell.tables import written

CODE_CHARS, RULE_CHARS, CONFIRM_ABOVE = 2600, 1200, 400
#: What is asked, by family: options of the verdict and the second opinion. Part of every request's key.
QUESTIONS = {
    "drift": ("accurate", "drifted", "unrelated", "not_enough_information", "value_mismatch"),
    "triage": ("the_change", "not_the_change", "not_enough_information", "cause"),
    "audit": ("follows", "breaks", "not_applicable", "not_enough_information", "breaks"),
    "doc": ("consistent", "stale_signature", "stale_behaviour", "too_general", "cannot_tell", "contradicted"),
    "change": ("implemented", "contradicted", "not_shown", "too_vague", "cannot_tell", "unsupported"),
}


def _requests(rows: DataFrame, family: str, item: Column, *state: Column) -> DataFrame:
    """rows with item_id, body and request_key; the state's fields keep the order given."""
    body = F.to_json(F.struct(*state, F.lit("|".join(QUESTIONS[family])).alias("questions")))
    return rows.withColumn("item_id", item).withColumn("body", body).withColumn("request_key", F.sha2(F.col("body").cast("binary"), 256)).withColumn("seq", F.xxhash64("item_id"))


# ---------------------------------------------------------------- spec drift


def claims(docs: DataFrame, symbols: DataFrame, routes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(claims, unpaired): requirement sentences of docs(doc, text) with the symbols that they name; those that name none are listed."""
    sents = lines.requirement_rows(docs, ["doc"]).where("not is_code").withColumn("claim_id", F.concat_ws(":", "doc", "line_no", F.substring(F.sha2(F.col("sentence").cast("binary"), 256), 1, 8)))
    sents = sents.withColumn("m", lines.mentions(F.col("sentence")))
    named = sents.select("claim_id", F.explode("m.names").alias("said")).distinct()
    bare = symbols.where("kind <> 'route'").withColumn("said", F.explode(F.array_distinct(F.array("name", F.element_at(F.split("name", r"\."), -1)))))
    config = symbols.where("kind = 'config'").withColumn("said", F.col("name")).withColumn("_k", K.config_key(F.col("name")))
    pairs = named.join(bare, "said").select("claim_id", "name", "kind", "file", "line", "source")
    relaxed = named.withColumn("_k", K.config_key(F.col("said"))).join(config.drop("said"), "_k").select("claim_id", "name", "kind", "file", "line", "source")
    by_path = sents.select("claim_id", F.explode(F.concat("m.routes", F.transform("m.paths", lambda p: F.concat(F.lit(" "), p)))).alias("r"))
    wanted = by_path.select("claim_id", F.nullif(F.regexp_extract("r", "^([A-Z]*) ", 1), F.lit("")).alias("verb"), F.regexp_extract("r", " (.*)$", 1).alias("path"))
    served = symbols.where("kind = 'route'").select(F.col("value").alias("route_verb"), F.regexp_extract("name", " (.*)$", 1).alias("route_path"), "name", "kind", "file", "line", "source")
    routed = pairing.by_route(wanted, served).select("claim_id", "name", "kind", "file", "line", "source")
    found = pairs.union(relaxed).union(routed).distinct().groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("file", "line", "name", "kind", "source"))).alias("symbols"))
    sents = sents.drop("m")
    return sents.join(found, "claim_id"), sents.join(found, "claim_id", "left_anti")


def relevant_slice(source: Column, words: Column, most: int = CODE_CHARS, reach: int = 2) -> Column:
    """Lines of source within `reach` lines of one that holds a word, gaps marked, cut to `most`; its beginning where none does."""

    def of(all_lines: Column, hits: Column) -> Column:
        near = lambda i: F.exists(F.slice(hits, F.greatest(F.lit(1), i + 1 - reach), F.lit(2 * reach + 1) + F.least(F.lit(0), i - reach)), lambda h: h)
        kept = F.array_join(F.transform(all_lines, lambda x, i: F.when(near(i), x).otherwise(F.lit("\u0001"))), "\n")
        kept = F.regexp_replace(F.regexp_replace(kept, F.lit("(\u0001\n?)+"), F.lit("...\n")), F.lit("\n$"), F.lit(""))
        return F.when(F.exists(hits, lambda h: h), F.substring(kept, 1, most)).otherwise(F.substring(source, 1, most))

    found = lambda ls: T.let(F.transform(ls, lambda x: F.exists(words, lambda w: F.contains(x, w))), lambda hits: of(ls, hits))
    return F.when(F.length(source) <= most, source).otherwise(T.let(T.lines(source), found))


def drift_requests(claim_rows: DataFrame) -> DataFrame:
    """Requests of claims: the sentence and what its symbols' code says, redacted, with sums done."""

    @F.pandas_udf("string")
    def sums(texts):
        return texts.map(lambda t: "\n".join(code.arithmetic(t or "")))

    src = R.redact(F.array_join(F.transform("symbols", lambda s: F.concat(F.lit("# "), s["file"], F.lit(":"), s["line"].cast("string"), F.lit("\n"), s["source"])), "\n\n"))
    words = F.filter(F.split("sentence", r"[^A-Za-z0-9_]+"), lambda w: F.length(w) > 3)
    rows = claim_rows.withColumn("_src", src).withColumn("sums", sums("_src")).withColumn("code", relevant_slice(F.col("_src"), words)).drop("_src")
    return _requests(rows, "drift", F.col("claim_id"), F.col("sums").alias("a_sums"), F.col("code").alias("b_code"), F.substring("sentence", 1, 400).alias("c_sentence"))


def preflight(requests: DataFrame) -> DataFrame:
    """requests with hints: why an answer is likely to be unknown."""
    s = F.col("sentence")
    hints = F.array_compact(F.array(
        F.when(s.rlike(r"(?i)\b(?:never|no|none|nothing|nowhere)\b"), "says that something never happens"),
        F.when(s.endswith(":"), "ends where a list begins"),
        F.when(F.length("code") >= CODE_CHARS, "the paired code is cut"),
    ))
    return requests.withColumn("hints", hints)


def touching(claim_rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Claims with code in a changed(path)."""
    files = claim_rows.select("claim_id", F.explode("symbols.file").alias("path")).join(changed.select("path"), "path", "left_semi").select("claim_id").distinct()
    return claim_rows.join(files, "claim_id", "left_semi")


def check_spec_drift(docs: DataFrame, symbols: DataFrame, scorer: engine.Scorer, changed: DataFrame | None = None, cache: DataFrame | None = None) -> DataFrame:
    """Is each requirement still true of the code? Results in reading order, with the place that they point to."""
    found, _ = claims(docs, symbols)
    requests = drift_requests(touching(found, changed) if changed is not None else found)
    out, _ = engine.screen(requests, "drift", scorer, cache)
    rows = out.join(requests.select("item_id", "doc", "line_no", "sentence", F.concat_ws(":", F.col("symbols")[0]["file"], F.col("symbols")[0]["line"]).alias("place")), "item_id")
    order = F.when(F.col("label") == "DRIFT", 0).when(F.col("label") == "review", 1).when(F.col("label") == "??", 2).when(F.col("label") == "not checked", 3).otherwise(4)
    return rows.orderBy(order, F.col("confidence").desc(), "item_id")


def validate_spec_map(entries: DataFrame, docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(kind, spec, line, detail): sentences changed or moved since they were reviewed, references that name nothing, and sentences not covered."""
    here = lines.requirement_rows(docs, ["doc"]).select("doc", F.col("line_no").alias("now"), T.normalised(F.col("sentence")).alias("norm"), "sentence")
    e = entries.withColumn("norm", T.normalised(F.col("text"))).withColumn("doc", F.col("spec"))
    met = e.join(here.drop("sentence"), ["doc", "norm"], "left")
    first = Window.partitionBy("doc", "norm", "line").orderBy(F.abs(F.col("now") - F.col("line")))
    met = met.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    state = F.when(F.col("now").isNull(), "changed").when(F.col("now") != F.col("line"), "moved")
    moved = met.withColumn("kind", state).where("kind is not null").select("kind", "spec", "line", F.coalesce(F.col("now").cast("string"), F.col("text")).alias("detail"))
    refs = e.select("spec", "line", F.explode("code").alias("ref")).where(~F.col("ref").rlike("^(route|config):"))
    name = F.element_at(F.split("ref", ":"), -1)
    dead = refs.withColumn("name", name).join(symbols.select("name"), "name", "left_anti").join(symbols.select(F.col("file").alias("name")).distinct(), "name", "left_anti")
    dead = dead.select(F.lit("no such code").alias("kind"), "spec", "line", F.col("ref").alias("detail"))
    bare = here.join(e.select("doc", "norm"), ["doc", "norm"], "left_anti").select(F.lit("not covered").alias("kind"), F.col("doc").alias("spec"), F.col("now").alias("line"), F.col("sentence").alias("detail"))
    return moved.union(dead).union(bare)


def draft_spec_map(docs: DataFrame, symbols: DataFrame, most: int = 3) -> DataFrame:
    """Entries for review: each requirement with the code whose name shares most of its words."""
    sents = lines.requirement_rows(docs, ["doc"]).where("not is_code").withColumn("id", F.concat_ws(":", "doc", "line_no", F.substring(F.sha2(F.col("sentence").cast("binary"), 256), 1, 8)))
    q = sents.select("id", K.name_parts(F.col("sentence")).alias("words"))
    s = symbols.select(F.concat_ws(":", "file", "name").alias("ref"), K.name_parts(F.concat_ws(" ", "name", F.regexp_extract("file", r"([^/]+)$", 1))).alias("words")).distinct()
    best = pairing.word_overlap(q, "id", s, "ref", most).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "ref"))).alias("r"))
    return sents.join(best, "id", "left").select(F.col("doc").alias("spec"), F.col("line_no").alias("line"), F.col("sentence").alias("text"), F.coalesce(F.col("r.ref"), F.array().cast("array<string>")).alias("code"), F.lit("draft").alias("status"))


# ---------------------------------------------------------------- CI triage


def facts(failures: DataFrame) -> Column:
    """Sentences that are known without asking; what isn't known is said to be unknown.

    failures has jobs, kind, exit_code, overlap (files named by errors that the change edits, null: change unknown)
    and passed_before (null: unknown).
    """
    n = F.size("jobs")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Failed in "), n.cast("string"), F.when(n == 1, " job: ").otherwise(" jobs: "), F.array_join(F.slice("jobs", 1, 12), ", "), F.lit(".")),
        F.concat(F.lit("Kind of step: "), "kind", F.lit(".")),
        F.coalesce(F.concat(F.lit("Exit code "), F.col("exit_code").cast("string"), F.lit(".")), F.lit("The exit code is not known.")),
        F.when(F.col("overlap").isNull(), "The change is not known.").when(F.size("overlap") == 0, "No file that the errors name is edited by the change.").otherwise(F.concat(F.lit("The change edits files that the errors name: "), F.array_join(F.slice("overlap", 1, 12), ", "), F.lit("."))),
        F.when(F.col("passed_before").isNull(), "Whether the same job passed on the default branch is not known.").when(F.col("passed_before"), "The same job passed on the default branch.").otherwise("The same job failed on the default branch too."),
    )


def _with_run(failures: DataFrame) -> DataFrame:
    return failures if "run" in failures.columns else failures.withColumn("run", F.lit("run"))


def overlap(failures: DataFrame, changed: DataFrame | None) -> DataFrame:
    """failures with overlap: the changed(path, run) files of their run that their errors name (of any run where changed has no run), null where the change is unknown (changed None), empty where it is known and touches none."""
    if changed is None:
        return _with_run(failures).withColumn("overlap", F.lit(None).cast("array<string>"))
    failures = _with_run(failures)
    named = failures.select("run", "signature", F.explode("files").alias("named_path"))
    met = pairing.by_suffix(named, changed.select(F.col("path").alias("known_path"), *([F.col("run").cast("string").alias("_of")] if "run" in changed.columns else [F.lit(None).cast("string").alias("_of")])))
    met = met.where("_of is null or _of = run").groupBy("run", "signature").agg(F.array_sort(F.collect_set("known_path")).alias("overlap"))
    return failures.join(met, ["run", "signature"], "left").withColumn("overlap", F.coalesce("overlap", F.array().cast("array<string>")))


def triage_requests(failures: DataFrame, diffs: DataFrame | None) -> DataFrame:
    """Requests of failures: facts, labelled error lines, the output's end and the change of their run within its budget.

    diffs(change_id, diff, run): without a column run they are all of the run named "run". Sections are
    redacted before any of them is cut.
    """
    failures = _with_run(failures)
    if diffs is None:
        rows = failures.withColumn("change", F.lit(None).cast("string"))
    else:
        # all diffs of a run are its change, in the order of their ids, with one budget
        of_run = diffs.select("change_id", F.coalesce(F.col("run").cast("string"), F.lit("run")).alias("run")) if "run" in diffs.columns else diffs.select("change_id", F.lit("run").alias("run"))
        secs = changes.sections(diffs).withColumn("section", R.redact_lines(F.col("section"))).join(of_run.distinct(), "change_id")
        secs = secs.withColumn("file_no", F.row_number().over(Window.partitionBy("run").orderBy("change_id", "file_no"))).withColumn("change_id", F.col("run"))
        named = failures.select(F.col("run").alias("change_id"), F.explode(F.coalesce("overlap", F.array().cast("array<string>"))).alias("path")).distinct()
        kept = changes.within_budget(secs, named).groupBy(F.col("change_id").alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_no", "section"))), lambda s: s["section"]), "").alias("change"))
        rows = failures.join(kept, "run", "left")
    labelled = F.array_join(F.transform("candidates", lambda x, i: F.concat(F.lit("L"), (i + 1).cast("string"), F.lit(" "), x)), "\n")
    return _requests(rows, "triage", F.concat_ws("|", "run", "signature"), facts(rows).alias("a_facts"), labelled.alias("b_error_lines"), F.array_join("tail", "\n").alias("c_output_end"), F.col("change").alias("d_change"))


def triage(log_rows: DataFrame, scorer: engine.Scorer, changed: DataFrame | None = None, diffs: DataFrame | None = None, passed: DataFrame | None = None) -> DataFrame:
    """Did the change cause each failure? logs(file, text, run); passed(job, passed_before), where known. A failure meets the change of its own run."""
    runs = log_rows.select("file", "run").distinct() if "run" in log_rows.columns else None
    fails = overlap(logs.failures(logs.step_lines(log_rows), runs), changed)
    if passed is None:
        fails = fails.withColumn("passed_before", F.lit(None).cast("boolean"))
    else:
        fails = fails.withColumn("job", F.col("jobs")[0]).join(passed, "job", "left").drop("job")
    requests = triage_requests(fails, diffs)
    out, _ = engine.screen(requests, "triage", scorer)
    rows = out.join(requests.select("item_id", "run", "jobs", "step", "kind", "candidates", "overlap", "passed_before"), "item_id").withColumn("next_step", next_step(F.col("label"), F.col("overlap"), F.col("passed_before"), F.array_join("candidates", "\n")))
    order = F.when(F.col("label") == "CHANGE", 0).when(F.col("label") == "review", 1).when(F.col("label") == "??", 2).otherwise(3)
    return rows.orderBy(order, F.col("confidence").desc(), "item_id")


def next_step(label: Column, overlapping: Column, passed_before: Column, errors: Column) -> Column:
    """What to do with a result, by its label and what is known."""
    missing = errors.rlike(r"(?i)command not found|is not recognized as|executable file not found|No such file or directory")
    out = F.when(label == "CHANGE", F.when(F.coalesce(F.size(overlapping), F.lit(0)) > 0, "fix the change, first in the files that the errors name").otherwise("fix the change"))
    out = out.when(label == "not checked", "read the error lines; no answer came")
    out = out.when(missing, "a missing command or file fails the same on every run: look at the environment")
    return out.when(passed_before == F.lit(False), "the default branch fails too: look there first").when(passed_before.isNull(), "find out whether the default branch passes").otherwise("read the error lines; run again only if they point outside the change")


# ---------------------------------------------------------------- code audit, documentation claims, change claims


def audit_pairs(rules: DataFrame, files: DataFrame, changed_lines: DataFrame | None = None) -> DataFrame:
    """Reviewed rules(rule, scope, status, keep_comments) with the units of files(path, text) in their scope; of changed_lines(path, line_no) alone where given."""
    files = files.withColumn("text", R.redact_lines(F.col("text")))  # whole, as a key may go on beyond a unit
    reviewed = rules.where("status = 'reviewed'").select("rule", F.coalesce("scope", F.array(F.lit("**/*"))).alias("scope"), F.coalesce("keep_comments", F.lit(False)).alias("keep_comments"))
    met = pairing.in_scope(files.where(~R.secret_file(F.col("path"))).select("path").distinct(), reviewed.withColumn("scope", F.filter("scope", lambda g: g != "tests-only")))
    plain = code.code_units(code.stripped(files)).withColumn("keep_comments", F.lit(False))
    whole = code.code_units(files).withColumn("keep_comments", F.lit(True))
    pairs = met.select("path", "rule", "keep_comments").join(plain.unionByName(whole), ["path", "keep_comments"]).where(F.trim("text") != "")
    if changed_lines is not None:
        touched = pairing.in_range(changed_lines, "line_no", pairs.select("path", "start", "end").distinct(), "start", "end", ["path"]).select("path", "start", "end").distinct()
        pairs = pairs.join(touched, ["path", "start", "end"], "left_semi")
    return pairs


def audit_requests(pairs: DataFrame) -> DataFrame:
    unit = F.substring(R.redact(F.col("text")), 1, CODE_CHARS)
    return _requests(pairs, "audit", F.concat_ws("|", "rule", "path", "start"), F.substring("rule", 1, RULE_CHARS).alias("a_rule"), unit.alias("b_code"))


def check_code_rules(rules: DataFrame, files: DataFrame, scorer: engine.Scorer, verdicts: DataFrame | None = None, changed_lines: DataFrame | None = None, confirmed: int | None = None) -> DataFrame:
    """Does each unit keep the rules in whose scope it is? Above CONFIRM_ABOVE requests, `confirmed` must be their number."""
    requests = written(audit_requests(audit_pairs(rules, files, changed_lines)), "audit-requests")  # counted, then asked
    n = requests.select("request_key").distinct().count()
    if n > CONFIRM_ABOVE and confirmed != n:
        raise ValueError(f"{n} requests would be asked; pass confirmed={n} to do so")
    out, answers = engine.screen(requests, "audit", scorer)
    first = answers.where("n = 0").select("request_key", F.col("answer.noul").alias("p"))
    rows = out.join(first, "request_key").join(requests.select("item_id", "rule", F.col("path").alias("file"), "start", "end", F.sha2("text", 256).alias("code_sha")), "item_id")
    if verdicts is not None:
        rows = merging.apply_verdicts(rows, verdicts)
    else:
        rows = rows.withColumn("recorded", F.lit(None).cast("string")).withColumn("poor_record", F.lit(False))
    known = (F.col("recorded") == "false_positive") & F.col("label").isin(*merging.FLAGGED)
    return rows.orderBy(audit_group(F.col("label"), F.col("p"), known), "poor_record", F.col("p").desc(), "item_id")


def audit_group(label: Column, p: Column, known: Column | None = None) -> Column:
    """Where a result stands in an audit's order: flagged, likely, unknown, not checked, low, known to be none, passed, not applicable."""
    low = (label == "review") & (F.coalesce(p, F.lit(0.0)) < gates.NO)
    group = F.when(label == "BREAKS", 0).when(low, 4).when(label == "review", 1).when(label == "??", 2).when(label == "not checked", 3).when(label == "ok", 6).otherwise(7)
    return group if known is None else F.when(F.coalesce(known, F.lit(False)), 5).otherwise(group)


def check_doc_claims(files: DataFrame, scorer: engine.Scorer) -> DataFrame:
    """Does the code do what its own comments, docstrings and test names say?"""
    made = code.claims(code.code_units(files.withColumn("text", R.redact_lines(F.col("text")))))
    # the code is shown without comments; units pair by their lines, which stripping keeps
    bare = code.stripped(made.select("path", "start", "text").withColumnRenamed("start", "_s")).select("path", F.col("_s").alias("start"), F.col("text").alias("bare"))
    rows = made.join(bare, ["path", "start"])
    requests = _requests(rows, "doc", F.concat_ws("|", "path", "start"), F.substring(R.scrub(F.col("claim")), 1, 400).alias("a_claim"), F.substring(R.redact(F.col("bare")), 1, CODE_CHARS).alias("b_code"))
    out, answers = engine.screen(requests, "doc", scorer)
    rows = out.join(answers.where("n = 0").select("request_key", F.col("answer.noul").alias("p")), "request_key").join(requests.select("item_id", "path", "start", "end", "kind", "claim"), "item_id")
    return rows.orderBy(_claim_order("STALE"), F.col("p").desc(), "item_id")


def check_change_claims(descriptions: DataFrame, diffs: DataFrame, scorer: engine.Scorer) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, unpaired claims, files no claim names): does a change do what its description says?

    A claim that names no file is paired with the whole change where that fits the room of a request.
    """
    said, secs = changes.description_claims(descriptions), changes.sections(diffs)
    pairs = changes.pair_claims(said, secs)
    total = secs.groupBy("change_id").agg(F.sum(F.length("section")).alias("_all"))
    rest = said.join(pairs, ["change_id", "claim_no"], "left_anti").join(total.where(F.col("_all") <= changes.ROOM), "change_id").join(secs.select("change_id", "path"), "change_id").select("change_id", "claim_no", "claim", "path")
    both = pairs.union(rest)
    rows = both.join(secs, ["change_id", "path"])
    # no file of a claim is cut while another has more room; what small ones leave goes to larger ones
    rows = budget.fair_shares(rows.withColumn("section", R.redact(F.col("section"))), ["change_id", "claim_no"], F.length("section"), changes.ROOM)
    part = F.substring(F.col("section"), F.lit(1), F.col("share").cast("int"))
    grouped = rows.groupBy("change_id", "claim_no", "claim").agg(F.array_sort(F.collect_list(F.struct("path", part.alias("t")))).alias("s"))
    grouped = grouped.withColumn("hunks", F.substring(F.array_join("s.t", ""), 1, changes.ROOM)).withColumn("files", F.col("s.path"))
    requests = _requests(grouped, "change", F.concat_ws("|", "change_id", "claim_no"), F.col("claim").alias("a_claim"), F.col("hunks").alias("b_hunks"))
    out, answers = engine.screen(requests, "change", scorer)
    results = out.join(answers.where("n = 0").select("request_key", F.col("answer.noul").alias("p")), "request_key").join(requests.select("item_id", "claim", "files"), "item_id")
    unpaired = said.join(both, ["change_id", "claim_no"], "left_anti")
    return results.orderBy(_claim_order("UNSUPPORTED"), F.col("p").desc(), "item_id"), unpaired, changes.unmentioned_files(secs, both)


def _claim_order(flagged: str, cut: float = 0.5) -> Column:
    low = (F.col("label") == "review") & (F.coalesce("p", F.lit(0.0)) < cut)
    return F.when(F.col("label") == flagged, 0).when(low, 4).when(F.col("label") == "review", 1).when(F.col("label") == "??", 2).when(F.col("label") == "not checked", 3).when(F.col("label") == "ok", 5).otherwise(6)


# ---------------------------------------------------------------- rules

#: What makes a sentence a rule, what to look at in it, and which files a language has.
NORMATIVE = r"(?i)\b(?:must|should|shall|never|always|do not|don't|avoid|prefer(?:red|s)?|use|please|required?|mandatory|forbidden|not allowed|only|instead of|rather than|make sure|ensure|recommended)\b"
NORMATIVE_CJK = "必须|应该|应当|不得|禁止|不要|务必|必ず|しなければ|してはいけない|해야|야 한다|야 합니다|하지 마|금지"
UNIVERSAL = r"(?i)^(?:(?:in|for|if|when|where)\b[^,]{0,80},\s+)?(?:(?:every|each|all|any|no|none of)\s+[\w`]|(?:an?|the)\s+[\w`.()\[\]-]+\s+that\b)"
IMPERATIVE = r"^(?i:add|annotate|assert|avoid|call|check|choose|declare|define|document|do|ensure|follow|give|group|handle|import|include|keep|let|limit|make|mark|name|order|pass|place|prefer|prefix|put|qualify|raise|remove|replace|return|separate|sort|specify|split|state|store|style|wrap|write)\b"
FLAGS = {
    "negation": r"(?i)\b(?:never|not|no|don't|do not|avoid|without|forbidden|disallowed)\b",
    "exception": r"(?i)\b(?:except|unless|only (?:when|if)|other than|apart from|with the exception)\b",
    "compound": r"(?i)\b(?:must|should|never|always)\b.*\b(?:and|or)\b.*\b(?:must|should|never|always|use|avoid)\b",
    "process": r"(?i)\b(?:commits?|pull requests?|PRs?|changelogs?|release notes?|reviewers?|issues?|tickets?|squash|rebase|sign(?:ed)?-off|branch(?:es)?|CI|merges?|backports?|milestones?)\b",
    "linter": r"(?i)\b(?:lint|linter|ruff|flake8|pylint|eslint|prettier|black|isort|gofmt|rustfmt|clippy|checkstyle|line[ -]length|trailing whitespace|indentation|import order|pre-commit)\b",
    "comments": r"(?i)\b(?:comments?|docstrings?|javadoc|jsdoc|rustdoc|TODO|FIXME|license header|copyright header)\b",
    "conduct": r"(?i)\b(?:ask|tell)\s+the\s+user\b|\bin\s+(?:the|this)\s+conversation\b|\bin\s+(?:the\s+)?chat\b",
    "conditional": r"(?i)(?:^|[:;]\s+)(?:where|wherever|when|whenever|if)\b[^,]{3,160},|\b(?:that|which)\s+(?:needs?|wants?|requires?)\b",
    "cross-unit": r"(?i)\b(?:only (?:one|a single)|exactly one|in (?:one|a single) place|nowhere else|elsewhere|(?:consistent(?:ly)?|the same) across|across (?:all|every)|duplicat\w*)\b",
}
LANGUAGES = {
    "py": r"(?i)\bpython\b|\.py\b", "ts": r"(?i)\btypescript\b|\.tsx?\b", "js": r"(?i)\bjavascript\b|\.jsx?\b", "go": r"\bGo\b|(?i:\bgolang\b)|\.go\b",
    "rs": r"(?i)\brust\b|\.rs\b", "java": r"(?i)\bjava\b", "kt": r"(?i)\bkotlin\b",
}


def rule_cue(sentence: Column) -> Column:
    return sentence.rlike(NORMATIVE) | sentence.rlike(NORMATIVE_CJK) | sentence.rlike(IMPERATIVE) | sentence.rlike(UNIVERSAL)


def rule_flags(sentence: Column) -> Column:
    bare = F.regexp_replace(sentence, F.lit(r"<[^<>\n]*>|\]\([^)\n]*\)|https?://\S+"), F.lit(" "))
    return F.array_compact(F.array(*[F.when(bare.rlike(p), F.lit(k)) for k, p in FLAGS.items()]))


def guessed_scope(sentence: Column, source: Column, languages: list[str]) -> Column:
    """Globs by the languages that a rule names (else those of the project), below the folder of its file; tests-only for rules about tests."""
    named = F.array_compact(F.array(*[F.when(sentence.rlike(p), F.lit(f"**/*.{k}")) for k, p in LANGUAGES.items()]))
    globs = F.when(F.size(named) > 0, named).otherwise(F.array(*[F.lit(f"**/*.{x}") for x in sorted(languages)] or [F.lit("**/*")]))
    folder = F.regexp_extract(source, r"^(.*/)[^/]*$", 1)
    tests = sentence.rlike(r"(?i)\b(?:unit )?tests?\b|\bfixtures?\b") & ~sentence.rlike(r"(?i)\b(?:has|have|needs?|requires?|without|add(?:s|ing)?)\s+(?:a |an |its own |new )?(?:unit )?tests?\b|production\s+code")
    globs = F.transform(globs, lambda g: F.concat(folder, g))
    return F.when(tests, F.concat(globs, F.array(F.lit("tests-only")))).otherwise(globs)


def draft_rule_map(docs: DataFrame, languages: list[str]) -> DataFrame:
    """Rules for review from docs(doc, text): sentences with a cue, their flags and scopes; a twin names the first of its kind."""
    rows = lines.requirement_rows(docs, ["doc"], least=2).where(rule_cue(F.col("sentence")))
    rows = rows.withColumn("id", F.concat_ws(":", "doc", F.lpad(F.col("line_no").cast("string"), 7, "0"), F.substring(F.sha2(F.col("sentence").cast("binary"), 256), 1, 8)))
    twin = merging.twins(rows, "id", "sentence")
    flags = rule_flags(F.col("sentence"))
    return rows.join(twin, "id", "left").select(
        F.col("doc").alias("source"), F.col("line_no").alias("line"), F.col("sentence").alias("text"), F.col("sentence").alias("rule"), guessed_scope(F.col("sentence"), F.col("doc"), languages).alias("scope"),
        flags.alias("flags"), F.array_contains(flags, "comments").alias("keep_comments"), F.lit("draft").alias("status"), "duplicate_of",
    )


def validate_rules(rules: DataFrame, files: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(kind, detail): counts by status, reviewed rules whose scope names no file, and rules with a poor record."""
    counts = rules.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit("count").alias("kind"), F.concat_ws(" ", F.col("n").cast("string"), "status").alias("detail"))
    reviewed = rules.where("status = 'reviewed'").select("rule", F.filter(F.coalesce("scope", F.array(F.lit("**/*"))), lambda g: g != "tests-only").alias("scope"))
    empty = reviewed.join(pairing.in_scope(files.select("path"), reviewed).select("rule").distinct(), "rule", "left_anti").select(F.lit("no file in scope").alias("kind"), F.col("rule").alias("detail"))
    out = counts.union(empty)
    return out.union(merging.rule_records(verdicts).where("poor").select(F.lit("poor record").alias("kind"), F.col("rule").alias("detail"))) if verdicts is not None else out
