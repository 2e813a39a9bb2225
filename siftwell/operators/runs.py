"""CI runs: which jobs to triage, cancelled ones explained, where a step passed, and the default branch's record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import keys as K
from siftwell.operators import pairing

#: A matrix cancels its other jobs from so long before to so long after a failure (seconds).
FAIL_FAST = (-5, 300)


def matrix_base(job: Column) -> Column:
    """A matrix job's name without its values."""
    return F.regexp_replace(job, F.lit(r" \(.*$"), F.lit(""))


def to_triage(jobs: DataFrame) -> DataFrame:
    """Failed jobs of jobs(run, name, conclusion, ...); the cancelled ones of a run in which none failed."""
    failed = F.col("conclusion").isin("failure", "timed_out")
    any_failed = jobs.groupBy("run").agg(F.max(failed.cast("int")).alias("_any"))
    return jobs.join(any_failed, "run").where(failed | ((F.col("_any") == 0) & (F.col("conclusion") == "cancelled"))).drop("_any")


def cancelled_jobs(jobs: DataFrame) -> DataFrame:
    """(run, name, by_fail_fast): cancelled jobs, and whether a failure of the same matrix cancelled them.

    Where an end isn't known, the matrix alone decides. Ends are dealt to bins as long as the interval, so an
    interval reaches into two neighbouring bins at most: it holds a failure if the last one of the first bin or the first
    one of the second lies in it. So no row meets more than one row a bin, however many failures a matrix has.
    """
    before, after = FAIL_FAST
    rows = jobs.select("run", "name", "conclusion", matrix_base(F.col("name")).alias("base"), F.unix_seconds("completed_at").alias("end"))
    bin_of = lambda t: F.floor(t / (after - before + 1))
    failed = rows.where(F.col("conclusion").isin("failure", "timed_out"))
    per = failed.groupBy("run", "base", bin_of(F.col("end")).alias("_bin")).agg(F.min("end").alias("first"), F.max("end").alias("last"))
    no_end = F.lit(None).cast("long")
    sides = F.array(F.struct("_bin", no_end.alias("next"), F.col("last").alias("last")), F.struct((F.col("_bin") - 1).alias("_bin"), F.col("first").alias("next"), no_end.alias("last")))
    near = per.where("_bin is not null").select("run", "base", F.explode(sides).alias("s")).groupBy("run", "base", "s._bin").agg(F.max("s.last").alias("_last"), F.min("s.next").alias("_next"))
    matrix = per.groupBy("run", "base").agg(F.max("last").isNotNull().alias("_ends"))
    cancelled = rows.where("conclusion = 'cancelled'").withColumn("_bin", bin_of(F.col("end") - after))
    met = cancelled.join(near, ["run", "base", "_bin"], "left").join(matrix, ["run", "base"], "left")
    held = F.coalesce(F.col("_last") >= F.col("end") - after, F.lit(False)) | F.coalesce(F.col("_next") <= F.col("end") - before, F.lit(False))
    return met.select("run", "name", (F.col("_ends").isNotNull() & (F.col("end").isNull() | ~F.col("_ends") | held)).alias("by_fail_fast"))


def passed_in(failed_steps: DataFrame, steps: DataFrame) -> DataFrame:
    """failed_steps(run, job, step) with passed_in: the other jobs of the same matrix where the same step passed."""
    ok = steps.where("conclusion = 'success'").select("run", F.col("job").alias("_other"), "step", matrix_base(F.col("job")).alias("_base"))
    met = failed_steps.withColumn("_base", matrix_base(F.col("job"))).join(ok, ["run", "step", "_base"]).where("job <> _other")
    per = met.groupBy("run", "job", "step").agg(F.array_sort(F.collect_set("_other")).alias("passed_in"))
    return failed_steps.join(per, ["run", "job", "step"], "left").withColumn("passed_in", F.coalesce("passed_in", F.array().cast("array<string>")))


def default_branch_record(runs: DataFrame, history: DataFrame, history_jobs: DataFrame) -> DataFrame:
    """(run, job, passed_before): how each job ended in the default branch's last own run made before a run.

    runs(run, sha, created_at); history(past, sha, created_at, event, own) of the branch; history_jobs(past, job, conclusion).
    Runs of pull requests and forks don't count, nor does a run of the same commit. A job that the past
    run didn't have, or that was cancelled or skipped there, is not known: null.
    """
    own = history.where(F.col("own") & ~F.col("event").isin("pull_request", "pull_request_target"))
    # of a workflow's own history: the last run of each commit pairs with runs of other commits
    per = own.select(F.lit(1).alias("k"), F.col("created_at").alias("at"), F.struct("past", "sha").alias("v"), F.xxhash64("past").alias("tie"))
    last = pairing.last_before(runs.select("run", "sha", "created_at", F.lit(1).alias("k")), "created_at", per, "at", ["k"], "v", "tie")
    other = last.where("last_value.sha <> sha or last_value is null")
    same = last.where("last_value.sha = sha").select("run", "sha", "created_at")
    # the same commit was last: the last of another commit, met by range within the workflow's history
    again = same.join(own.select("past", F.col("sha").alias("_sha"), F.col("created_at").alias("_at")), F.col("_sha") != F.col("sha")).where("_at <= created_at").groupBy("run").agg(F.max_by("past", F.struct("_at", "past")).alias("past"))
    found = other.select("run", F.col("last_value.past").alias("past")).union(again)
    fared = F.when(F.max(F.col("conclusion").isin("failure", "timed_out").cast("int")) == 1, False).when(F.max((F.col("conclusion") == "success").cast("int")) == 1, True)
    return found.join(history_jobs, "past").groupBy("run", "job").agg(fared.alias("passed_before"))


def outside_project(named: DataFrame, project: DataFrame, submodules: DataFrame | None = None) -> DataFrame:
    """named(path) that are no file of project(path), by equality or suffix whatever their case, nor below one of submodules(folder)."""
    a = named.select("path", F.lower(K.path_key(F.col("path"))).alias("named_path")).distinct()
    b = project.select(F.lower(F.col("path")).alias("known_path")).distinct()
    known = pairing.by_suffix(a, b).select("path").distinct()
    rest = a.join(known, "path", "left_anti")
    if submodules is not None:
        first = rest.withColumn("_f", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("named_path", "/"))), lambda i: F.array_join(F.slice(F.split("named_path", "/"), F.lit(1), i), "/"))))
        inside = first.join(submodules.select(F.lower(F.trim(F.col("folder"))).alias("_f")), "_f").select("path").distinct()
        rest = rest.join(inside, "path", "left_anti")
    return rest.select("path")
