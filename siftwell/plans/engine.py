"""Screening: ask once, gate, ask the unsettled again, agree, keep the answers.

A scorer is a function from requests(request_key, body) and a sample number to
answers(request_key, answer struct, error): the only part with side effects. Each pass is written
before it is gated, so that a retried task never asks twice, and answers stand under (request_key, n),
so that independent samples never collapse into one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import schemas
from siftwell.functions import gates
from siftwell.tables import written

Scorer = Callable[[DataFrame, int], DataFrame]



@dataclass(frozen=True)
class Family:
    """A gate with what settles an item and what agreement of samples may decide."""

    name: str
    gate: Callable[[Column], Column]
    settled: tuple[str, ...]
    agreed: dict[str, str]  # a choice that all samples gave -> action
    needs_low: tuple[str, ...]  # actions that agreement gives only while every second opinion is low
    low_below: float
    samples: int


def _g(f: Callable) -> Callable[[Column], Column]:
    return lambda a: f(a["choice"], a["confidence"], a["noul"])


FAMILIES = {
    "drift": Family("drift", _g(gates.drift), ("act", "clean", "unverifiable"), {"drifted": "act", "accurate": "clean", "not_enough_information": "unverifiable", "unrelated": "unverifiable"}, ("clean",), gates.MISMATCH, 3),
    "triage": Family("triage", lambda a: gates.triage(a["choice"], a["confidence"], a["cause"]), ("act", "unverifiable"), {"the_change": "act"}, (), 2.0, 1),
    "audit": Family("audit", _g(gates.audit), ("act", "clean", "na", "unverifiable"), {"breaks": "act", "follows": "clean", "not_applicable": "na"}, ("clean", "na"), gates.NO, 3),
    "doc": Family("doc", _g(gates.doc_claim), ("act", "clean", "na", "unverifiable"), {"stale_signature": "act", "stale_behaviour": "act", "consistent": "clean", "too_general": "na"}, ("clean", "na"), gates.NO, 3),
    "change": Family("change", _g(gates.change_claim), ("act", "clean", "na", "unverifiable"), {"contradicted": "act", "not_shown": "act", "implemented": "clean", "too_vague": "na"}, ("clean", "na"), gates.NO, 3),
}


def unreadable(answer: Column, choices: list[str] | None = None) -> Column:
    """Why an answer can't be read, or null: no choice, one that wasn't offered, or a number that isn't one."""
    c = answer["confidence"]
    out = F.when(answer.isNull(), "no answers").when(answer["choice"].isNull(), "no choice").when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), "the confidence is not a number")
    out = out.when(F.isnan(answer["noul"]) | (F.abs(answer["noul"]) == float("inf")), "the second opinion is not a number")
    return out.when(~answer["choice"].isin(choices), "the choice is not one of those offered") if choices else out


def agreement(answers: DataFrame, family: Family, keys: list[str]) -> DataFrame:
    """(keys, agreed, mean): groups of two or more readable answers that all say the same, none under the floor."""
    a = F.col("answer")
    per = answers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a["choice"].isNull() | F.col("error").isNotNull()).alias("bad"), F.min(a["choice"]).alias("choice"), F.max(a["choice"]).alias("_other"),
        F.min(a["confidence"]).alias("floor"), F.avg(a["confidence"]).alias("mean"), F.max(F.coalesce(a["noul"], F.lit(0.0))).alias("worst"),
        F.min(F.coalesce(a["cause"].isin(*gates.CHANGE_CAUSES), F.lit(False))).alias("causes"),
    )
    action = F.lit(None).cast("string")
    for choice, act in family.agreed.items():
        action = F.when(F.col("choice") == choice, F.lit(act)).otherwise(action)
    ok = (F.col("n") >= 2) & (F.col("bad") == 0) & (F.col("choice") == F.col("_other")) & (F.col("floor") >= gates.FLOORS[family.name])
    ok = ok & (~action.isin(*family.needs_low) | (F.col("worst") < family.low_below)) if family.needs_low else ok
    ok = ok & F.col("causes") if family.name == "triage" else ok
    return per.where(ok & action.isNotNull()).select(*keys, action.alias("agreed"), "mean")


def screen(requests: DataFrame, family: str, scorer: Scorer, cache: DataFrame | None = None, samples: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, answers) of requests(item_id, request_key, body, seq).

    outcomes: item_id, action, label, confidence, why, n_answers, error. Requests asked alike are
    asked once; those that the cache(request_key, n, answer) knows aren't asked; only what one answer
    doesn't settle is asked again, and agreement only moves an item out of review.
    """
    fam = FAMILIES[family]
    samples = fam.samples if samples is None else samples
    distinct = requests.groupBy("request_key").agg(F.min_by("body", "seq").alias("body"))
    empty = requests.sparkSession.createDataFrame([], schemas.ANSWERS)
    known = cache.select("request_key", "n", "answer", F.lit(None).cast("string").alias("error")) if cache is not None else empty

    def ask(wanted: DataFrame, n: int) -> DataFrame:
        kept = known.where(F.col("n") == n)
        fresh = wanted.join(kept.select("request_key"), "request_key", "left_anti")
        new = scorer(fresh, n).select("request_key", F.lit(n).alias("n"), "answer", F.coalesce("error", unreadable(F.col("answer"))).alias("error"))
        return written(new.unionByName(kept.join(wanted.select("request_key"), "request_key", "left_semi")), "answers")

    answers = ask(distinct, 0)
    gated = answers.withColumn("g", F.when(F.col("error").isNull(), fam.gate(F.col("answer"))))
    first = gated.select("request_key", F.coalesce("g.action", F.lit("error")).alias("action"), F.col("answer.confidence").alias("confidence"), F.coalesce("error", "g.why").alias("why"), "error")
    if samples > 1:
        open_ = distinct.join(first.where((F.col("action") != "error") & ~F.col("action").isin(*fam.settled)).select("request_key"), "request_key", "left_semi")
        for n in range(1, samples):
            answers = answers.unionByName(ask(open_, n))
        agreed = agreement(answers, fam, ["request_key"])
        more = answers.groupBy("request_key").agg(F.count_if(F.col("error").isNull()).alias("n_answers"))
        settled = first.join(agreed, "request_key", "left").join(more, "request_key")
        unsettled = ~F.col("action").isin(*fam.settled, "error") & F.col("agreed").isNotNull()
        settled = settled.select(
            "request_key", F.when(unsettled, F.col("agreed")).otherwise(F.col("action")).alias("action"), F.when(unsettled, F.col("mean")).otherwise(F.col("confidence")).alias("confidence"),
            F.when(unsettled, F.lit("all answers agree")).otherwise(F.col("why")).alias("why"), "error", "n_answers",
        )
    else:
        settled = first.withColumn("n_answers", F.when(F.col("error").isNull(), 1).otherwise(0).cast("long"))
    out = requests.select("item_id", "request_key").join(settled, "request_key")
    return out.withColumn("label", gates.label(family, F.col("action"))), answers


def hashed_scorer(choices: list[str], causes: list[str] = ["change_broke_code", "environment"]) -> Scorer:  # noqa: B006
    """Answers that follow from a hash of the request: for tests of the plumbing, and no measure of quality."""

    def score(requests: DataFrame, n: int) -> DataFrame:
        h = F.sha2(F.concat("request_key", F.lit(f":{n}")), 256)
        part = lambda i: F.conv(F.substring(h, 1 + 4 * i, 4), 16, 10).cast("int")
        pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), part(i) % len(xs) + 1)
        answer = F.struct(pick(choices, 0).alias("choice"), (part(1) % 1001 / 1000).alias("confidence"), (part(2) % 101 / 100).alias("noul"), pick(causes, 3).alias("cause"))
        return requests.select("request_key", answer.alias("answer"), F.lit(None).cast("string").alias("error"))

    return score


def merged_cache(cache: DataFrame, answers: DataFrame, most: int = 20_000) -> DataFrame:
    """The cache with new readable answers, which win over old ones; the newest `most` keys stay."""
    new = answers.where("error is null").select("request_key", "n", "answer", F.lit(1).alias("age"))
    both = cache.select("request_key", "n", "answer", F.lit(0).alias("age")).unionByName(new)
    per = both.groupBy("request_key", "n").agg(F.max_by("answer", "age").alias("answer"), F.max("age").alias("age"))
    keys = per.groupBy("request_key").agg(F.max("age").alias("age")).orderBy(F.col("age").desc(), "request_key").limit(most)
    return per.drop("age").join(keys.select("request_key"), "request_key", "left_semi")


def exit_code(outcomes: DataFrame, flagged: str, problems: int = 0, unusable: bool = False) -> int:
    """2 for problems of the setup, 3 for a scorer that can't be used, 1 where something is flagged, else 0."""
    if problems:
        return 2
    if unusable:
        return 3
    return int(not outcomes.where(F.col("label") == flagged).isEmpty())
