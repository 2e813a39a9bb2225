"""From one answer to an action: five ladders of fixed thresholds, as expressions of the optimiser.

An abstention or a missing answer is never a pass. Thresholds lie off the grid of two decimals in
which answers come. Each gate gives struct(action, why); action is act, review, unverifiable, na or
clean, and null (no answer) makes the action "error".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the ladders.
ACT, DRIFT_CLEAN, CLEAN, NO, MISMATCH = 0.905, 0.987, 0.905, 0.295, 0.70
FLOORS = {"drift": 0.85, "triage": 0.855, "audit": 0.855, "doc": 0.855, "change": 0.855}
CHANGE_CAUSES = ("change_broke_code", "change_needs_test_update")
LABELS = {
    "drift": {"act": "DRIFT", "review": "review", "unverifiable": "??", "clean": "ok"},
    "triage": {"act": "CHANGE", "review": "review", "unverifiable": "??"},
    "audit": {"act": "BREAKS", "review": "review", "unverifiable": "??", "clean": "ok", "na": "n/a"},
    "doc": {"act": "STALE", "review": "review", "unverifiable": "??", "clean": "ok", "na": "vague"},
    "change": {"act": "UNSUPPORTED", "review": "review", "unverifiable": "??", "clean": "ok", "na": "vague"},
}


def _result(action: str, why: str) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(why).alias("why"))


def _answered(choice: Column, confidence: Column, ladder: Column) -> Column:
    bad = choice.isNull() | confidence.isNull() | F.isnan(confidence)
    return F.when(bad, _result("error", "no readable answer")).otherwise(ladder)


def _no(p: Column) -> Column:
    return F.coalesce(p, F.lit(0.0)) < NO


def drift(choice: Column, confidence: Column, mismatch: Column) -> Column:
    """choice: accurate, drifted, unrelated or not_enough_information; mismatch: how surely a value conflicts."""
    return _answered(
        choice, confidence,
        F.when(choice == "not_enough_information", _result("unverifiable", "abstained"))
        .when(choice == "unrelated", _result("unverifiable", "not about the code"))
        .when((choice == "drifted") & (confidence >= ACT), _result("act", "drifted"))
        .when(choice == "drifted", _result("review", "drifted, unsure"))
        .when(confidence < DRIFT_CLEAN, _result("review", "accurate, unsure"))
        .when(F.coalesce(mismatch, F.lit(0.0)) >= MISMATCH, _result("review", "a value conflicts"))
        .otherwise(_result("clean", "no drift")),
    )


def triage(choice: Column, confidence: Column, cause: Column, causes: tuple[str, ...] = CHANGE_CAUSES) -> Column:
    """choice: the_change, not_the_change or not_enough_information; the kind of cause must agree."""
    fits = F.coalesce(cause.isin(*causes), F.lit(False))
    return _answered(
        choice, confidence,
        F.when(choice == "not_enough_information", _result("unverifiable", "not settled"))
        .when((choice == "the_change") & (confidence >= ACT) & fits, _result("act", "the change"))
        .when((choice == "the_change") & ~fits, _result("review", "another kind of cause"))
        .when(choice == "the_change", _result("review", "leans to the change"))
        .when(fits, _result("review", "the answers disagree"))
        .otherwise(_result("review", "leans away")),
    )


def _ladder(choice: Column, confidence: Column, p: Column, abstain: str, closes: str, flags: tuple[str, ...]) -> Column:
    return _answered(
        choice, confidence,
        F.when(choice == abstain, _result("unverifiable", "not settled"))
        .when((choice == closes) & _no(p), _result("na", closes))
        .when(choice == closes, _result("review", f"{closes}, yet likely"))
        .when(choice.isin(*flags) & (confidence >= ACT), _result("act", "flagged"))
        .when(choice.isin(*flags), _result("review", "flagged, unsure"))
        .when((confidence >= CLEAN) & _no(p), _result("clean", "passes"))
        .otherwise(_result("review", "passes, unsure")),
    )


def audit(choice: Column, confidence: Column, p_breaks: Column) -> Column:
    return _ladder(choice, confidence, p_breaks, "not_enough_information", "not_applicable", ("breaks",))


def doc_claim(choice: Column, confidence: Column, p_contradicted: Column) -> Column:
    return _ladder(choice, confidence, p_contradicted, "cannot_tell", "too_general", ("stale_signature", "stale_behaviour"))


def change_claim(choice: Column, confidence: Column, p_unsupported: Column) -> Column:
    return _ladder(choice, confidence, p_unsupported, "cannot_tell", "too_vague", ("contradicted", "not_shown"))


def label(family: str, action: Column) -> Column:
    """What a report calls an action; an error is "not checked"."""
    out = F.lit("not checked")
    for k, v in LABELS[family].items():
        out = F.when(action == k, F.lit(v)).otherwise(out)
    return out
