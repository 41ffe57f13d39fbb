"""Relationship of two compared facts: a cascade over the signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import scalar as S
from claimloom.functions import vocab as V
from claimloom.operators.compare import transition

# factor, ceiling and reason of each context that reconciles two values
_CONTEXTS = [
    (0.90, 0.92, "status transition"),
    (0.92, 0.94, "different reporting periods"),
    (0.85, 0.88, "differing reporting durations"),
    (0.90, 0.92, "different reporting scopes"),
    (0.82, 0.85, "different qualifiers"),
    (0.82, 0.86, "different metric dimensions"),
]
#: Per branch: relationship, factor on the facts' confidence (0: none), least, most, reason.
OUTCOMES = [
    ("UNRELATED", 0.0, 0.98, 0.98, "different entities"),
    ("UNRESOLVED", 0.0, 0.50, 0.50, "unresolved entity"),
    ("CORROBORATES", 0.96, 0.5, 0.98, "numerically equivalent"),
    ("CORROBORATES", 0.90, 0.5, 0.95, "within the approximation tolerance or bound"),
    ("CORROBORATES", 0.98, 0.5, 0.99, "same value"),
    *(("CONTEXTUALLY_RECONCILED", x, 0.5, hi, why) for x, hi, why in _CONTEXTS),
    ("CONTRADICTS", 0.94, 0.5, 0.96, "materially different values"),
    ("CONTRADICTS", 0.82, 0.5, 0.88, "materially different values"),
    ("UNRESOLVED", 0.0, 0.55, 0.55, "context does not establish a conflict"),
    ("UNRESOLVED", 0.0, 0.50, 0.50, "insufficient context"),
]


def branch_confidence(least: Column, outcome: tuple) -> Column:
    """Of one branch, by the lesser confidence of the two facts; it never falls as that one grows."""
    _, factor, lo, hi, _ = outcome
    return F.round(F.least(F.lit(hi), F.greatest(F.lit(lo), least * factor)), 4) if factor else F.lit(lo)


def relate(classified: DataFrame) -> DataFrame:
    """RSN-1..9, RSN-11: relationship, confidence, reason, explanation, source_independence."""
    s = lambda k: F.col(f"sig_{k}")
    b = F.least(F.coalesce("a.confidence", F.lit(0.0)), F.coalesce("b.confidence", F.lit(0.0)))
    # conditions used by several branches are columns of their own, evaluated once
    classified = classified.withColumn("_turned", transition(S.underscore_key(F.col("a.predicate")), S.underscore_key(F.col("b.predicate")), V.TRANSITIONS_REASONING))
    turned = F.col("_turned")
    entity = s("subject").isin("exact", "alias")
    predicate = s("predicate").isin("exact", "compatible")
    typed = s("fact_type") == "compatible"
    agrees = s("value").isin("equal", "equivalent", "compatible")
    percent = lambda x: (F.col(f"{x}.value_type") == "percentage") | (F.coalesce(F.col(f"{x}.unit"), F.lit("")) == "%")
    dimension = percent("a") != percent("b")

    apart = (F.col("classification") == "NOT_MATCH") | (s("subject") == "different") | (s("predicate") == "different") | (s("fact_type") == "incompatible")
    open_ = (s("subject") == "unknown") | (F.col("classification") == "UNCERTAIN")
    same_claim = entity & predicate & typed
    corroborates = same_claim & ~turned & (s("time") != "different") & (s("scope") != "different") & agrees
    converted = (s("value") == "equivalent") | (s("unit") == "converted")
    changed = entity & (predicate | turned) & typed
    # in the order of _CONTEXTS
    contexts = [turned, s("time") == "different", s("time").isin("overlapping", "contained"), s("scope") == "different", s("qualifiers") == "different", dimension]
    reconciled = changed & S.any_of(contexts)
    contradicts = same_claim & (s("scope") == "same") & ~s("time").isin("different", "overlapping", "contained") & (s("value") == "different") & ~dimension

    # the branch and the first context are found once; the results are read off them
    branch = (
        F.when(apart, 0)
        .when(open_, 1)
        .when(corroborates, F.when(converted, 2).when(s("value") == "compatible", 3).otherwise(4))
        .when(reconciled, 5 + F.coalesce(*(F.when(c, i) for i, c in enumerate(contexts))))
        .when(contradicts, F.when(s("time") == "same", 11).otherwise(12))
        .when(entity & predicate & (s("value") == "different"), 13)
        .otherwise(14)
    )
    pick = lambda k: F.array(*(F.lit(o[k]) for o in OUTCOMES))[F.col("_branch")]
    label, reason, lit = pick(0), pick(4), F.lit
    confidence = F.least(pick(3), F.greatest(pick(2), F.coalesce(b, F.lit(0.0)) * pick(1)))
    same_doc = F.coalesce(F.col("a.document_id") == F.col("b.document_id"), lit(False))
    subject = F.coalesce(S.blank_to_null(F.col("a.subject")), S.blank_to_null(F.col("b.subject")), lit("the entity"))
    claim = F.coalesce(S.blank_to_null(F.col("a.predicate")), S.blank_to_null(F.col("b.predicate")), lit("claim"))
    out = classified.withColumn("_branch", branch).withColumns({"relationship": label, "reason": reason, "rel_confidence": F.round(confidence, 4)})
    return out.withColumn("source_independence", F.when(same_doc, "same_document").otherwise("cross_document")).withColumn("explanation", F.concat(claim, lit(" of "), subject, lit(": "), F.col("reason"), lit("."))).drop("_branch", "_turned")


def relationship_stats(related: DataFrame) -> DataFrame:
    """RSN-10: counts and mean confidence per relationship and source."""
    return related.groupBy("relationship", "source_independence").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rel_confidence"), 4).alias("avg_confidence"))
