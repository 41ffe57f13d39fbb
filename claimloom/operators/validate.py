"""Validation and deduplication of facts; checks of pairs and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import scalar as S
from claimloom.functions import vocab as V

NUMERIC = ("number", "percentage", "currency", "quantity")


def evidence_ids(elements: DataFrame) -> DataFrame:
    """VAL-1: every id an element can be named by, one row each."""
    ids = F.concat(F.array("element_id"), F.coalesce("evidence_ids", F.array().cast("array<string>")))
    return elements.select(F.explode(ids).alias("evidence_id")).where(F.col("evidence_id").isNotNull()).distinct()


def missing_evidence(facts: DataFrame, elements: DataFrame) -> DataFrame:
    """VAL-2: (fact_id, first_missing): facts naming an unknown id, with the first such id in list order."""
    named = facts.select("fact_id", F.posexplode("evidence_ids").alias("pos", "evidence_id"))
    unknown = named.join(evidence_ids(elements), "evidence_id", "left_anti")
    return unknown.groupBy("fact_id").agg(F.min_by("evidence_id", "pos").alias("first_missing"))


def rejection_reason() -> Column:
    """VAL-5, the checks that need no other table, in order; null if none fails."""
    blank = lambda c: F.coalesce(S.strip(F.col(c)), F.lit("")) == ""
    number = F.col("value_num").isNotNull() | F.replace("value_raw", F.lit(","), F.lit("")).rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)\s*$")
    return (
        F.when(blank("subject_name"), "missing subject")
        .when(blank("predicate"), "missing predicate")
        .when(F.col("value_raw").isNull(), "missing object")
        .when(F.coalesce((F.col("confidence") < 0) | (F.col("confidence") > 1), F.lit(True)), "confidence out of range")
        .when(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0, "missing evidence")
        .when(F.col("value_type").isin(*NUMERIC) & ~F.coalesce(number, F.lit(False)), "value is no number")
    )


def validate_facts(facts: DataFrame, elements: DataFrame) -> DataFrame:
    """Facts with the reason of their rejection, null for valid ones."""
    checked = facts.withColumn("_own", rejection_reason()).join(missing_evidence(facts, elements), "fact_id", "left")
    late = F.col("_own") == "value is no number"
    by_evidence = F.when(F.col("first_missing").isNotNull(), F.concat(F.lit("unknown evidence "), F.col("first_missing")))
    return checked.withColumn("reason", F.when(F.col("_own").isNotNull() & ~late, F.col("_own")).otherwise(F.coalesce(by_evidence, F.col("_own")))).drop("_own", "first_missing")


def claim_key() -> list[Column]:
    """DED-1: the parts that make two facts one claim."""
    parts = ["subject_name", "predicate", "value_raw", "unit", "currency", "scale", "value_qualifier", "time_value", "scope"]
    quals = F.array_join(F.array_sort(F.transform(F.coalesce("qualifiers", F.array().cast("array<string>")), S.normalize_key)), "|")
    literal = [F.coalesce(F.col(c), F.lit("")).alias(f"k_{c}") for c in ("subject_type", "value_type", "time_type")]
    return [F.col("document_id"), *literal, *(S.normalize_key(F.col(c)).alias(f"k_{c}") for c in parts), quals.alias("k_qualifiers")]


def deduplicate_facts(facts: DataFrame) -> DataFrame:
    """DED-2: per document one fact per claim: the first stands for it, evidence is united, confidence the highest."""
    order = F.struct("extracted_at", "fact_id")
    # the evidence of one claim is a short list; hot claims are united by distinct id, not by row
    one = facts.select(*claim_key(), "fact_id", "confidence", "extracted_at", "evidence_ids")
    keys = [c for c in one.columns if c.startswith("k_") or c == "document_id"]
    heads = one.groupBy(*keys).agg(F.min_by("fact_id", order).alias("fact_id"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_facts"))
    named = one.select(*keys, F.explode("evidence_ids").alias("e")).where(F.col("e").isNotNull()).distinct()
    evidence = named.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("e")), ",").alias("evidence"))
    same = [heads[k].eqNullSafe(evidence[k]) for k in keys]
    return heads.join(evidence, same, "left").select(heads["document_id"], "fact_id", "confidence", "n_facts", F.coalesce("evidence", F.lit("")).alias("evidence"))


def check_pairs(pairs: DataFrame) -> DataFrame:
    """VAL-7, VAL-8: pairs with what is wrong with them."""
    label = F.regexp_replace(F.upper(S.strip(F.col("classification"))), r"[\s-]+", "_")
    errors = F.array(
        F.when(F.col("fact_a_id").isNull() | F.col("fact_b_id").isNull(), "missing id"),
        F.when(F.col("fact_a_id") == F.col("fact_b_id"), "fact compared with itself"),
        F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence out of range"),
        F.when(~label.isin("SAME_CLAIM", "RELATED_CLAIM", "NOT_MATCH", "UNCERTAIN"), "unknown classification"),
    )
    return pairs.withColumn("errors", F.array_join(F.filter(errors, lambda e: e.isNotNull()), "; "))


def check_relationships(relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """VAL-9, SET-3: relationships whose evidence of fact a is not evidence of that fact."""
    own = facts.where(F.col("fact_id").isNotNull()).groupBy("fact_id").agg(F.max_by("evidence_ids", F.struct("loaded_at", "value_raw")).alias("own"))
    rows = relationships.select("relationship_id", "fact_a_id", F.col("evidence.fact_a_evidence").alias("cited")).distinct()
    foreign = F.array_except(F.coalesce("cited", F.array().cast("array<string>")), F.coalesce("own", F.array().cast("array<string>")))
    return rows.join(own, rows["fact_a_id"] == own["fact_id"], "left").select("relationship_id", "fact_a_id", F.size(foreign).alias("n_foreign"))


def transitions() -> list[tuple[str, str]]:
    return list(V.TRANSITIONS)
