"""Queries of the training-data operators of the core: units, orphans, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import nested, orphans, units
from claimloom.session import scratch_path, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every measured quantity of facts in its common unit."""
    q = units.read_quantities(table(spark, sf_dir, "facts"), units.table_captions(table(spark, sf_dir, "elements")))
    return q.select("fact_id", "common_unit", units.common_milli(F.col("common_value")).alias("common_milli"))


def p1_non_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities that the identities do not settle, per unit and source of the unit."""
    q = units.read_quantities(table(spark, sf_dir, "facts"), units.table_captions(table(spark, sf_dir, "elements")))
    return q.groupBy("common_unit", "source").agg(
        F.count(F.lit(1)).alias("n_facts"), F.count_if("ambiguous").alias("n_ambiguous"), F.count_if(F.col("log_residual") > 0.02).alias("n_unfit")
    )


def p1_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that are off the other facts of their claim by just a scale."""
    q = units.read_quantities(table(spark, sf_dir, "facts"), units.table_captions(table(spark, sf_dir, "elements")))
    return units.suspect_scales(q).select("fact_id", "common_unit", units.common_milli(F.col("common_value")).alias("common_milli"), "factor")


def _orphan_state(spark: SparkSession, sf_dir: str) -> orphans.OrphanState:
    facts = table(spark, sf_dir, "facts")
    return orphans.fold_by_month(
        orphans.fact_graph_references(facts, table(spark, sf_dir, "relationship_results")),
        orphans.fact_graph_parents(table(spark, sf_dir, "elements"), facts),
        scratch_path(spark, "orphans"),
    ).state()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a live target at their time."""
    return _orphan_state(spark, sf_dir).unmet()


def p5_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference counts per table, column, month and status."""
    return _orphan_state(spark, sf_dir).snapshot()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent and child keys of every node of readable payloads."""
    return nested.flat_links(table(spark, sf_dir, "raw_records"))


def p6_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat element table with the key of its page."""
    nodes = nested.label_nodes(table(spark, sf_dir, "raw_records"))
    return nested.entity_table(
        nodes, "element", "page", "type string, canonical_order int, raw_order int, content string, raw_content string, caption string, evidence_ids array<string>"
    ).select("record_id", "pre", "post", "parent_key", "own_key", "type", "canonical_order", "content", F.array_join("evidence_ids", ",").alias("evidence_ids")).distinct()


def p6_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose payload cannot be read."""
    return nested.unreadable_records(table(spark, sf_dir, "raw_records"))


QUERIES = {f.__name__: f for f in (p1_found, p1_non_unique, p1_suspects, p5_found, p5_snapshot, p6_found, p6_elements, p6_unreadable)}

_REFS = """
refs_all AS (
  SELECT 'facts' AS ref_table, 'evidence_ids' AS ref_column, fact_id AS row_id, 'elements' AS target, e AS ref_id, extracted_at AS ref_at
  FROM (SELECT fact_id, extracted_at, unnest(list_distinct(list_transform(evidence_ids, lambda x: lower(trim(x))))) AS e FROM facts) WHERE e IS NOT NULL
  UNION ALL
  SELECT 'relationship_results', 'fact_a_id', relationship_id, 'facts', lower(trim(fact_a_id)), reasoned_at
  FROM relationship_results WHERE fact_a_id IS NOT NULL
  UNION ALL
  SELECT 'relationship_results', 'fact_b_id', relationship_id, 'facts', lower(trim(fact_b_id)), reasoned_at
  FROM relationship_results WHERE fact_b_id IS NOT NULL
),
refs AS (
  SELECT DISTINCT 'facts' AS ref_table, 'evidence_ids' AS ref_column, fact_id AS row_id, 'elements' AS target,
         lower(trim(e)) AS ref_id, extracted_at AS ref_at
  FROM (SELECT fact_id, extracted_at, unnest(evidence_ids) AS e FROM facts) WHERE e IS NOT NULL
  UNION ALL
  SELECT 'relationship_results', 'fact_a_id', relationship_id, 'facts', lower(trim(fact_a_id)), reasoned_at
  FROM relationship_results WHERE fact_a_id IS NOT NULL
  UNION ALL
  SELECT 'relationship_results', 'fact_b_id', relationship_id, 'facts', lower(trim(fact_b_id)), reasoned_at
  FROM relationship_results WHERE fact_b_id IS NOT NULL
),
live AS (
  SELECT target, ref_id, min(came) AS live_at FROM (
    SELECT 'elements' AS target, lower(trim(element_id)) AS ref_id, ingested_at AS came, is_deleted FROM elements
    UNION ALL
    SELECT 'elements', lower(trim(e)), ingested_at, is_deleted FROM (SELECT unnest(evidence_ids) AS e, ingested_at, is_deleted FROM elements)
    UNION ALL
    SELECT 'facts', lower(trim(fact_id)), loaded_at, is_deleted FROM facts)
  WHERE NOT coalesce(is_deleted, false) GROUP BY ALL
)
"""

ORACLE = {
    "p5_found": f"""
WITH {_REFS}
SELECT DISTINCT ref_table, ref_column, row_id, r.ref_id, strftime(ref_at, '%Y-%m') AS ref_month
FROM refs r LEFT JOIN live l ON r.target = l.target AND r.ref_id = l.ref_id
WHERE NOT coalesce(l.live_at <= r.ref_at, false)
""",
    "p5_snapshot": f"""
WITH {_REFS},
latest AS (
  SELECT target, ref_id, arg_max(gone, (came, NOT gone)) AS gone FROM (
    SELECT 'elements' AS target, lower(trim(element_id)) AS ref_id, ingested_at AS came, coalesce(is_deleted, false) AS gone FROM elements
    UNION ALL
    SELECT 'elements', lower(trim(e)), ingested_at, coalesce(is_deleted, false) FROM (SELECT unnest(evidence_ids) AS e, ingested_at, is_deleted FROM elements)
    UNION ALL
    SELECT 'facts', lower(trim(fact_id)), loaded_at, coalesce(is_deleted, false) FROM facts) GROUP BY ALL)
SELECT ref_table, ref_column, strftime(ref_at, '%Y-%m') AS ref_month,
  CASE WHEN l.live_at IS NULL THEN 'orphan' WHEN t.gone THEN 'reopened' WHEN l.live_at <= r.ref_at THEN 'linked' ELSE 'resolved' END AS status,
  count(*) AS n_refs, count(*) FILTER (NOT coalesce(l.live_at <= r.ref_at, false)) AS n_unmet
FROM refs_all r LEFT JOIN live l ON r.target = l.target AND r.ref_id = l.ref_id LEFT JOIN latest t ON r.target = t.target AND r.ref_id = t.ref_id
GROUP BY ALL
""",
    "p6_unreadable": "SELECT DISTINCT record_id FROM raw_records WHERE payload IS NULL OR NOT json_valid(payload)",
}
