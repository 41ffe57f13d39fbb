"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import areas, groups, leakage, names, packing, pages
from claimloom.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of spellings of one company, person or predicate."""
    return names.linked_spellings(table(spark, sf_dir, "facts"))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per entity: how many spellings and facts, and its most frequent spelling."""
    facts = table(spark, sf_dir, "facts")
    groups_ = names.link_names(names.subject_names(facts))
    counts = facts.groupBy(F.col("subject_name").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return (
        groups_.join(counts, "s")
        .groupBy("group_id")
        .agg(F.max_by("s", F.struct("n", "s")).alias("usual_name"), F.count(F.lit(1)).alias("n_spellings"), F.sum("n").alias("n_facts"))
        .drop("group_id")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restored words, removed lines and joined pages of body elements."""
    return pages.repair_pages(table(spark, sf_dir, "elements"), titles=table(spark, sf_dir, "source_docs"))


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired text itself: one row per continuous paragraph."""
    return pages.paragraphs(table(spark, sf_dir, "elements"), titles=table(spark, sf_dir, "source_docs"))


def p3_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of repair is made in each document."""
    found = p3_found(spark, sf_dir)
    ids = table(spark, sf_dir, "elements").select("element_id", "document_id").distinct()
    return found.join(ids, "element_id").groupBy("document_id", "repair").agg(F.count(F.lit(1)).alias("n_pieces"), F.countDistinct("element_id").alias("n_elements"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every fact in a pair judged to be the same claim."""
    return groups.same_claim_groups(table(spark, sf_dir, "match_results"))


def p4_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = groups.same_claim_groups(table(spark, sf_dir, "match_results")).groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return sizes.groupBy("group_size").agg(F.count(F.lit(1)).alias("n_groups"))


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r.container: r.capacity_tokens for r in table(spark, sf_dir, "pack_sizes").collect()}


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of every piece of every text, for each capacity."""
    return packing.pack(table(spark, sf_dir, "documents"), _capacities(spark, sf_dir))


def p7_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unused space per capacity."""
    capacities = _capacities(spark, sf_dir)
    return packing.fill_report(packing.pack(table(spark, sf_dir, "documents"), capacities), capacities)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry at least a third of an item's words in copied stretches."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items")).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each leaked item is in, and how much of it at most."""
    leaks = leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items"))
    return leaks.groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.max("copied_words").alias("most_words"), F.round(F.max("alignment"), 4).alias("best_alignment")
    )


def p8_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage that aligns with an item: copies, edited or not, and how far."""
    return leakage.edited_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items")).select("doc_id", "item_id", F.round("alignment", 4).alias("alignment"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject areas of every document."""
    return areas.document_areas(*(table(spark, sf_dir, t) for t in ("documents", "area_labels", "subject_areas")))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents and characters of each source fall to each area."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n")).dropDuplicates(["doc_id"])
    return docs.join(p9_found(spark, sf_dir), "doc_id").groupBy("area", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_chars"))


QUERIES = {f.__name__: f for f in (p2_found, p2_entities, p3_found, p3_repairs, p3_paragraphs, p4_found, p4_sizes, p7_packed, p7_unused, p8_found, p8_items, p8_edited, p9_found, p9_composition)}

_P4 = """
WITH RECURSIVE e AS (
  SELECT fact_a_id AS a, fact_b_id AS b FROM match_results
  WHERE regexp_replace(regexp_replace(upper(trim(classification)), '^.*[.]', ''), '[ _-]+', '_', 'g') = 'SAME_CLAIM'
    AND fact_a_id IS NOT NULL AND fact_b_id IS NOT NULL),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a)
"""

_WORDS = """regexp_extract_all(regexp_replace(regexp_replace(translate(lower(coalesce(text, '')), '\'\'’`´', ''),
  '([\\p{L}\\p{N}_])[-\u2010\u2011\u00ad](?:[ \\t]*\\r?\\n[ \\t]*)?([\\p{L}\\p{N}_])', '\\1\\2', 'g'),
  '([\\p{L}\\p{N}_])[-\u2010\u2011\u00ad](?:[ \\t]*\\r?\\n[ \\t]*)?([\\p{L}\\p{N}_])', '\\1\\2', 'g'), '[\\p{L}\\p{N}]+')"""
_P8 = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM heldout_items),
g AS (SELECT item_id, len(w) AS n, unnest(range(1, len(w) - 3)) AS k, w FROM i WHERE len(w) >= 5),
ig AS (SELECT item_id, n, k, array_to_string(w[k:k + 4], ' ') AS gram FROM g),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)),
c AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(k, k + 5)) AS place FROM dg JOIN ig USING (gram))
SELECT doc_id, item_id FROM c GROUP BY doc_id, item_id, n HAVING count(*) * 3 >= n
"""

ORACLE: dict[str, str] = {
    "p4_found": _P4 + "SELECT a AS fact_id, min(b) AS group_id FROM reach GROUP BY a",
    "p4_sizes": _P4 + ", f AS (SELECT a, min(b) AS g FROM reach GROUP BY a), s AS (SELECT g, count(*) AS group_size FROM f GROUP BY g) SELECT group_size, count(*) AS n_groups FROM s GROUP BY group_size",
    "p8_found": _P8,
}
