"""Queries of the claim-graph operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import scalar as S
from claimloom.operators import block, canonical, chain, compare, context, extract, knowledge, reason, select, validate
from claimloom.session import Staged, table

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return canonical.latest_elements(table(spark, d, "elements"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return compare.latest_facts(table(spark, d, "facts"))


@query
def normalize_text(spark, d):
    return _elements(spark, d).select("element_id", S.normalize_text(F.col("content")).alias("text"))


@query
def text_signals(spark, d):
    t = F.coalesce("content", F.lit(""))
    return _elements(spark, d).select("element_id", S.is_noise(t).alias("noise"), S.has_number(t).alias("number"), S.has_time(t).alias("time"), S.has_fact_word(t).alias("fact_word"), select.priority().alias("priority"))


@query
def select_candidates(spark, d):
    return select.select_candidates(_elements(spark, d)).select("element_id", "element_type", "priority")


@query
def reading_order(spark, d):
    return canonical.reading_order(_elements(spark, d)).select("element_id", F.col("reading_order").cast("long").alias("place"))


@query
def page_numbers(spark, d):
    return canonical.recovered_page_numbers(_elements(spark, d))


@query
def page_assembly(spark, d):
    return canonical.assemble_pages(_elements(spark, d))


@query
def table_parts(spark, d):
    t = canonical.canonical_tables(_elements(spark, d))
    return t.select("element_id", "caption", F.array_join("headers", "|").alias("headers"), F.coalesce(F.size("table_rows"), F.lit(0)).cast("long").alias("n_rows"), "source")


@query
def section_hierarchy(spark, d):
    return context.section_hierarchy(_elements(spark, d)).select("document_id", "canonical_order", F.array_join("headers", "|").alias("headers"))


@query
def neighbour_counts(spark, d):
    return context.neighbour_counts(_elements(spark, d))


@query
def quantities(spark, d):
    q = _elements(spark, d).select("element_id", F.posexplode(S.extract_quantities(F.coalesce("content", F.lit("")))).alias("place", "q"))
    return q.select("element_id", "q.value_raw", "q.unit", "q.currency", "q.scale", "q.qualifier", "q.value_type")


@query
def temporal_contexts(spark, d):
    return _elements(spark, d).select("element_id", S.temporal_context(F.coalesce("content", F.lit(""))).alias("t")).select("element_id", "t.time_type", F.col("t.value").alias("time_value"))


@query
def text_qualifiers(spark, d):
    t = F.coalesce("content", F.lit(""))
    return _elements(spark, d).select("element_id", F.array_join(S.qualifiers(t), "|").alias("qualifiers"), S.comparison_qualifier(t).alias("comparison"), S.verb_predicate(t).alias("verb"))


@query
def metric_predicates(spark, d):
    return table(spark, d, "facts").select("predicate").distinct().select("predicate", S.metric_predicate(F.col("predicate")).alias("metric"))


@query
def value_norms(spark, d):
    f = table(spark, d, "facts").select("currency", "unit", "scale", "value_raw").distinct()
    return f.select("currency", "unit", "scale", "value_raw", S.normalize_currency(F.col("currency")).alias("currency_norm"), S.normalize_unit(F.col("unit")).alias("unit_norm"), S.scale_multiplier(F.col("scale")).alias("mult"), S.parse_numeric(F.col("value_raw")).alias("value"))


@query
def time_norms(spark, d):
    f = table(spark, d, "facts").select("time_value").distinct().where("time_value is not null")
    t = F.col("time_value")
    return f.select("time_value", S.fiscal_year(t).alias("fy"), S.calendar_year(t).alias("cy"), S.quarter_number(t).alias("quarter"), S.date_number(t).alias("day"))


@query
def sentence_facts(spark, d):
    """Facts stated in sentences of elements and, in other words, by the facts themselves."""
    prose = _elements(spark, d).where(F.col("element_type").isin("paragraph", "text", "list_item", "footnote")).select("element_id", "content", "document_id")
    f = _facts(spark, d).where(F.col("predicate").isin("appointed_as", "resigned_as", "headquartered_at", "provides", "net_profit"))
    time = F.coalesce(F.regexp_extract("time_value", r"(\d{4})", 1), F.lit(""))
    value = F.regexp_replace("value_raw", r"[^\w .,₹$€£%-]", " ")
    said = (
        F.when(F.col("predicate") == "appointed_as", F.concat_ws(" ", F.col("subject_name"), F.lit("was appointed"), value, F.lit("in"), time))
        .when(F.col("predicate") == "resigned_as", F.concat_ws(" ", F.col("subject_name"), F.lit("resigned as"), value))
        .when(F.col("predicate") == "headquartered_at", F.concat_ws(" ", F.col("subject_name"), F.lit("is headquartered at"), value))
        .when(F.col("predicate") == "provides", F.concat_ws(" ", F.col("subject_name"), F.lit("provides"), value))
        .otherwise(F.concat_ws(" ", F.col("subject_name"), F.lit("reported net profit of"), F.coalesce("currency", F.lit("")), value, F.coalesce("scale", F.lit(""))))
    )
    rendered = f.select(F.col("fact_id").alias("element_id"), F.concat(said, F.lit(".")).alias("content"), "document_id")
    rows = prose.unionByName(rendered).withColumn("title", F.regexp_replace("document_id", "-", " ")).withColumn("header", F.lit(""))
    out = extract.build_facts(extract.sentence_facts(rows))
    return out.select("element_id", "fact_no", "subject", "subject_type", "predicate", "value_type", "value_raw", "unit", "currency", "scale", "time_type", "time_value", "confidence", "fact_type")


@query
def table_facts(spark, d):
    return extract.table_facts(canonical.canonical_tables(_elements(spark, d)))


@query
def figure_facts(spark, d):
    return extract.figure_facts(_elements(spark, d).where(F.col("element_type") == "figure"))


@query
def validate_facts(spark, d):
    checked = validate.validate_facts(_facts(spark, d), table(spark, d, "elements"))
    return checked.select("fact_id", "reason")


@query
def dedup_facts(spark, d):
    return validate.deduplicate_facts(_facts(spark, d))


@query
def index_keys(spark, d):
    return block.index_keys(block.index_facts(_facts(spark, d)))


def _classes(spark, d):
    return block.claim_classes(block.index_facts(_facts(spark, d)))


@query
def block_exact(spark, d):
    p = block.block_exact(_classes(spark, d))
    return p.groupBy("predicate_a").agg(F.count(F.lit(1)).alias("n_class_pairs"), F.sum("n_pairs").alias("n_pairs"))


@query
def block_intra_doc(spark, d):
    """Known subjects only, as its SQL has it; block_intra_all has all."""
    p = block.block_exact(_classes(spark, d).where(~block.is_general(F.col("norm_subject"))), cross_document=False)
    return p.groupBy("predicate_a").agg(F.count(F.lit(1)).alias("n_class_pairs"), F.sum("n_pairs").alias("n_pairs"))


@query
def block_intra_all(spark, d):
    """Exact pairs within and across documents, those of general subjects included."""
    p = block.block_exact(_classes(spark, d), cross_document=False)
    return p.groupBy("predicate_a").agg(F.count(F.lit(1)).alias("n_class_pairs"), F.sum("n_pairs").alias("n_pairs"))


@query
def block_compatible(spark, d):
    return block.block_compatible(_classes(spark, d)).select("class_a", "class_b", "n_pairs", "predicate_a", "predicate_b")


@query
def block_uncertain(spark, d):
    return block.block_uncertain(_classes(spark, d))


@query
def class_members(spark, d):
    return block.class_members(block.index_facts(_facts(spark, d)))


def _compared(spark, d):
    pairs = table(spark, d, "match_results").select("match_id", "fact_a_id", "fact_b_id").where("fact_a_id <> fact_b_id").distinct()
    # both sides of a pair read the prepared facts, so they are parsed once and written
    prepared = Staged(compare.prepare(_facts(spark, d)), "prepared-facts").df
    return compare.classify(compare.compare(compare.pair_up(pairs, prepared)))


def _related(spark, d):
    # matches are a table of their own, written before they are reasoned over
    return reason.relate(Staged(_compared(spark, d), "matches").df)


@query
def compare_pairs(spark, d):
    c = _compared(spark, d)
    return c.select("match_id", *(f"sig_{k}" for k in ("subject", "predicate", "fact_type", "time", "scope", "value", "unit", "qualifiers")), "classification", "confidence")


@query
def match_stats(spark, d):
    return _compared(spark, d).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


@query
def match_reasons(spark, d):
    return _compared(spark, d).select("match_id", F.array_join(compare.reasons(), "; ").alias("reasons"))


@query
def relationships_all(spark, d):
    r = _related(spark, d)
    return r.select("match_id", "relationship", "rel_confidence", "reason", "source_independence")


@query
def relationship_stats(spark, d):
    return reason.relationship_stats(_related(spark, d)).drop("avg_confidence")


@query
def disputed_claims(spark, d):
    """Which (entity, metric, period) claims do two sources disagree on?"""
    r = _related(spark, d).where((F.col("relationship") == "CONTRADICTS") & (F.col("source_independence") == "cross_document"))
    return r.groupBy(F.col("a.subject").alias("subject"), F.col("a.predicate").alias("predicate"), F.col("a.time_text").alias("period")).agg(F.count(F.lit(1)).alias("n_disputes"))


def _candidate_classes(spark, d, release=False):
    # both sides of a pair read the classes, so these are written; the facts are read once, by the classes
    return Staged(block.prepared_classes(compare.prepare(_facts(spark, d))), "candidate-classes", release=release).df


def _candidate_relations(pairs):
    m = compare.classify(compare.compare(pairs))
    read = ("fact_id", "document_id", "subject", "predicate", "value_type", "unit", "time_text", "confidence")
    side = lambda x: F.struct(*(F.col(f"{x}.{c}") for c in read)).alias(x)
    # written with the columns reasoning reads, as both steps in one exceed what one generated method may hold
    m = m.select(side("a"), side("b"), "pass_no", "n_pairs", "classification", *(c for c in m.columns if c.startswith("sig_")))
    return reason.relate(Staged(m, "candidate-matches").df)


@query
def block_all(spark, d):
    """Candidate pairs of facts per pass, pass 3 counted from its blocks."""
    classes = _candidate_classes(spark, d)
    passes = block.candidates(classes).groupBy("pass_no").agg(F.sum("n_pairs").alias("n_pairs"))
    third = block.uncertain_pairs(block.uncertain_members(classes)).agg(F.lit(3).alias("pass_no"), F.sum(F.col("n_with_known") + F.col("n_general")).alias("n_pairs"))
    return passes.unionByName(third.where("n_pairs > 0"))


@query
def uncertain_members(spark, d):
    return block.uncertain_members(_candidate_classes(spark, d))


@query
def uncertain_pairs(spark, d):
    return block.uncertain_pairs(block.uncertain_members(_candidate_classes(spark, d)))


@query
def candidate_members(spark, d):
    return block.prepared_members(compare.prepare(_facts(spark, d)))


@query
def candidate_relationships(spark, d):
    """Blocking, comparison and reasoning in one: every pair of classes of passes 1 and 2 with its relationship."""
    return chain.relations(chain.pairs(_candidate_classes(spark, d, release=True)))


@query
def candidate_stats(spark, d):
    """Fact pairs per relationship over all passes; those of pass 3 have an unknown subject, so all are unresolved."""
    classes = _candidate_classes(spark, d)
    related = _candidate_relations(block.candidates(classes)).select("relationship", "n_pairs")
    third = block.uncertain_pairs(block.uncertain_members(classes)).select(F.lit("UNRESOLVED").alias("relationship"), (F.col("n_with_known") + F.col("n_general")).alias("n_pairs"))
    return related.unionByName(third).groupBy("relationship").agg(F.sum("n_pairs").alias("n"))


@query
def candidate_disputes(spark, d):
    """Which (entity, metric, period) claims do two sources disagree on, over all candidate pairs?"""
    r = _candidate_relations(block.disputable(_candidate_classes(spark, d))).where("relationship = 'CONTRADICTS'")
    # either side may come first: the stated period wins over a blank one
    claim = [F.col("a.subject").alias("subject"), F.least("a.predicate", "b.predicate").alias("predicate"), F.greatest("a.time_text", "b.time_text").alias("period")]
    return r.groupBy(*claim).agg(F.sum("n_pairs").alias("n_disputes"))


@query
def pair_checks(spark, d):
    return validate.check_pairs(table(spark, d, "match_results")).groupBy("errors").agg(F.count(F.lit(1)).alias("n"))


@query
def relationship_checks(spark, d):
    c = validate.check_relationships(table(spark, d, "relationship_results"), table(spark, d, "facts"))
    return c.select("relationship_id", "fact_a_id", F.col("n_foreign").cast("long").alias("n_foreign"))


@query
def facts_page(spark, d):
    f = knowledge.fact_list(_facts(spark, d), predicate="Net_Profit")
    return knowledge.page(f.select("fact_id", "document_id", "value_raw"), ["fact_id"], 100, 50)


@query
def relationships_page(spark, d):
    r = knowledge.relationship_list(table(spark, d, "relationship_results"), "contradicts").select("relationship_id", "confidence").distinct()
    return knowledge.page(r, ["relationship_id"], 100)


@query
def document_results(spark, d):
    return knowledge.document_results(_facts(spark, d), table(spark, d, "relationship_results"))


@query
def evidence_lookup(spark, d):
    return knowledge.resolve_evidence(_facts(spark, d), table(spark, d, "elements")).select("fact_id", "evidence_id", "page_no")


SEARCH = "What was the net profit of Satabrin in fiscal 2024?"


@query
def kb_query(spark, d):
    return knowledge.search(_facts(spark, d), table(spark, d, "relationship_results"), SEARCH)[0].select("fact_id", "score")


@query
def kb_status(spark, d):
    return knowledge.answer_status(_facts(spark, d), table(spark, d, "relationship_results"), SEARCH)


@query
def kb_conflict_query(spark, d):
    return knowledge.answer_status(_facts(spark, d), table(spark, d, "relationship_results"), "Any discrepancy?")


@query
def relationship_distribution(spark, d):
    return knowledge.distribution(table(spark, d, "relationship_results"), "relationship")


@query
def systematic_sample(spark, d):
    r = table(spark, d, "relationship_results").where("relationship_id is not null").groupBy("relationship_id").agg(F.max("relationship").alias("relationship"))
    return knowledge.systematic_sample(r, ["relationship_id"]).select("relationship_id", "relationship", "sample_place")


@query
def first_per_relationship(spark, d):
    r = table(spark, d, "relationship_results").select("relationship", "relationship_id", "confidence")
    return knowledge.first_per(r, "relationship", ["relationship_id"])


@query
def reconciliation_validity(spark, d):
    return knowledge.reconciliation_validity(table(spark, d, "relationship_results"))


@query
def unresolved_validity(spark, d):
    return knowledge.unresolved_validity(table(spark, d, "relationship_results"), table(spark, d, "facts"))


@query
def contradiction_taxonomy(spark, d):
    r = table(spark, d, "relationship_results").where("relationship = 'CONTRADICTS'").select("fact_a_id")
    p = _facts(spark, d).select(F.col("fact_id").alias("fact_a_id"), "predicate")
    return r.join(p, "fact_a_id").groupBy(knowledge.taxonomy().alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query
def element_summary(spark, d):
    return _elements(spark, d).groupBy("document_id", "element_type").agg(F.count(F.lit(1)).alias("n"))
