"""Views over facts and relationships: paging, evidence, keyword search, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import scalar as S
from claimloom.functions import vocab as V


def page(df: DataFrame, order: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """QRY-1, QRY-3: one page in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def fact_list(facts: DataFrame, document_id: str | None = None, predicate: str | None = None) -> DataFrame:
    out = facts
    if document_id:
        out = out.where(F.col("document_id") == document_id)
    if predicate:
        out = out.where(F.lower("predicate") == predicate.lower())
    return out


def relationship_list(relationships: DataFrame, kind: str | None = None, documents: list[str] | None = None) -> DataFrame:
    """QRY-3, JN-14: by type; touching any of the documents on either side."""
    out = relationships
    if kind:
        out = out.where(F.col("relationship") == kind.upper())
    if documents:
        out = out.where(F.col("document_a_id").isin(documents) | F.col("document_b_id").isin(documents))
    return out


def document_results(facts: DataFrame, relationships: DataFrame) -> DataFrame:
    """QRY-5, QRY-6: per document its facts and the relationships touching it."""
    n_facts = facts.groupBy("document_id").agg(F.countDistinct("fact_id").alias("n_facts"))
    touching = relationships.select("relationship_id", F.explode(F.array_distinct(F.array("document_a_id", "document_b_id"))).alias("document_id")).where("document_id is not null")
    n_rel = touching.groupBy("document_id").agg(F.countDistinct("relationship_id").alias("n_relationships"))
    out = n_facts.join(n_rel, "document_id", "full")
    return out.select("document_id", F.coalesce("n_facts", F.lit(0)).alias("n_facts"), F.coalesce("n_relationships", F.lit(0)).alias("n_relationships"))


def resolve_evidence(facts: DataFrame, elements: DataFrame) -> DataFrame:
    """JN-12: page and text of the first evidence id that is known; else the page its first id spells."""
    ids = F.array_distinct(F.concat(F.array("element_id"), F.coalesce("evidence_ids", F.array().cast("array<string>"))))
    index = elements.select(F.explode(ids).alias("evidence_id"), "page_no", F.coalesce(S.blank_to_null(F.col("content")), F.col("caption")).alias("text"), "ingested_at")
    index = index.where(F.col("evidence_id").isNotNull()).groupBy("evidence_id").agg(F.max_by(F.struct("page_no", "text"), F.struct("ingested_at", "page_no", F.coalesce("text", F.lit("")))).alias("e"))
    named = facts.select("fact_id", F.posexplode_outer(F.array_distinct("evidence_ids")).alias("pos", "evidence_id")).distinct()
    joined = named.join(index, "evidence_id", "left")
    known = F.when(F.col("e").isNotNull(), F.struct("pos", "evidence_id"))
    spelt = F.regexp_extract(F.min_by("evidence_id", "pos"), r":p(\d{1,6}):", 1)
    return joined.groupBy("fact_id").agg(
        F.min_by("evidence_id", known).alias("evidence_id"),
        F.coalesce(F.min_by(F.col("e.page_no"), known), S.blank_to_null(spelt).cast("int")).alias("page_no"),
        F.min_by(F.col("e.text"), known).alias("evidence_text"),
    )


def score_facts(facts: DataFrame, query: str) -> DataFrame:
    """QRY-7: facts with their score for a query; the query is tokenised once, on the driver."""
    text, tokens = query.strip().lower(), S.query_tokens(query)
    arr = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<string>")
    long_tokens = [t for t in tokens if len(t) >= 4]
    synonyms = sorted({p for t in tokens for p in V.SYNONYMS.get(t, ())})
    predicate, subject = F.lower("predicate"), F.lower("subject_name")
    phrase = F.replace(predicate, F.lit("_"), F.lit(" "))
    wordy = ~predicate.rlike(r"^\d+$")
    by_predicate = (
        F.when(wordy & (F.length(predicate) >= 3) & F.lit(text).contains(phrase), 40)
        .when(wordy & predicate.isin(tokens), 35)
        .when(predicate.isin(synonyms), 25)
        .when(wordy & (F.length(predicate) >= 4) & F.arrays_overlap(F.split(phrase, r"\s+"), arr(long_tokens)), 15)
        .otherwise(0)
    )
    in_subject = S.any_of([F.contains(subject, F.lit(t)) for t in long_tokens]) if long_tokens else F.lit(False)
    by_subject = F.when(subject.isin(tokens), 15).when((F.length(subject) >= 4) & in_subject, 8).otherwise(0)
    times = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("time_value", F.lit(""))), F.lit(r"\b[a-z0-9]+\b"), F.lit(0)))
    by_time = F.size(F.array_intersect(times, arr([t for t in tokens if t not in V.QUERY_TIME]))) * 15
    by_scope = F.when(F.lower("scope").isin([t for t in tokens if len(t) >= 3]), 8).otherwise(0)
    value = F.lower("value_raw")
    by_value = F.when((F.length(value) >= 2) & value.isin(tokens), 10).otherwise(0)
    total = sum((F.coalesce(x, F.lit(0)) for x in (by_subject, by_time, by_scope, by_value)), F.coalesce(by_predicate, F.lit(0)))
    return facts.withColumn("score", total).where(F.col("score") >= 15)


def search(facts: DataFrame, relationships: DataFrame, query: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """QRY-8, QRY-10, JN-15: the best facts and the relationships that matter for them."""
    top = score_facts(facts, query).orderBy(F.desc("score"), "fact_id").limit(k)
    # k rows
    ids = F.broadcast(top.select("fact_id"))
    a = ids.select(F.col("fact_id").alias("fact_a_id"), F.lit(True).alias("in_a"))
    b = ids.select(F.col("fact_id").alias("fact_b_id"), F.lit(True).alias("in_b"))
    r = relationships.join(a, "fact_a_id", "left").join(b, "fact_b_id", "left")
    telling = F.col("relationship").isin("CONTRADICTS", "CORROBORATES", "CONTEXTUALLY_RECONCILED")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    one = F.col("in_a").isNotNull() | F.col("in_b").isNotNull()
    return top, r.where(both | (one & telling)).drop("in_a", "in_b")


def answer_status(facts: DataFrame, relationships: DataFrame, query: str) -> DataFrame:
    """One row: status and counts of the answer; QRY-9 where no fact fits a query about conflicts."""
    top, related = search(facts, relationships, query)
    clash = relationships.where(F.col("relationship") == "CONTRADICTS").limit(5)
    about_conflict = any(w in query.lower() for w in V.CONFLICT_WORDS)
    n = top.agg(F.count(F.lit(1)).alias("n_facts"))
    r = related.agg(F.count(F.lit(1)).alias("n_related"), F.count_if(F.col("relationship") == "CONTRADICTS").alias("n_contradicting"))
    c = clash.agg(F.count(F.lit(1)).alias("n_conflicts"))
    # three rows of one aggregate each
    one = n.crossJoin(r).crossJoin(c)
    conflict = (F.col("n_facts") == 0) & F.lit(about_conflict) & (F.col("n_conflicts") > 0)
    status = F.when(conflict, "contradiction_found").when(F.col("n_facts") == 0, "no_results").when(F.col("n_contradicting") > 0, "contradiction_found").otherwise("answered")
    return one.select(F.lit(query).alias("query"), status.alias("status"), "n_facts", "n_related", "n_contradicting")


# --- audit --------------------------------------------------------------------------


def distribution(df: DataFrame, column: str) -> DataFrame:
    """AGG-2: counts and percentages."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    # one row per distinct label
    return counts.withColumn("pct", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(1))), 2))


def systematic_sample(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """AGG-4: every step-th row in a total order, n rows; the sample is the feature.

    Ranks come from a range-partitioned sort: rows before each partition are counted,
    so no task sees more than its share.
    """
    spark = df.sparkSession
    ranked = df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    from claimloom.session import Staged

    staged = Staged(ranked, "sample").df
    sizes = sorted((r._p, r["count"]) for r in staged.groupBy("_p").count().collect())  # one row per partition
    before, total = {}, 0
    for p, c in sizes:
        before[p], total = total, total + c
    if not total:
        return df.limit(0)
    starts = spark.createDataFrame([(p, b) for p, b in before.items()], "_p int, _b long")
    step = max(1, total // n)
    place = F.col("_b") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    return staged.join(F.broadcast(starts), "_p").withColumn("sample_place", place).where((F.col("sample_place") % step == 0) & (F.col("sample_place") < step * n)).drop("_p", "_i", "_b")


def first_per(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """AGG-5, AGG-10: the first row of each key, by an aggregation."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def reconciliation_validity(relationships: DataFrame) -> DataFrame:
    """AGG-6: how many reconciled relationships state what reconciles them."""
    c = lambda k: F.col(f"comparison.{k}")
    valid = c("time").isin("different", "overlapping", "contained") | (c("scope") == "different") | F.contains(F.lower("reason"), F.lit("dimension")) | (c("status") == "status_transition")
    rows = relationships.where(F.col("relationship") == "CONTEXTUALLY_RECONCILED")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(valid, F.lit(False))).alias("n_valid"))


def unresolved_validity(relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """AGG-7, AGG-8: the share of unresolved relationships whose subject is unknown or general."""
    names = facts.groupBy("fact_id").agg(F.max_by(S.normalize_key(F.col("subject_name")), F.struct("loaded_at", "value_raw")).alias("subject"))
    rows = relationships.where(F.col("relationship") == "UNRESOLVED").select("fact_a_id", F.col("comparison.subject").alias("sig"))
    joined = rows.join(names, rows["fact_a_id"] == names["fact_id"], "left")
    valid = F.coalesce(F.col("sig") == "unknown", F.lit(False)) | F.coalesce(F.col("subject").isin(*V.GENERIC_SUBJECTS), F.lit(False))
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("n_valid"), F.round(F.avg(valid.cast("double")), 6).alias("share_valid"))


def taxonomy() -> Column:
    """AGG-3: the kind of a contradiction, by its predicate."""
    p = F.lower("predicate")
    return (
        F.when(p.rlike("^[1-7]$"), "footnote number")
        .when(p.isin("of_revenue", "fy24", "fy23") | p.contains("as_of_end_of"), "header fragment")
        .when(p.isin("acquired", "provides"), "generic predicate")
        .when(p.rlike("^i{1,3}_"), "roman numeral")
        .otherwise("other")
    )
