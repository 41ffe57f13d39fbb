"""Index of facts and candidate generation by blocking.

Facts that state the same claim in the same words form a class; pairs are made
between representatives of classes, with class sizes, and membership is a table
of its own, so no link between different claims is lost while copies are not
expanded into all pairs.  Each pass is an equi-join, never one disjunction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import scalar as S
from claimloom.functions import vocab as V
from claimloom.operators.compare import LOOSE, NUMERIC, TEXT, compatible_predicates, types_compatible


def index_facts(facts: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """IDX-1: normalised subject and predicate of every fact."""
    subject = S.resolve_subject(F.col("subject_name"), F.col("document_id"), aliases or {})
    return facts.where(F.col("fact_id").isNotNull()).withColumns({"norm_subject": subject, "norm_predicate": S.normalize_key(F.col("predicate"))})


def index_keys(indexed: DataFrame) -> DataFrame:
    """IDX-6: facts and documents per (subject, predicate)."""
    return indexed.groupBy("norm_subject", "norm_predicate").agg(F.countDistinct("fact_id").alias("n_facts"), F.countDistinct("document_id").alias("n_documents"))


def look_up(indexed: DataFrame, subject: str | None = None, predicate: str | None = None, document_id: str | None = None) -> DataFrame:
    """IDX-3..5, IDX-7: equality filters; keys given are normalised like the index."""
    out = indexed
    if subject is not None:
        out = out.where(F.col("norm_subject") == subject.strip().lower())
    if predicate is not None:
        out = out.where(F.col("norm_predicate") == predicate.strip().lower())
    if document_id is not None:
        out = out.where(F.col("document_id") == document_id)
    return out


_CLASS = ["document_id", "norm_subject", "norm_predicate", "fact_type", "value_type", "value_raw", "unit", "currency", "scale", "time_value", "scope"]


def claim_classes(indexed: DataFrame) -> DataFrame:
    """(class columns, class_id, n_members): facts of a document that say the same in the same words."""
    return indexed.groupBy(*_CLASS).agg(F.min("fact_id").alias("class_id"), F.countDistinct("fact_id").alias("n_members"))


def class_members(indexed: DataFrame) -> DataFrame:
    """(class_id, fact_id) of every fact."""
    classes = claim_classes(indexed)
    same = [indexed[c].eqNullSafe(classes[c]) for c in _CLASS]
    return indexed.join(classes, same).select(classes["class_id"], indexed["fact_id"]).distinct()


def is_general(c: Column) -> Column:
    return (c == "") | c.isin(*V.GENERIC_SUBJECTS)


def exact_subject(c: Column, cross_document: bool) -> Column:
    """Whether a subject makes exact pairs; blank ones never do, they are left to JN-4."""
    return ~is_general(c) if cross_document else c != ""


def _pairs(a: DataFrame, b: DataFrame, on: Column, cross_document: bool, ordered: bool = True) -> DataFrame:
    x, y = a.alias("a"), b.alias("b")
    rest = types_compatible(F.col("a.fact_type"), F.col("b.fact_type"), F.col("a.value_type"), F.col("b.value_type"))
    if ordered:
        rest = rest & (F.col("a.class_id") < F.col("b.class_id"))
    if cross_document:
        rest = rest & (F.col("a.document_id") != F.col("b.document_id"))
    return x.join(y, on & rest).select(
        F.col("a.class_id").alias("class_a"), F.col("b.class_id").alias("class_b"), (F.col("a.n_members") * F.col("b.n_members")).alias("n_pairs"), F.col("a.norm_predicate").alias("predicate_a"), F.col("b.norm_predicate").alias("predicate_b")
    )


def block_exact(classes: DataFrame, cross_document: bool = True) -> DataFrame:
    """JN-1: same subject and same predicate; across documents only known subjects mean the same."""
    known = classes.where(exact_subject(F.col("norm_subject"), cross_document) & (F.col("norm_predicate") != ""))
    on = (F.col("a.norm_subject") == F.col("b.norm_subject")) & (F.col("a.norm_predicate") == F.col("b.norm_predicate"))
    return _pairs(known, known, on, cross_document)


def block_compatible(classes: DataFrame, cross_document: bool = True) -> DataFrame:
    """JN-2: same known subject, predicates that may be compared."""
    table = compatible_predicates()
    other = S.literal_map({k: "|".join(v) for k, v in table.items()})
    left = classes.where(~is_general(F.col("norm_subject")) & F.col("norm_predicate").isin(*table))
    left = left.withColumn("other", F.explode(F.split(F.try_element_at(other, F.col("norm_predicate")), r"\|")))
    on = (F.col("a.norm_subject") == F.col("b.norm_subject")) & (F.col("a.other") == F.col("b.norm_predicate"))
    return _pairs(left, classes, on, cross_document)


def block_uncertain(classes: DataFrame, cross_document: bool = True) -> DataFrame:
    """JN-3, JN-4: per predicate, how many pairs have a general subject on one or both sides.

    A general subject fits every subject, so all of a predicate's facts are its
    partners; the pairs are counted by their block instead of being written out, before
    JN-6.  ``uncertain_members`` holds both member lists, ``uncertain_pairs`` counts after JN-6.
    """
    # block totals less the pairs within one document
    per_doc = classes.where(F.col("norm_predicate") != "").groupBy("norm_predicate", "document_id").agg(
        F.sum(F.when(is_general(F.col("norm_subject")), F.col("n_members")).otherwise(0)).alias("general"),
        F.sum(F.when(is_general(F.col("norm_subject")), 0).otherwise(F.col("n_members"))).alias("known"),
    )
    g, k = F.sum("general"), F.sum("known")
    own_gk, own_gg = F.sum(F.col("general") * F.col("known")), F.sum(F.col("general") * F.col("general"))
    if cross_document:
        known_pairs, general_pairs = g * k - own_gk, (g * g - own_gg) / 2
    else:
        known_pairs, general_pairs = g * k, g * (g - 1) / 2
    return per_doc.groupBy("norm_predicate").agg(known_pairs.cast("long").alias("n_with_known"), general_pairs.cast("long").alias("n_general"))


def prepared_classes(prepared: DataFrame) -> DataFrame:
    """Prepared facts alike in all that comparisons read: one row each under the least fact_id, with n_members.

    Every member compares with everything as its representative does.
    """
    same = [c for c in prepared.columns if c != "fact_id"]
    return prepared.groupBy(*same).agg(F.min("fact_id").alias("fact_id"), F.count(F.lit(1)).alias("n_members"))


def prepared_members(prepared: DataFrame) -> DataFrame:
    """(class_id, fact_id) of every prepared fact."""
    same = [c for c in prepared.columns if c != "fact_id"]
    return prepared.select(F.min("fact_id").over(Window.partitionBy(*same)).alias("class_id"), "fact_id")


def candidates(classes: DataFrame) -> DataFrame:
    """JN-5 over JN-1 and JN-2, across documents: (a, b, pass_no, n_pairs) for pairs of prepared classes.

    A class is looked up under its own predicate (pass 1) and under those it may be
    compared with (pass 2); b has one predicate, so a pair meets in one pass only, the
    first it belongs to, and needs no distinct.  Pass 3 is left to ``uncertain_members``:
    its pairs have no subject in common with passes 1 and 2, and all are unresolved.
    """
    return _candidates(classes, F.lit(True))


def typed_period() -> Column:
    """The day or year that a prepared period names in whatever words, or null; two of one type are the same if these are."""
    t, c = F.col("time_type"), F.col
    return (
        F.when(t.isin("specific_date", "as_of_date"), F.concat(F.lit("d"), c("day").cast("string")))
        .when(t == "fiscal_year", F.concat(F.lit("f"), c("fy").cast("string")))
        .when(t == "calendar_year", F.concat(F.lit("c"), c("cy").cast("string")))
    )


def disputable(classes: DataFrame) -> DataFrame:
    """The rows of ``candidates`` that can be a contradiction; the others are never written.

    A contradiction has one stated scope and equal qualifiers on both sides, which are keys
    of the join (qualifiers by a hash; the comparison decides), and by CMP-4 the same period
    or none on a side: the same text or, in other words, the same day or year.
    """
    t, c = F.col("time_type"), F.col
    more = {"_quals": F.xxhash64("quals"), "_none": (t == "unknown") | (c("time_text") == ""), "_words": S.strip(c("time_text")), "_typed": typed_period()}
    same = c("x._none") | c("y._none") | (c("x._words") == c("y._words")) | F.coalesce(c("x._typed") == c("y._typed"), F.lit(False))
    on = (c("x.scope") == c("y.scope")) & (c("x._quals") == c("y._quals")) & same
    return _candidates(classes.where(c("scope") != "unknown"), on, more)


def known_classes(classes: DataFrame) -> DataFrame:
    """The classes that passes 1 and 2 pair."""
    return classes.where(~is_general(F.col("subject")) & (F.col("predicate") != ""))


def _candidates(classes: DataFrame, more: Column, columns: dict[str, Column] | None = None) -> DataFrame:
    other = S.literal_map({k: "|".join(v) for k, v in compatible_predicates().items()})
    rows = known_classes(classes).withColumns(columns or {})
    keys = F.split(F.concat_ws("|", F.col("predicate"), F.try_element_at(other, F.col("predicate"))), r"\|")
    x, y = rows.withColumn("key", F.explode(F.when(F.col("predicate").isin(*compatible_predicates()), keys).otherwise(F.array("predicate")))).alias("x"), rows.alias("y")
    on = (F.col("x.subject") == F.col("y.subject")) & (F.col("x.key") == F.col("y.predicate")) & (F.col("x.fact_id") < F.col("y.fact_id")) & (F.col("x.document_id") != F.col("y.document_id"))
    on = on & types_compatible(F.col("x.fact_type"), F.col("y.fact_type"), F.col("x.value_type"), F.col("y.value_type"))
    # sides are made after the join, so that no column crosses it twice
    side = lambda x: F.struct(*[F.col(f"{x}.{c}") for c in classes.columns if c != "n_members"])
    # the further conditions leave most pairs out, so they are tried first
    return x.join(y, more & on).select(
        side("x").alias("a"), side("y").alias("b"), F.when(F.col("x.key") == F.col("x.predicate"), 1).otherwise(2).alias("pass_no"), (F.col("x.n_members") * F.col("y.n_members")).alias("n_pairs")
    )


def _value_kind() -> Column:
    v = F.col("value_type")
    return F.when(v.isin(*NUMERIC), "numeric").when(v.isin(*TEXT), "text").otherwise("other")


def uncertain_members(classes: DataFrame) -> DataFrame:
    """JN-3, JN-4 in linear form: every prepared class under its predicate and type group, with its side.

    The candidates are the pairs of one predicate, different documents and fitting type
    groups with at least one general side; fact_type and value_kind decide JN-6.
    """
    side = F.when(is_general(F.col("subject")), "general").otherwise("known")
    rows = classes.where(F.col("predicate") != "")
    return rows.select("predicate", "fact_type", _value_kind().alias("value_kind"), side.alias("side"), "document_id", F.col("fact_id").alias("class_id"), "n_members")


def uncertain_pairs(members: DataFrame) -> DataFrame:
    """How many fact pairs across documents the blocks of JN-3 and JN-4 hold, per predicate, after JN-6.

    All pairs of fitting type groups less those within one document; only counts per
    type group are joined, so the work does not grow with the pairs.
    """
    n = lambda side: F.sum(F.when(F.col("side") == side, F.col("n_members")).otherwise(0))
    groups = ["fact_type", "value_kind"]
    # documents that are null lie outside every pair, as in the passes
    per_doc = members.where(F.col("document_id").isNotNull()).groupBy("predicate", "document_id", *groups).agg(n("general").alias("general"), n("known").alias("known"))
    total = per_doc.groupBy("predicate", *groups).agg(F.sum("general").alias("general"), F.sum("known").alias("known"))

    def products(d: DataFrame, keys: list[str], sign: int) -> DataFrame:
        x, y = d.alias("x"), d.alias("y")
        c = F.col
        same = lambda k: c("x.value_kind").eqNullSafe(k) & c("y.value_kind").eqNullSafe(k)
        fits = F.coalesce(c("x.fact_type") == c("y.fact_type"), F.lit(False)) | same("numeric") | same("text") | F.coalesce(c("x.fact_type").isin(*LOOSE) & c("y.fact_type").isin(*LOOSE), F.lit(False))
        on = fits & (c("x.general") > 0)
        for k in keys:
            on = on & (c(f"x.{k}") == c(f"y.{k}"))
        return x.join(y, on).select(c("x.predicate").alias("predicate"), (c("x.general") * c("y.known") * sign).alias("gk"), (c("x.general") * c("y.general") * sign).alias("gg"))

    both = products(total, ["predicate"], 1).unionByName(products(per_doc, ["predicate", "document_id"], -1))
    out = both.groupBy("predicate").agg(F.sum("gk").cast("long").alias("n_with_known"), F.expr("sum(gg) div 2").alias("n_general"))
    return out.where((F.col("n_with_known") > 0) | (F.col("n_general") > 0))
