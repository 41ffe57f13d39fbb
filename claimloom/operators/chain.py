"""Candidate pairs and their relationships in one step, with little work per pair.

The pairs of a subject grow with the square of its facts, so all that one side decides
alone is found once per class (``sides``).  A pair then compares numbers and short texts;
its steps stay small enough to be compiled, and no pair is written but in the result.
Same results as ``reason.relate(compare.classify(compare.compare(block.candidates(...))))``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import scalar as S
from claimloom.functions import vocab as V
from claimloom.operators import block, reason
from claimloom.operators.compare import LOOSE, NUMERIC, TEXT, compatible, compatible_predicates, transition

_NUMBER, _TEXT, _LOOSE = 1, 2, 4
_AUDITED, _UNAUDITED, _ESTIMATED, _APPROXIMATE = 1, 2, 4, 8
#: A join task holds few subjects' pairs, so that one with many does not keep the others waiting.
TASKS = 4


def _bits(conditions: dict[int, Column]) -> Column:
    out = F.lit(0)
    for bit, c in conditions.items():
        out = out + F.when(c, bit).otherwise(0)
    return out


def sides(classes: DataFrame) -> DataFrame:
    """What a class brings into its pairs, whatever the other side is."""
    c = F.col
    t, has = c("time_type"), lambda q: F.array_contains("quals", q)
    fiscal, calendar = (t == "fiscal_year") & c("fy").isNotNull(), (t == "calendar_year") & c("cy").isNotNull()
    opposed = {_UNAUDITED: has("audited"), _ESTIMATED: has("audited"), _AUDITED: has("unaudited") | has("estimated")}
    return classes.select(
        "fact_id",
        "document_id",
        "subject",
        "family",
        "predicate",
        "fact_type",
        "n_members",
        _bits({_NUMBER: c("value_type").isin(*NUMERIC), _TEXT: c("value_type").isin(*TEXT), _LOOSE: c("fact_type").isin(*LOOSE)}).alias("kind"),
        # periods
        F.coalesce((t == "unknown") | (c("time_text") == ""), F.lit(True)).alias("timeless"),
        F.coalesce(S.strip(c("time_text")), F.lit("")).alias("words"),
        F.coalesce(block.typed_period(), F.lit("")).alias("typed"),
        (t.isin("quarter", "fiscal_year") & c("quarter").isNotNull()).alias("quarterly"),
        "fy",
        F.when(fiscal, 1).when(calendar, 2).otherwise(0).alias("year_kind"),
        F.coalesce(F.when(fiscal, c("fy")).when(calendar, c("cy")), F.lit(0)).alias("year"),
        # scope and qualifiers
        "scope",
        "quals",
        _bits({_AUDITED: has("audited"), _UNAUDITED: has("unaudited"), _ESTIMATED: has("estimated"), _APPROXIMATE: has("approximately") | has("approximate")}).alias("marks"),
        _bits(opposed).alias("opposed"),
        # values
        F.coalesce("text", F.lit("")).alias("text"),
        "value",
        (c("value") * c("mult")).alias("scaled"),
        F.coalesce("mult", F.lit(1.0)).alias("mult"),
        "unit",
        "currency",
        F.coalesce("currency_raw", F.lit("")).alias("currency_raw"),
        F.when(c("bound") == "greater_than", 1).when(c("bound") == "less_than", 2).when(c("bound") == "approximate", 3).otherwise(0).alias("bound"),
        F.coalesce(c("value_type") == "percentage", F.lit(False)).alias("percentage"),
        ((c("value_type") == "percentage") | (F.coalesce("unit", F.lit("")) == "%")).alias("percent"),
        # a pair's confidence follows the lesser one of its facts in every branch, so it is the lesser of these
        F.array(*(F.coalesce(reason.branch_confidence(F.coalesce("confidence", F.lit(0.0)), o), F.lit(0.0)) for o in reason.OUTCOMES)).alias("by_branch"),
    )


def _family() -> Column:
    """One name for all predicates that are linked by comparable ones; others are their own."""
    least: dict[str, str] = {p: p for p in compatible_predicates()}
    for _ in least:
        least = {p: min(least[p], *(least[q] for q in others)) for p, others in compatible_predicates().items()}
    return F.coalesce(F.try_element_at(S.literal_map(least), F.col("predicate")), F.col("predicate"))


def pairs(classes: DataFrame) -> DataFrame:
    """The pairs of ``block.candidates``, as ``sides`` under x and y.

    Both sides are the same rows, made once and laid out by subject and family of predicates.
    """
    c, spark = F.col, classes.sparkSession
    n = TASKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sides(block.known_classes(classes).withColumn("family", _family())).repartition(n, "subject", "family")
    fits = (c("x.fact_type") == c("y.fact_type")) | (c("x.kind").bitwiseAND(c("y.kind")) != 0)
    comparable = (c("x.predicate") == c("y.predicate")) | compatible(c("x.predicate"), c("y.predicate"))
    on = (c("x.subject") == c("y.subject")) & (c("x.family") == c("y.family")) & (c("x.fact_id") < c("y.fact_id")) & (c("x.document_id") != c("y.document_id")) & fits & comparable
    return rows.alias("x").join(rows.alias("y"), on)


def _time() -> Column:
    """CMP-4 as far as reasoning tells it apart: 0 unknown, 1 same, 2 contained or overlapping, 3 different."""
    x, y = lambda k: F.col(f"x.{k}"), lambda k: F.col(f"y.{k}")
    same = (x("words") == y("words")) | ((x("typed") == y("typed")) & (x("typed") != ""))
    contained = (x("quarterly") != y("quarterly")) & (x("fy") == y("fy"))
    # 1 is fiscal and 2 is calendar
    overlapping = (x("year_kind") * y("year_kind") == 2) & (F.abs(x("year") - y("year")) <= 1)
    return F.when(x("timeless") | y("timeless"), 0).when(same, 1).when(contained | overlapping, 2).otherwise(3)


def _value(tolerance: float) -> Column:
    """CMP-6: 0 unknown, 1 equal, 2 equivalent (all that is converted and agrees), 3 compatible, 4 different."""
    x, y = lambda k: F.col(f"x.{k}"), lambda k: F.col(f"y.{k}")
    a, b = x("scaled"), y("scaled")
    either = lambda k: (x("bound") == k) | (y("bound") == k)
    share = (x("percentage") & ~y("percentage") & S.is_close(x("value") / 100, b)) | (y("percentage") & ~x("percentage") & S.is_close(y("value") / 100, a))
    near = F.coalesce(F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b))), F.lit(0.0)) <= tolerance
    agrees = lambda c: F.when(c, 3).otherwise(4)
    identical = (x("value") == y("value")) & (x("mult") == y("mult")) & (x("currency_raw") == y("currency_raw"))
    return (
        F.when(x("kind").bitwiseAND(y("kind")).bitwiseAND(F.lit(_NUMBER)) == 0, F.when((x("text") == "") | (y("text") == ""), 0).when(x("text") == y("text"), 1).otherwise(4))
        .when(x("value").isNull() | y("value").isNull(), 0)
        .when((x("currency") != y("currency")) | (x("unit") != y("unit")), 4)
        .when(share, 2)
        .when(either(1), agrees(F.when(x("bound") == 1, b > a).otherwise(a > b)))
        .when(either(2), agrees(F.when(x("bound") == 2, b < a).otherwise(a < b)))
        .when(either(3), agrees(near))
        .when(S.is_close(a, b), F.when(identical, 1).otherwise(2))
        .otherwise(4)
    )


def _turned(table: list[tuple[str, str]]) -> Column:
    """MAT-4 of two predicates that may be compared; false unless the table has some of these."""
    either = {*table, *((q, p) for p, q in table)}
    found = [(p, q) for p, others in compatible_predicates().items() for q in others if (p, q) in either]
    return transition(F.col("x.predicate"), F.col("y.predicate"), found) if found else F.lit(False)


def relations(paired: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """MAT-1 and RSN-1..8 of pairs with one known subject, predicates that may be compared and fitting types."""
    x, y = lambda k: F.col(f"x.{k}"), lambda k: F.col(f"y.{k}")
    c = F.col
    time, value, agrees = c("_time"), c("_value"), c("_value").between(1, 3)
    alike = x("predicate") == y("predicate")
    turned = _turned(V.TRANSITIONS_REASONING)
    scoped = (x("scope") != "unknown") & (y("scope") != "unknown")
    differs = scoped & (x("scope") != y("scope"))
    # asked from both sides, so that both read the same columns and share one shuffle
    opposed = (x("opposed").bitwiseAND(y("marks")) != 0) | (y("opposed").bitwiseAND(x("marks")) != 0)
    approximate = x("marks").bitwiseOR(y("marks")).bitwiseAND(F.lit(_APPROXIMATE)) != 0
    qualified = (x("quals") != y("quals")) & (opposed | ~(approximate & agrees))
    dimension = x("percent") != y("percent")
    branch = (
        F.when(agrees & ~turned & (time != 3) & ~c("_differs"), F.when(value == 2, 2).when(value == 3, 3).otherwise(4))
        .when(turned, 5)
        .when(time == 3, 6)
        .when(time == 2, 7)
        .when(c("_differs"), 8)
        .when(qualified, 9)
        .when(dimension, 10)
        .when(value != 4, 14)
        # two stated scopes that do not differ; a dimension that is not known establishes nothing
        .when(scoped & ~dimension, F.when(time == 1, 11).otherwise(12))
        .otherwise(13)
    )
    judged = paired.withColumns({"_time": _time(), "_value": _value(tolerance), "_differs": differs}).withColumn("_branch", branch)
    pick = lambda k: F.array(*(F.lit(o[k]) for o in reason.OUTCOMES))[c("_branch")]
    return judged.select(
        x("fact_id").alias("class_a"),
        y("fact_id").alias("class_b"),
        F.when(alike, 1).otherwise(2).alias("pass_no"),
        (x("n_members") * y("n_members")).alias("n_pairs"),
        F.when(_turned(V.TRANSITIONS) | (time >= 2) | c("_differs"), "RELATED_CLAIM").otherwise("SAME_CLAIM").alias("classification"),
        pick(0).alias("relationship"),
        F.least(x("by_branch")[c("_branch")], y("by_branch")[c("_branch")]).alias("rel_confidence"),
        pick(4).alias("reason"),
    )
