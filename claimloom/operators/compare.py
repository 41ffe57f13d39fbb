"""Comparison of fact pairs along eight dimensions, and their classification.

Inputs of each side are parsed once per fact (``prepare``); a pair is then a
cascade of cheap comparisons on two prepared rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import scalar as S
from claimloom.functions import vocab as V

NUMERIC = ("number", "percentage", "currency", "quantity")
TEXT = ("text", "entity")
LOOSE = ("attribute", "semantic")


def latest_facts(facts: DataFrame) -> DataFrame:
    """One row per fact_id: the last loaded."""
    cols = [c for c in facts.columns if c != "fact_id"]
    return facts.where(F.col("fact_id").isNotNull()).groupBy("fact_id").agg(F.max_by(F.struct(*cols), F.struct("loaded_at", "value_raw")).alias("f")).select("fact_id", "f.*")


def prepare(facts: DataFrame) -> DataFrame:
    """The columns comparisons need, parsed once."""
    value = F.coalesce("value_num", S.parse_numeric(F.col("value_raw")))
    return facts.select(
        "fact_id",
        "document_id",
        "fact_type",
        "value_type",
        "confidence",
        S.normalize_key(F.col("subject_name")).alias("subject"),
        S.normalize_key(F.col("predicate")).alias("predicate"),
        S.normalize_key(F.col("value_raw")).alias("text"),
        value.alias("value"),
        S.scale_multiplier(F.col("scale")).alias("mult"),
        S.normalize_unit(F.col("unit")).alias("unit"),
        S.normalize_currency(F.col("currency")).alias("currency"),
        F.coalesce("currency", F.lit("")).alias("currency_raw"),
        S.effective_qualifier(F.col("value_qualifier"), F.col("qualifiers")).alias("bound"),
        F.coalesce("time_type", F.lit("unknown")).alias("time_type"),
        F.coalesce(F.upper("time_value"), F.lit("")).alias("time_text"),
        S.date_number(F.coalesce("time_start", "time_value")).alias("day"),
        S.fiscal_year(F.col("time_value")).alias("fy"),
        S.calendar_year(F.col("time_value")).alias("cy"),
        S.quarter_number(F.col("time_value")).alias("quarter"),
        S.normalize_key(F.col("scope")).alias("scope"),
        F.array_sort(F.array_distinct(F.transform(F.coalesce("qualifiers", F.array().cast("array<string>")), S.normalize_key))).alias("quals"),
    )


def pair_up(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    """(a, b) structs for pairs of ids; pairs with an unknown id are dropped."""
    a = prepared.select(F.col("fact_id").alias("fact_a_id"), F.struct(*prepared.columns).alias("a"))
    b = prepared.select(F.col("fact_id").alias("fact_b_id"), F.struct(*prepared.columns).alias("b"))
    return pairs.join(a, "fact_a_id").join(b, "fact_b_id")


def _a(name: str) -> Column:
    return F.col(f"a.{name}")


def _b(name: str) -> Column:
    return F.col(f"b.{name}")


def _either(name: str, value: object) -> Column:
    return (_a(name) == value) | (_b(name) == value)


def compatible_predicates() -> dict[str, list[str]]:
    """The symmetric relation as predicate -> others."""
    out: dict[str, set[str]] = {}
    for group in V.COMPATIBLE:
        for p in group:
            out.setdefault(p, set()).update(q for q in group if q != p)
    return {k: sorted(v) for k, v in sorted(out.items())}


def compatible(p: Column, q: Column) -> Column:
    """JN-7 for two normalised predicates that differ."""
    return F.concat_ws("|", p, q).isin([f"{k}|{o}" for k, others in compatible_predicates().items() for o in others])


def transition(p: Column, q: Column, table: list[tuple[str, str]]) -> Column:
    """MAT-4."""
    return F.concat_ws("|", p, q).isin([f"{x}|{y}" for a, b in table for x, y in ((a, b), (b, a))])


def types_compatible(fa: Column, fb: Column, va: Column, vb: Column) -> Column:
    """JN-6."""
    same = fa == fb
    return same | (va.isin(*NUMERIC) & vb.isin(*NUMERIC)) | (va.isin(*TEXT) & vb.isin(*TEXT)) | (fa.isin(*LOOSE) & fb.isin(*LOOSE))


def sig_subject() -> Column:
    sa, sb = _a("subject"), _b("subject")
    general = lambda s: (s == "") | s.isin(*V.GENERIC_SUBJECTS)
    return (
        F.when((sa == sb) & (_a("document_id") == _b("document_id")), "exact")
        .when((sa == sb) & ~general(sa), "exact")
        .when(general(sa) | general(sb), "unknown")
        .when(S.strip_alias(sa) == S.strip_alias(sb), "alias")
        .otherwise("different")
    )


def sig_predicate() -> Column:
    pa, pb = _a("predicate"), _b("predicate")
    return (
        F.when((pa == "") | (pb == ""), "unknown")
        .when(pa == pb, "exact")
        .when(compatible(pa, pb) | transition(pa, pb, V.TRANSITIONS), "compatible")
        .otherwise("different")
    )


def sig_fact_type() -> Column:
    ok = types_compatible(_a("fact_type"), _b("fact_type"), _a("value_type"), _b("value_type"))
    return F.when(F.coalesce(ok, F.lit(False)), "compatible").otherwise("incompatible")


def sig_time() -> Column:
    """CMP-4."""
    ta, tb = _a("time_type"), _b("time_type")
    status = lambda c: F.when(c, "same").otherwise("different")
    both = lambda t, k: (ta == t) & (tb == t) & _a(k).isNotNull() & _b(k).isNotNull()
    dated = lambda t: t.isin("specific_date", "as_of_date")
    quarterly = lambda x: F.when(x("time_type").isin("quarter", "fiscal_year"), x("quarter"))
    one_quarter = quarterly(_a).isNotNull() != quarterly(_b).isNotNull()
    mixed = ((ta == "fiscal_year") & (tb == "calendar_year")) | ((ta == "calendar_year") & (tb == "fiscal_year"))
    year = lambda x: F.when(x("time_type") == "fiscal_year", x("fy")).otherwise(x("cy"))
    return (
        F.when((ta == "unknown") | (tb == "unknown") | (_a("time_text") == "") | (_b("time_text") == ""), "unknown")
        .when(S.strip(_a("time_text")) == S.strip(_b("time_text")), "same")
        .when(dated(ta) & dated(tb) & _a("day").isNotNull() & _b("day").isNotNull(), status(_a("day") == _b("day")))
        .when(both("fiscal_year", "fy"), status(_a("fy") == _b("fy")))
        .when(both("calendar_year", "cy"), status(_a("cy") == _b("cy")))
        .when(one_quarter & F.coalesce(_a("fy") == _b("fy"), F.lit(False)), "contained")
        .when(mixed & year(_a).isNotNull() & year(_b).isNotNull(), F.when(F.abs(year(_a) - year(_b)) <= 1, "overlapping").otherwise("different"))
        .otherwise("different")
    )


def sig_scope() -> Column:
    sa, sb = _a("scope"), _b("scope")
    return F.when((sa == "unknown") | (sb == "unknown"), "unknown").when(sa == sb, "same").otherwise("different")


def _value_parts(tolerance: float) -> dict[str, Column]:
    """What the value and unit signals are decided by; computed once per pair."""
    va, vb = _a("value"), _b("value")
    clash = lambda k: F.coalesce(_a(k) != _b(k), F.lit(False))
    has = lambda q: F.coalesce(_a("bound") == q, F.lit(False)) | F.coalesce(_b("bound") == q, F.lit(False))
    return {
        "_numeric": F.coalesce(_a("value_type").isin(*NUMERIC) & _b("value_type").isin(*NUMERIC), F.lit(False)),
        "_va": va,
        "_vb": vb,
        "_x": va * _a("mult"),
        "_y": vb * _b("mult"),
        "_clash": clash("currency") | clash("unit"),
        "_pa": _a("value_type") == "percentage",
        "_pb": _b("value_type") == "percentage",
        "_bound": F.when(has("greater_than"), ">").when(has("less_than"), "<").when(has("approximate"), "~"),
        "_by_a": F.coalesce(F.when(has("greater_than"), _a("bound") == "greater_than").otherwise(_a("bound") == "less_than"), F.lit(False)),
        "_scaled": _a("mult") != _b("mult"),
        "_same_cur": _a("currency_raw") == _b("currency_raw"),
        "_unit": F.when(_a("unit").isNull() & _b("unit").isNull(), "not_applicable").when(_a("unit").isNull() | _b("unit").isNull(), "missing").otherwise("same"),
        "_tolerance": F.lit(tolerance),
    }


def value_signals() -> tuple[Column, Column]:
    """CMP-6 on the parts: (value, unit)."""
    c = F.col
    agrees = lambda x: F.when(x, "compatible").otherwise("different")
    share = (c("_pa") & ~c("_pb") & S.is_close(c("_va") / 100, c("_y"))) | (c("_pb") & ~c("_pa") & S.is_close(c("_vb") / 100, c("_x")))
    near = F.coalesce(F.try_divide(F.abs(c("_x") - c("_y")), F.greatest(F.abs("_x"), F.abs("_y"))), F.lit(0.0)) <= c("_tolerance")
    threshold, other = F.when(c("_by_a"), c("_x")).otherwise(c("_y")), F.when(c("_by_a"), c("_y")).otherwise(c("_x"))
    identical = (c("_va") == c("_vb")) & ~c("_scaled") & c("_same_cur")
    # a struct holds both signals, so each condition is evaluated once
    both = lambda v, u: F.struct(F.lit(v).alias("v") if isinstance(v, str) else v.alias("v"), F.lit(u).alias("u") if isinstance(u, str) else u.alias("u"))
    respelled = F.coalesce((_a("currency") == _b("currency")) & ~c("_same_cur"), F.lit(False))
    pair = (
        F.when(~c("_numeric"), both(F.when((_a("text") == "") | (_b("text") == ""), "unknown").when(_a("text") == _b("text"), "equal").otherwise("different"), "not_applicable"))
        .when(c("_va").isNull() | c("_vb").isNull(), both("unknown", "unknown"))
        .when(c("_clash"), both("different", "different"))
        .when(share, both("equivalent", "converted"))
        .when(c("_bound") == ">", both(agrees(other > threshold), c("_unit")))
        .when(c("_bound") == "<", both(agrees(other < threshold), c("_unit")))
        .when(c("_bound") == "~", both(agrees(near), c("_unit")))
        .when(S.is_close(c("_x"), c("_y")), both(F.when(identical, "equal").otherwise("equivalent"), F.when(identical, "same").otherwise("converted")))
        .otherwise(both("different", F.when(c("_scaled") | respelled, "converted").otherwise(c("_unit"))))
    )
    return pair["v"], pair["u"]


def sig_qualifiers(value: Column) -> Column:
    """CMP-7."""
    qa, qb = _a("quals"), _b("quals")
    has = F.array_contains
    opposed = lambda x, y: (has(qa, x) & has(qb, y)) | (has(qa, y) & has(qb, x))
    approx = F.arrays_overlap(F.concat(qa, qb), F.array(F.lit("approximately"), F.lit("approximate")))
    return (
        F.when(qa == qb, "exact")
        .when(opposed("audited", "unaudited") | opposed("estimated", "audited"), "different")
        .when(approx & value.isin("equal", "equivalent", "compatible"), "compatible")
        .otherwise("different")
    )


def compare(paired: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """The eight signals of each pair."""
    parts = _value_parts(tolerance)
    value, unit = value_signals()
    out = paired.withColumns(parts).withColumns(
        {"sig_subject": sig_subject(), "sig_predicate": sig_predicate(), "sig_fact_type": sig_fact_type(), "sig_time": sig_time(), "sig_scope": sig_scope(), "sig_value": value, "sig_unit": unit}
    )
    return out.drop(*parts).withColumn("sig_qualifiers", sig_qualifiers(F.col("sig_value")))


def classify(compared: DataFrame) -> DataFrame:
    """MAT-1: classification and confidence."""
    s = lambda k: F.col(f"sig_{k}")
    least = F.least(F.coalesce(_a("confidence"), F.lit(0.0)), F.coalesce(_b("confidence"), F.lit(0.0)))
    apart = (s("subject") == "different") | (s("predicate") == "different") | (s("fact_type") == "incompatible")
    unknown = (s("subject") == "unknown") | (s("predicate") == "unknown")
    turned = transition(_a("predicate"), _b("predicate"), V.TRANSITIONS)
    related = s("time").isin("different", "contained", "overlapping") | (s("scope") == "different")
    label = F.when(apart, "NOT_MATCH").when(unknown, "UNCERTAIN").when(turned | related, "RELATED_CLAIM").otherwise("SAME_CLAIM")
    factor = F.when(turned, 0.90).when(related, 0.88).when(s("value").isin("equal", "equivalent"), 0.98).when(s("value") == "compatible", 0.92).when(s("value") == "different", 0.90).otherwise(0.75)
    confidence = F.when(apart, 1.0).when(unknown, 0.5).otherwise(F.round(least * factor, 4))
    return compared.withColumns({"classification": label, "confidence": confidence})


def reasons() -> Column:
    """CMP-8: one line per dimension."""
    dims = ["subject", "predicate", "fact_type", "time", "scope", "value", "qualifiers"]
    return F.array(*(F.concat(F.lit(f"{d.replace('_', ' ')}: "), F.col(f"sig_{d}")) for d in dims))
