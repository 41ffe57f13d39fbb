"""Scalar functions as column expressions: text, qualifiers, predicates, quantities, times.

All are built-in expressions, so they stay inside whole-stage code generation.
"""

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from claimloom.functions import vocab as V


def literal_map(words: dict) -> Column:
    """A literal map from a dictionary."""
    sql = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"double({v!r})" if isinstance(v, float) else str(v)
    return F.expr("map(" + ", ".join(f"{sql(k)}, {sql(v)}" for k, v in words.items()) + ")")


def look_up(words: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(words), key)


def strip(c: Column) -> Column:
    """Without white space at the ends, of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_match(text: Column, rules: list[tuple[str, str]], prefix: str = "(?i)") -> Column:
    """The name of the first pattern found, else null."""
    return F.coalesce(*(F.when(text.rlike(prefix + p), name) for p, name in rules))


# --- text (CAN-1, SEL-2..5) ----------------------------------------------------


def normalize_text(c: Column) -> Column:
    """Control characters dropped, blanks collapsed, stripped; null becomes empty."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", "")
    return strip(F.regexp_replace(c, r"[ \t]+", " "))


def alnum_ratio(c: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")), F.length(c))


def is_noise(c: Column) -> Column:
    """Too short, boilerplate, or mostly symbols."""
    t = strip(F.coalesce(c, F.lit("")))
    return (F.length(t) < 3) | t.rlike(V.BOILERPLATE) | ((F.length(t) > 8) & (alnum_ratio(t) < 0.35))


def has_number(c: Column) -> Column:
    return c.rlike(r"\d")


def has_time(c: Column) -> Column:
    return c.rlike(V.TEMPORAL_SIGNAL)


def has_fact_word(c: Column) -> Column:
    return F.lower(c).rlike("|".join(V.FACT_WORDS))


def noisy_fragment(c: Column) -> Column:
    """FN-26: short, mostly symbols, or with a long word without a vowel."""
    vowelless = F.exists(F.split(F.lower(c), r"\s+"), lambda w: (F.length(w) > 4) & ~w.rlike("[aeiouy]"))
    return (F.length(strip(c)) < 3) | (alnum_ratio(c) < 0.4) | vowelless


# --- keys (FN-1..4) -------------------------------------------------------------


def normalize_key(c: Column) -> Column:
    """Stripped and lower-cased; null becomes empty.  Compatibility forms are folded by ``nfkc`` beforehand."""
    return F.lower(strip(F.coalesce(c, F.lit(""))))


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(c: Column) -> Column:
    """NFKC, which the JVM functions lack: an Arrow UDF, applied to non-ASCII values only."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _fold(c)).otherwise(c)


def underscore_key(c: Column) -> Column:
    """FN-2."""
    return F.regexp_replace(normalize_key(c), r"[\s_-]+", "_")


def strip_alias(c: Column) -> Column:
    """FN-4."""
    return strip(F.replace(F.replace(c, F.lit(" limited"), F.lit("")), F.lit(" ltd"), F.lit("")))


def resolve_subject(name: Column, document_id: Column, aliases: dict[str, str]) -> Column:
    """FN-3: general words for a company resolved by a token of the document id; aliases: token -> name."""
    key = normalize_key(name)
    out = key
    for token, company in aliases.items():
        general = key.isin("company", "the company", "our company") & F.contains(F.lower(document_id), F.lit(token))
        out = F.when(general | key.isin(f"{company} limited", f"{company} ltd"), company).otherwise(out)
    return out


# --- qualifiers and predicates (FN-8..11) ------------------------------------------


def qualifiers(c: Column) -> Column:
    """All qualifiers of a text, in table order."""
    found = F.array(*(F.when(c.rlike("(?i)" + p), F.lit(name)) for p, name in V.QUALIFIERS))
    return F.filter(found, lambda x: x.isNotNull())


def comparison_qualifier(c: Column) -> Column:
    return first_match(F.lower(c), V.COMPARISON, "")


def verb_predicate(c: Column) -> Column:
    return first_match(c, V.VERBS)


def snake(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def metric_predicate(c: Column) -> Column:
    """A table header as a predicate; empty becomes ``metric``."""
    t = F.lower(strip(c))
    return F.coalesce(first_match(t, V.METRICS, ""), blank_to_null(snake(t)), F.lit("metric"))


# --- values (FN-12..16, FN-21) ------------------------------------------------------


def normalize_currency(c: Column) -> Column:
    t = strip(c)
    return F.when(F.length(c) > 0, F.coalesce(look_up(V.CURRENCY, F.lower(t)), F.upper(t)))


def normalize_unit(c: Column) -> Column:
    t = F.lower(strip(c))
    return F.when(F.length(c) > 0, F.coalesce(look_up(V.UNIT, t), t))


def scale_multiplier(c: Column) -> Column:
    return F.coalesce(look_up(V.SCALE, F.lower(strip(c))), F.lit(1.0))


def parse_numeric(c: Column) -> Column:
    """Digits, dots and minus signs of a text as a number, or null."""
    t = F.regexp_replace(c, r"[^\d.-]", "")
    return F.when(t.rlike(r"^-?(?:\d+\.?\d*|\.\d+)$"), t.try_cast("double"))


_SYNONYMS = {
    **dict.fromkeys(["approximate", "approximately", "around", "about"], "approximate"),
    **dict.fromkeys(["greater_than", "over", "more_than", "at_least", "above"], "greater_than"),
    **dict.fromkeys(["less_than", "under", "below", "at_most"], "less_than"),
}


def effective_qualifier(own: Column, of_fact: Column) -> Column:
    """FN-16: the object's own qualifier, else the first known one of the fact."""
    o = F.lower(strip(own))
    known = F.filter(F.transform(of_fact, lambda q: look_up(_SYNONYMS, F.lower(strip(q)))), lambda q: q.isNotNull())
    return F.when(F.length(own) > 0, F.coalesce(look_up(_SYNONYMS, o), o)).otherwise(F.get(known, F.lit(0)))


def is_close(a: Column, b: Column) -> Column:
    """FN-21."""
    return F.abs(a - b) <= F.greatest(F.lit(1e-5) * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-7))


# --- quantities (FN-5, FN-6, FN-28) ---------------------------------------------------


def extract_quantities(c: Column) -> Column:
    """array<struct<value_raw, unit, currency, scale, qualifier, value_type>> of a text, in order."""

    def read(m: Column) -> Column:
        part = lambda k: blank_to_null(F.regexp_extract(m, V.QUANTITY, k))
        qualifier, currency, number, scale, unit = (part(k) for k in range(1, 6))
        percent = F.lower(unit).isin("%", "percent")
        qual = comparison_qualifier(qualifier)
        return F.struct(
            F.replace(number, F.lit(","), F.lit("")).alias("value_raw"),
            F.when(percent, "%").otherwise(F.regexp_replace(unit, r"\.+$", "")).alias("unit"),
            look_up(V.TEXT_CURRENCY, F.lower(currency)).alias("currency"),
            F.regexp_replace(F.lower(scale), "s$", "").alias("scale"),
            qual.alias("qualifier"),
            F.when(percent, "percentage")
            .when(unit.isNotNull(), "quantity")
            .when(currency.isNotNull(), "currency")
            .when(scale.isNotNull(), "number")
            .when(qual.isNotNull(), "quantity")
            .otherwise("number")
            .alias("value_type"),
            # a bare number of four characters that looks like a year is left to the time reader
            (F.coalesce(qualifier, currency, scale, unit).isNull() & number.rlike("^(19|20)..$")).alias("is_year"),
        )

    matches = F.regexp_extract_all(c, F.lit(V.QUANTITY), F.lit(0))
    return F.filter(F.transform(matches, read), lambda q: ~q["is_year"])


def table_units(caption: Column) -> Column:
    """FN-28: currency, scale and unit a caption states for its table."""
    currency = F.regexp_extract(caption, r"(?i)(₹|INR|Rs\.?|\$|USD|€|EUR|£|GBP)", 1)
    scale = F.regexp_extract(caption, r"(?i)\b(million|billion|crores?|lakhs?|thousands?|trillion)\b", 1)
    return F.struct(
        look_up(V.TEXT_CURRENCY, F.lower(currency)).alias("currency"),
        blank_to_null(F.regexp_replace(F.lower(scale), "s$", "")).alias("scale"),
        F.when(caption.rlike("(?i)%|percent"), "%").alias("unit"),
    )


# --- times (FN-7, FN-17..20) -----------------------------------------------------------


def temporal_context(c: Column) -> Column:
    """struct<time_type, value>: the first kind of time found, never inferred."""
    kinds = [
        ("as_of_date", V.AS_OF, 1, "as of "),
        ("date_range", V.YEAR_ENDED, 1, "for the year ended "),
        ("specific_date", V.DATE, 1, ""),
        ("quarter", V.QUARTER, 0, ""),
        ("fiscal_year", V.FISCAL, 1, ""),
        ("calendar_year", V.DURING, 1, "during "),
        ("calendar_year", V.YEAR, 1, ""),
    ]
    out = F.struct(F.lit("unknown").alias("time_type"), F.lit(None).cast("string").alias("value"))
    for kind, pattern, group, lead in reversed(kinds):
        value = F.concat(F.lit(lead), strip(F.regexp_extract(c, pattern, group)))
        out = F.when(c.rlike(pattern), F.struct(F.lit(kind).alias("time_type"), value.alias("value"))).otherwise(out)
    return out


def fiscal_year(c: Column) -> Column:
    t = F.upper(strip(c))
    four, two = (blank_to_null(F.regexp_extract(t, p, 1)) for p in (r"FY\s*(\d{4})", r"FY\s*(\d{2})\b"))
    end = blank_to_null(F.regexp_extract(t, r"(\d{4})\s*-\s*(\d{2,4})", 2))
    end = F.when(F.length(end) == 2, end.cast("int") + 2000).otherwise(end.cast("int"))
    return F.coalesce(four.cast("int"), two.cast("int") + 2000, end)


def calendar_year(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, V.YEAR, 1)).cast("int")


def quarter_number(c: Column) -> Column:
    t = F.upper(strip(c))
    word = F.regexp_extract(t, r"\b(FIRST|SECOND|THIRD|FOURTH)\s+QUARTER\b", 1)
    digit = blank_to_null(F.regexp_extract(t, r"\bQ([1-4])\b", 1)).cast("int")
    return F.coalesce(digit, look_up({"FIRST": 1, "SECOND": 2, "THIRD": 3, "FOURTH": 4}, word))


def date_number(c: Column) -> Column:
    """Year, month and day as one integer yyyymmdd, without calendar checks."""
    t = F.lower(strip(c))

    def read(pattern: str, y: int, m: int, d: int, named: bool) -> Column:
        year, month, day = (F.regexp_extract(t, pattern, k) for k in (y, m, d))
        month = look_up(V.MONTHS, month) if named else blank_to_null(month).cast("int")
        return blank_to_null(year).cast("int") * 10000 + month * 100 + blank_to_null(day).cast("int")

    return F.coalesce(
        read(r"(\d{4})-(\d{1,2})-(\d{1,2})", 1, 2, 3, False),
        read(r"([a-z]+)\s+(\d{1,2}),?\s+(\d{4})", 3, 1, 2, True),
        read(r"(\d{1,2})\s+([a-z]+)\s+(\d{4})", 3, 2, 1, True),
    )


# --- renderings (FN-22..25, FN-27) --------------------------------------------------------


def shown_value(qualifier: Column, currency: Column, value: Column, unit: Column, scale: Column) -> Column:
    """FN-22."""
    return F.concat_ws(" ", *(blank_to_null(x) for x in (qualifier, currency, value, unit, scale)))


def shown_time(value: Column, start: Column, end: Column) -> Column:
    """FN-23."""
    both = F.when(start.isNotNull() & end.isNotNull(), F.concat_ws(" to ", start, end))
    return F.coalesce(blank_to_null(value), both, start, end, F.lit("unspecified period"))


def api_value(currency: Column, value: Column, scale: Column, unit: Column) -> Column:
    """FN-24: currency glued to the value, then scale, then unit unless it is the scale."""
    head = F.concat(F.coalesce(currency, F.lit("")), value)
    return F.concat_ws(" ", head, blank_to_null(scale), F.when(unit.eqNullSafe(scale), None).otherwise(blank_to_null(unit)))


def fact_summary(subject: Column, predicate: Column, value: Column, unit: Column, time: Column, scope: Column) -> Column:
    """FN-25."""
    head = F.concat(subject, F.lit(" -> "), predicate, F.lit(" = "), F.concat_ws(" ", value, blank_to_null(unit)))
    return F.concat(head, F.lit(" ("), F.coalesce(time, F.lit("-")), F.lit(", "), F.coalesce(scope, F.lit("-")), F.lit(")"))


def query_tokens(text: str) -> list[str]:
    """FN-27, on the driver: a query is one short string."""
    import re

    found = re.findall(r"\b[a-z0-9_\-]+\b", text.strip().lower())
    return [t for t in found if t not in V.QUERY_STOP and t not in V.QUERY_TIME and len(t) >= 2]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
