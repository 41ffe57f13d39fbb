"""Facts out of sentences, tables and figures.

One element gives any number of facts: each rule turns all its matches in a text
into an array of structs, the arrays are joined, and one explode gives rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import scalar as S
from claimloom.functions import vocab as V

# fixed values: sentence patterns
_SUBJECT = r"([A-Z][A-Za-z0-9\s.\-]+?|\bIt\b|\bThe\s+company\b)"
APPOINTMENT = r"(?i)([A-Z][A-Za-z\s.\-]+?)\s+(?:was\s+)?(appointed(?:\s+as)?|resigned(?:\s+as)?|stepped\s+down\s+as)\s+([A-Za-z\s]+?)(?:\s+(?:in|on|effective)\s+([A-Za-z0-9\s,\-]+))?[.,]"
LOCATION = r"(?i)([A-Z][A-Za-z0-9\s.\-]+?)\s+(?:is\s+)?(located\s+at|headquartered\s+at|situated\s+at)\s+([A-Za-z0-9\s,.\-]+)[.,]?"
COMPOUND = rf"(?i){_SUBJECT}\s+operates\s+(\d[\d,]*)\s+([A-Za-z\s]+?)\s+covering\s+(\d+(?:\.\d+)?)\s*(million|lakh|crore)?\s*(square\s*feet|sq\s*ft)"
VERB = rf"(?i){_SUBJECT}\s+(operates|owns|acquired|launched|provides|serves)\s+([^.;]+)"
REPORTED = r"(?i)([A-Z][A-Za-z0-9\s.\-]+?|\bThe\s+company\b|\bIt\b)\s+(?:reported|generated|had|achieved)\s+(?:a\s+)?(revenue|profit|net\s+profit|loss|net\s+loss|ebitda)\s+of\s+([^.;]+)"
STOOD_AT = r"(?i)\b(revenue|profit|net\s+profit|loss|net\s+loss|ebitda)\s+(?:was|reached|stood\s+at|is)\s+([^.;]+)"

FACT = "struct<subject:string,subject_type:string,predicate:string,value_type:string,value_raw:string,unit:string,currency:string,scale:string,qualifier:string,time_type:string,time_value:string,confidence:double,fact_type:string>"


def resolve_subject(name: Column, title: Column, header: Column) -> Column:
    """EXT-1: struct<name, type>, or null if a pronoun cannot be resolved."""
    low = F.lower(S.strip(name))
    word = F.get(F.split(S.strip(title), r"\s+"), F.lit(0))
    good = (F.length(word) > 2) & word.rlike(r"^[\p{L}\p{N}]+$")
    by_header = (F.size(F.split(S.strip(header), r"\s+")) <= 5) & (F.length(header) > 0) & ~F.lower(header).rlike("introduction|overview|financials|table")
    pronoun = F.when(by_header, S.strip(header)).when(F.lower(title).rlike("prospectus|report") & good, word)
    general = F.when((F.length(word) > 2) & word.rlike(r"^\p{L}+$") & ~F.lower(title).startswith("document"), word).otherwise("Company")
    resolved = F.when(low.isin(*V.PRONOUNS), pronoun).when(low.isin("the company", "the firm", "the group", "company"), general).otherwise(S.strip(name))
    person = ~low.isin(*V.PRONOUNS) & name.rlike(r"Mr\.|Ms\.|Mrs\.|Dr\.")
    return F.when(resolved.isNotNull(), F.struct(resolved.alias("name"), F.when(person, "person").otherwise("company").alias("type")))


def _fact(subject: Column, kind: Column, predicate: Column, value_type: Column, raw: Column, time: Column, confidence: float, fact_type: str, unit=None, currency=None, scale=None, qualifier=None) -> Column:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(
        subject.alias("subject"), kind.alias("subject_type"), predicate.alias("predicate"), value_type.alias("value_type"), raw.alias("value_raw"),
        text(unit).alias("unit"), text(currency).alias("currency"), text(scale).alias("scale"), text(qualifier).alias("qualifier"),
        time["time_type"].alias("time_type"), time["value"].alias("time_value"), F.lit(confidence).alias("confidence"), F.lit(fact_type).alias("fact_type"),
    )


# words without which a pattern cannot match: the patterns try every start for a subject, a plain word search does not
_HINTS = {
    APPOINTMENT: "(?i)appointed|resigned|stepped",
    LOCATION: "(?i)located|headquartered|situated",
    COMPOUND: "(?i)operates",
    VERB: "(?i)operates|owns|acquired|launched|provides|serves",
    REPORTED: r"(?i)(?:revenue|profit|loss|ebitda)\s+of",
    STOOD_AT: "(?i)revenue|profit|loss|ebitda",
}


def _all(text: Column, pattern: str, build) -> Column:
    """An array of what ``build`` makes of each match; matches it makes null of are left out."""
    hinted = F.when(text.rlike(_HINTS[pattern]), text).otherwise("")
    return F.filter(F.transform(F.regexp_extract_all(hinted, F.lit(pattern), F.lit(0)), build), lambda x: x.isNotNull())


def _quantities_as_facts(subject: Column, predicate: Column, text: Column, time: Column, confidence: float) -> Column:
    return F.transform(
        S.extract_quantities(text),
        lambda q: _fact(subject["name"], subject["type"], predicate, q["value_type"], q["value_raw"], time, confidence, "numerical", q["unit"], q["currency"], q["scale"], q["qualifier"]),
    )


def appointments(text: Column) -> Column:
    """EXT-2."""

    def build(m: Column) -> Column:
        part = lambda k: F.regexp_extract(m, APPOINTMENT, k)
        predicate = F.when(F.lower(part(2)).contains("appointed"), "appointed_as").otherwise("resigned_as")
        time = S.temporal_context(F.when(part(4) == "", text).otherwise(part(4)))
        return _fact(S.strip(part(1)), F.lit("person"), predicate, F.lit("text"), S.strip(part(3)), time, 0.95, "event")

    return _all(text, APPOINTMENT, build)


def locations(text: Column, title: Column, header: Column) -> Column:
    """EXT-3."""

    def build(m: Column) -> Column:
        subject = resolve_subject(F.regexp_extract(m, LOCATION, 1), title, header)
        address = F.regexp_replace(F.regexp_replace(S.strip(F.regexp_extract(m, LOCATION, 3)), r"\.+$", ""), ",+$", "")
        return F.when(subject.isNotNull(), _fact(subject["name"], subject["type"], F.lit("located_at"), F.lit("text"), address, S.temporal_context(text), 0.92, "relationship"))

    return _all(text, LOCATION, build)


def compound_operations(text: Column, title: Column, header: Column) -> Column:
    """EXT-4: the first match only."""
    part = lambda k: F.regexp_extract(text, COMPOUND, k)
    subject, time = resolve_subject(part(1), title, header), S.temporal_context(text)
    both = F.array(
        _fact(subject["name"], subject["type"], F.lit("operates"), F.lit("quantity"), F.replace(part(2), F.lit(","), F.lit("")), time, 0.95, "numerical", unit=S.strip(part(3))),
        _fact(subject["name"], subject["type"], F.lit("floor_area"), F.lit("number"), part(4), time, 0.94, "numerical", unit=part(6), scale=S.blank_to_null(part(5))),
    )
    return F.when(text.rlike(_HINTS[COMPOUND]) & text.rlike(COMPOUND) & subject.isNotNull(), both).otherwise(F.array().cast(f"array<{FACT}>"))


def verb_facts(text: Column, title: Column, header: Column) -> Column:
    """EXT-5."""

    def build(m: Column) -> Column:
        subject = resolve_subject(F.regexp_extract(m, VERB, 1), title, header)
        predicate, rest = S.verb_predicate(F.regexp_extract(m, VERB, 2)), S.strip(F.regexp_extract(m, VERB, 3))
        time = S.temporal_context(text)
        numbers = _quantities_as_facts(subject, predicate, rest, time, 0.90)
        words = F.array(_fact(subject["name"], subject["type"], predicate, F.lit("text"), rest, time, 0.88, "relationship"))
        return F.when(subject.isNotNull(), F.when(F.size(numbers) > 0, numbers).otherwise(words))

    return F.flatten(_all(text, VERB, build))


def _metric(c: Column) -> Column:
    m = F.lower(c)
    return F.when(m.contains("revenue"), "revenue").when(m.contains("profit"), "profit").when(m.contains("loss"), "loss").otherwise("ebitda")


def reported_metrics(text: Column, title: Column, header: Column) -> Column:
    """EXT-6."""

    def build(m: Column) -> Column:
        subject = resolve_subject(F.regexp_extract(m, REPORTED, 1), title, header)
        rest = S.strip(F.regexp_extract(m, REPORTED, 3))
        return F.when(subject.isNotNull(), _quantities_as_facts(subject, _metric(F.regexp_extract(m, REPORTED, 2)), rest, S.temporal_context(rest), 0.95))

    return F.flatten(_all(text, REPORTED, build))


def stated_metrics(text: Column, title: Column, header: Column) -> Column:
    """EXT-7."""
    subject = resolve_subject(F.lit("The company"), title, header)

    def build(m: Column) -> Column:
        rest = S.strip(F.regexp_extract(m, STOOD_AT, 2))
        return _quantities_as_facts(subject, _metric(F.regexp_extract(m, STOOD_AT, 1)), rest, S.temporal_context(rest), 0.92)

    return F.flatten(_all(text, STOOD_AT, build))


def sentence_facts(rows: DataFrame, text: str = "content", title: str = "title", header: str = "header") -> DataFrame:
    """EXT-8: one row per fact of each text; other columns are kept."""
    t, d, h = (F.col(c) for c in (text, title, header))
    compound = compound_operations(t, d, h)
    verbs = F.when(t.rlike(_HINTS[COMPOUND]) & t.rlike(COMPOUND), F.array().cast(f"array<{FACT}>")).otherwise(verb_facts(t, d, h))
    parts = [appointments(t), locations(t, d, h), compound, verbs, reported_metrics(t, d, h), stated_metrics(t, d, h)]
    facts = F.concat(*(p.cast(f"array<{FACT}>") for p in parts))
    return rows.withColumn("qualifiers", S.qualifiers(t)).select("*", F.posexplode(facts).alias("fact_no", "_f")).select(*rows.columns, "qualifiers", "fact_no", "_f.*")


def table_facts(tables: DataFrame) -> DataFrame:
    """EXT-9: (element_id, row_no, col_no, predicate, value_raw, value_type, time_type, time_value, currency, scale, unit) of each numeric cell."""
    t = tables.where((F.size("table_rows") > 0) & (F.size("headers") > 0)).select("document_id", "element_id", "caption", "headers", "table_rows", S.table_units(F.coalesce("caption", F.lit(""))).alias("u"))
    blank = F.size(F.filter("headers", lambda h: F.coalesce(S.strip(h), F.lit("")).isin("", "-") | h.isNull()))
    unnamed = F.forall("headers", lambda h: F.coalesce(S.strip(h), F.lit("")).rlike("^(Unnamed.*)?$"))
    yearly = lambda c: c.rlike(V.FISCAL) | c.rlike(V.YEAR)
    first = F.lower(F.coalesce(F.get("headers", F.lit(0)), F.lit("")))
    head = F.transform(F.slice("table_rows", 1, 3), lambda r: F.coalesce(F.get(r, F.lit(0)), F.lit("")))
    by_row = first.rlike("year|period|date|fy") | F.exists(head, yearly)
    by_column = F.exists(F.slice(F.col("headers"), 2, 10_000), lambda h: F.coalesce(yearly(h), F.lit(False)))
    t = t.where(~unnamed & (blank * 2 <= F.size("headers"))).withColumn("way", F.when(by_row, "A").when(by_column, "B")).where(F.col("way").isNotNull())
    cells = t.select("*", F.posexplode("table_rows").alias("row_no", "row")).select("*", F.posexplode("row").alias("col_no", "cell")).where(F.col("col_no") > 0)
    label, title = F.coalesce(F.get("row", F.lit(0)), F.lit("")), F.coalesce(F.get("headers", F.col("col_no")), F.lit(""))
    a = F.col("way") == "A"
    cell = F.replace(S.strip(F.coalesce("cell", F.lit(""))), F.lit(","), F.lit(""))
    named = F.when(a, title).otherwise(label)
    percent = cell.contains("%") | named.contains("%") | F.coalesce(F.col("u.unit") == "%", F.lit(False))
    row_time = S.temporal_context(label)
    time = F.when(a, F.when(row_time["time_type"] == "unknown", S.temporal_context(F.coalesce("caption", F.lit("")))).otherwise(row_time)).otherwise(S.temporal_context(title))
    plain = S.strip(F.replace(cell, F.lit("%"), F.lit("")))
    return cells.where(plain.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$")).select(
        "document_id",
        "element_id",
        "row_no",
        "col_no",
        S.metric_predicate(named).alias("predicate"),
        plain.alias("value_raw"),
        F.when(percent, "percentage").when(F.col("u.currency").isNotNull(), "currency").otherwise("number").alias("value_type"),
        time["time_type"].alias("time_type"),
        time["value"].alias("time_value"),
        F.when(~percent, F.col("u.currency")).alias("currency"),
        F.when(~percent, F.col("u.scale")).alias("scale"),
        F.when(percent, "%").alias("unit"),
    )


def figure_facts(figures: DataFrame) -> DataFrame:
    """EXT-10: quantities of the caption, else of labelled fragments."""
    rows = figures.select("document_id", "element_id", "caption", F.coalesce("text_fragments", F.array().cast("array<struct<text:string>>")).alias("parts"))
    in_caption = S.extract_quantities(F.coalesce("caption", F.lit("")))

    def labelled(p: Column) -> Column:
        text = F.coalesce(p["text"], F.lit(""))
        predicate = F.substring(S.snake(F.get(F.split(text, "[:—-]"), F.lit(0))), 1, 30)
        quantities = S.extract_quantities(F.regexp_replace(text, "^[^:—-]*[:—-]", ""))
        made = F.transform(quantities, lambda q: F.struct(predicate.alias("predicate"), q.alias("q"), F.lit(0.80).alias("confidence")))
        return F.when(text.rlike("[:—-]") & ~S.noisy_fragment(text), made)

    by_caption = F.transform(in_caption, lambda q: F.struct(F.lit("metric_in_figure").alias("predicate"), q.alias("q"), F.lit(0.85).alias("confidence")))
    by_parts = F.flatten(F.filter(F.transform("parts", labelled), lambda x: x.isNotNull()))
    facts = F.when(F.size(in_caption) > 0, by_caption).otherwise(by_parts)
    return rows.select("document_id", "element_id", F.posexplode(facts).alias("fact_no", "f")).select(
        "document_id", "element_id", "fact_no", "f.predicate", "f.confidence", "f.q.value_raw", "f.q.value_type", "f.q.unit", "f.q.currency", "f.q.scale", "f.q.qualifier"
    )


def build_facts(raw: DataFrame) -> DataFrame:
    """EXT-11: types inferred, qualifiers completed, predicate and confidence normalised."""
    numeric = F.col("value_type").isin("number", "percentage", "currency", "quantity")
    predicate = F.lower(S.strip(F.col("predicate")))
    inferred = (
        F.when(numeric, "numerical")
        .when(predicate.isin("appointed_as", "resigned_as", "acquired", "launched"), "event")
        .when(predicate.isin("operates", "owns", "located_at", "serves", "provides"), "relationship")
        .otherwise("attribute")
    )
    own = F.when(F.col("qualifier").isNotNull(), F.array("qualifier")).otherwise(F.array().cast("array<string>"))
    return raw.withColumns(
        {
            "fact_type": F.coalesce("fact_type", inferred),
            "predicate": predicate,
            "qualifiers": F.array_union(F.coalesce("qualifiers", F.array().cast("array<string>")), own),
            "time_type": F.coalesce("time_type", F.lit("unknown")),
            "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))),
        }
    )
