"""Candidate selection: which elements can bear facts, and in what order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.scalar import has_fact_word, has_number, has_time, is_noise, strip

TEXTUAL = ("paragraph", "text", "list_item", "section_header", "footnote", "caption")


def is_table() -> Column:
    return F.col("element_type") == "table"


def is_figure() -> Column:
    return F.col("element_type").isin("figure", "image")


def bears_facts() -> Column:
    """SEL-6."""
    text = F.coalesce("content", F.lit(""))
    return F.col("element_type").isin(*TEXTUAL) & ~is_noise(text) & (has_fact_word(text) | has_number(text) | (F.col("element_type") == "caption"))


def relevant_table() -> Column:
    """SEL-7."""
    rows = F.col("table_rows")
    cells = F.exists(F.flatten(F.filter(rows, lambda r: r.isNotNull())), lambda c: strip(c) != "")
    layout = (F.size(rows) == 1) & (F.size(F.get(rows, F.lit(0))) <= 1)
    return F.coalesce((F.size(rows) > 0) & ~layout & cells, F.lit(False))


def relevant_figure() -> Column:
    """SEL-8."""
    caption = F.coalesce((F.length("caption") > 0) & ~is_noise(F.col("caption")), F.lit(False))
    parts = F.coalesce(F.exists("text_fragments", lambda f: ~is_noise(f["text"])), F.lit(False))
    return caption | parts


def priority() -> Column:
    """SEL-9."""
    text = F.coalesce("content", F.lit(""))
    return (
        F.when(is_table(), 1)
        .when(is_figure(), 6)
        .when(F.col("element_type") == "caption", 5)
        .when(has_number(text), 2)
        .when(has_time(text), 3)
        .when(has_fact_word(text), 4)
        .otherwise(10)
    )


def select_candidates(elements: DataFrame) -> DataFrame:
    """SEL-10: one row per element, with its priority."""
    first = Window.partitionBy("element_id").orderBy("page_no", "canonical_order", "raw_order", "ingested_at")
    wanted = F.when(is_table(), relevant_table()).when(is_figure(), relevant_figure()).otherwise(bears_facts())
    kept = elements.where(F.col("element_id").isNotNull()).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").where(wanted)
    return kept.withColumn("priority", priority())


def queue_order() -> list[Column]:
    """The order in which candidates are worked through; consumers sort by it only where they need to."""
    return [F.col(c) for c in ("document_id", "priority", "canonical_order", "page_no", "raw_order", "element_id")]
