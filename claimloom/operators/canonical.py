"""Canonical elements: reading order, page numbers, table captions and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions.scalar import blank_to_null, normalize_text, strip

_CAPTION = r"^(Table [\w.]+: [^.]+)\.(.+)$"


def latest_elements(elements: DataFrame) -> DataFrame:
    """One row per element_id: the last delivery; ties go to a live row."""
    w = Window.partitionBy("element_id").orderBy(F.desc("ingested_at"), F.coalesce("is_deleted", F.lit(False)), F.desc("content"))
    return elements.where(F.col("element_id").isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def assemble_pages(elements: DataFrame) -> DataFrame:
    """CAN-6: elements without a page belong to page 1; one row per page with its element count."""
    pages = elements.withColumn("page_no", F.coalesce("page_no", F.lit(1)))
    return pages.groupBy("document_id", "page_no").agg(F.count(F.lit(1)).alias("n_elements"))


def reading_order(elements: DataFrame, column_width: float = 250.0) -> DataFrame:
    """CAN-4: order on the page by column band, then top, then raw order."""
    left, top = F.coalesce("bbox.left", F.lit(0.0)), F.coalesce("bbox.top", F.lit(0.0))
    # the tie-break on element_id only makes redelivered rows deterministic
    w = Window.partitionBy("document_id", "page_no").orderBy(F.bround(left / column_width) * column_width, top, "raw_order", "element_id")
    return elements.withColumn("reading_order", F.row_number().over(w) - 1)


def recovered_page_numbers(elements: DataFrame) -> DataFrame:
    """CAN-5: per page, the first integer in the first header or footer that has one."""
    number = blank_to_null(F.regexp_extract("content", r"\b(\d+)\b", 1))
    running = elements.where(F.col("element_type").isin("page_header", "page_footer") & number.isNotNull())
    return running.groupBy("document_id", "page_no").agg(F.min_by(number, F.struct("raw_order", "element_id")).alias("printed_number"))


def split_caption(caption: Column, headers: Column) -> tuple[Column, Column]:
    """CAN-2: a caption run into the first header cell is taken out of it."""
    first = F.get(headers, F.lit(0))
    hit = F.coalesce(first.rlike(_CAPTION), F.lit(False))
    rest = F.transform(headers, lambda h, i: F.when(i == 0, strip(F.regexp_extract(h, _CAPTION, 2))).otherwise(h))
    return F.when(hit, F.regexp_extract(first, _CAPTION, 1)).otherwise(caption), F.when(hit, rest).otherwise(headers)


def split_source(rows: Column) -> tuple[Column, Column]:
    """CAN-3: rows that state a source are removed; the last one is the source."""
    text = lambda r: F.array_join(F.filter(F.transform(r, lambda c: strip(c)), lambda c: c != ""), " ")
    is_source = lambda r: F.coalesce(text(r).rlike(r"(?i)^source:"), F.lit(False))
    return F.filter(rows, lambda r: ~is_source(r)), F.get(F.reverse(F.transform(F.filter(rows, is_source), text)), F.lit(0))


def canonical_tables(elements: DataFrame) -> DataFrame:
    """Tables with caption, headers, rows and source in their places."""
    caption, headers = split_caption(F.col("caption"), F.col("headers"))
    rows, source = split_source(F.col("table_rows"))
    return elements.where(F.col("element_type") == "table").withColumns(
        {"caption": caption, "headers": headers, "table_rows": rows, "source": F.coalesce(source, F.col("source"))}
    )


def canonical_text(elements: DataFrame) -> DataFrame:
    """CAN-1 over the content of elements."""
    return elements.withColumn("content", normalize_text(F.col("content")))
