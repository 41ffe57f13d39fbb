"""Context of candidates: section headers above them and neighbours around them.

Orders restart on each page and are compared across pages, as the semantics want;
both operators therefore group by (document, order) first, so a document with a
tenth of all rows joins a few hundred orders, not its elements with each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEIGHBOURS = ("paragraph", "text", "list_item", "section_header", "caption")


def section_hierarchy(elements: DataFrame, depth: int = 3) -> DataFrame:
    """CTX-1: (document_id, canonical_order, headers): the last headers before the first element of at least that order.

    The scan for order n stops at the first element, in page order, whose order is n
    or more: the least position over the orders from n on.  Only one row per
    (document, order) takes part in that, however many pages a document has.
    """
    position = F.struct("page_no", "canonical_order", "raw_order", "element_id")
    firsts = elements.groupBy("document_id", "canonical_order").agg(F.min(position).alias("at"))
    onwards = Window.partitionBy("document_id").orderBy("canonical_order").rowsBetween(0, Window.unboundedFollowing)
    stops = firsts.select("document_id", "canonical_order", F.min("at").over(onwards).alias("stop"))
    headers = elements.where((F.col("element_type") == "section_header") & (F.trim("content") != ""))
    headers = headers.select("document_id", position.alias("at"), "content")
    last = Window.partitionBy("document_id", "canonical_order").orderBy(F.desc("at"))
    near = stops.join(headers, "document_id").where(F.col("at") < F.col("stop")).withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= depth)
    found = near.groupBy("document_id", "canonical_order").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]).alias("headers"))
    return stops.select("document_id", "canonical_order").join(found, ["document_id", "canonical_order"], "left").withColumn("headers", F.coalesce("headers", F.array().cast("array<string>")))


def neighbour_counts(elements: DataFrame, reach: int = 2) -> DataFrame:
    """CTX-3: per document and order, how many textual elements stand within the reach on any page.

    Counts per order are taken before orders are joined, which keeps the join small.
    """
    textual = elements.where(F.col("element_type").isin(*NEIGHBOURS))
    per_order = textual.groupBy("document_id", "canonical_order").agg(F.count(F.lit(1)).alias("n"))
    shifted = per_order.select("document_id", F.explode(F.array(*[F.col("canonical_order") + F.lit(d) for d in range(-reach, reach + 1) if d])).alias("canonical_order"), "n")
    near = shifted.groupBy("document_id", "canonical_order").agg(F.sum("n").alias("n_neighbours"))
    orders = elements.select("document_id", "canonical_order").distinct()
    return orders.join(near, ["document_id", "canonical_order"], "left").withColumn("n_neighbours", F.coalesce("n_neighbours", F.lit(0)))


def page_of(elements: DataFrame) -> DataFrame:
    """CTX-2: the first page each element_id is on."""
    return elements.groupBy("element_id").agg(F.coalesce(F.min("page_no"), F.lit(1)).alias("page_no"))
