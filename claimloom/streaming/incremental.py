"""Incremental versions of operators as Structured Streaming sinks.

A stream of new facts is matched against the stored ones batch by batch: new
against old and new against new gives the same pairs as matching all at once.
References are folded into the pending-orphan state batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimloom.operators import block, orphans


def new_pairs(old: DataFrame, new: DataFrame, cross_document: bool = True) -> DataFrame:
    """Exact-block pairs of facts with at least one new side: (fact_a, fact_b), the smaller id first."""
    cols = ["fact_id", "document_id", "norm_subject", "norm_predicate", "fact_type", "value_type"]
    n = block.index_facts(new).select(cols)
    everything = block.index_facts(old).select(cols).unionByName(n)
    known = lambda d: d.where(block.exact_subject(F.col("norm_subject"), cross_document) & (F.col("norm_predicate") != ""))
    a, b = known(n).alias("a"), known(everything).alias("b")
    from claimloom.operators.compare import types_compatible

    on = (F.col("a.norm_subject") == F.col("b.norm_subject")) & (F.col("a.norm_predicate") == F.col("b.norm_predicate")) & (F.col("a.fact_id") != F.col("b.fact_id"))
    on = on & types_compatible(F.col("a.fact_type"), F.col("b.fact_type"), F.col("a.value_type"), F.col("b.value_type"))
    if cross_document:
        on = on & (F.col("a.document_id") != F.col("b.document_id"))
    return a.join(b, on).select(F.least("a.fact_id", "b.fact_id").alias("fact_a"), F.greatest("a.fact_id", "b.fact_id").alias("fact_b")).distinct()


def match_stream(facts: DataFrame, store: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the pairs of each batch of a fact stream to ``out`` and the facts to ``store``.

    Batches are written under their number, so a batch that is run again replaces itself.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = spark.read.schema(batch.schema).option("recursiveFileLookup", "true").parquet(store) if number else batch.limit(0)
        if number:
            # a rerun must not meet its own earlier attempt
            earlier = earlier.where(~F.contains(F.input_file_name(), F.lit(f"/batch={number}/")))
        new_pairs(earlier, batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return facts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def orphan_stream(facts: DataFrame, to_refs: Callable[[DataFrame], DataFrame], to_events: Callable[[DataFrame], DataFrame], store: orphans.OrphanStore, checkpoint: str, on_batch: Callable[[orphans.OrphanStore, int], None] | None = None) -> StreamingQuery:
    """Fold each batch into the orphan state on disk; ``on_batch`` gets the store after every batch, for snapshots.

    The store is written under the batch's number, so a batch that is run again replaces itself and a restart goes on.
    """

    def step(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        store.advance(number, to_refs(kept), to_events(kept))
        kept.unpersist()
        if on_batch:
            on_batch(store, number)

    return facts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def monthly_counts(facts: DataFrame, watermark: str = "30 days") -> DataFrame:
    """Facts per month of extraction and type, with late rows dropped beyond the watermark."""
    rows = facts.withColumn("extracted", F.col("extracted_at").cast("timestamp")).withWatermark("extracted", watermark)
    return rows.groupBy(F.window("extracted", "30 days"), "fact_type").agg(F.count(F.lit(1)).alias("n"))
