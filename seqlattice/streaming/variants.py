"""Variants as a stream against a static index: stateless, so no watermark is needed.

A micro-batch is matched by the same dataflow as a table; its counts leave by foreachBatch,
which writes each batch under its number, so that a repeated batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import matching


def matched(variants: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """variant, motif_pos, allele, region, place of a stream variants(variant, seq, at): one row a hit.

    A hit on both strands is two rows here; a batch's consumer keeps the forward one.
    """
    asked = matching.probes(matching.variant_windows(variants, k), k).select("variant", "motif_pos", "j", "allele", F.col("probe").alias("kmer"), "is_reverse")
    place = F.when(F.col("is_reverse"), F.col("offset") + (k - 1) - F.col("j")).otherwise(F.col("offset") + F.col("j"))
    return asked.join(index, "kmer").select("variant", "motif_pos", "allele", "region", place.alias("place"), "is_reverse")


def start(variants: DataFrame, index: DataFrame, k: int, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes every batch's matches, one place a region, to folder/batch=<number>."""

    def write(batch: DataFrame, number: int) -> None:
        once = batch.groupBy("variant", "motif_pos", "allele", "region").agg(F.min_by("place", "is_reverse").alias("place"))
        once.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return matched(variants, index, k).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """window, event_type, n, total of a stream events(ts, event_type, value); later events are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
