"""Signal over intervals: an overlap join on bins, then a summary.

Bins turn the interval condition into an equality: an interval meets a record in the bins
that both cover, and a pair is taken in the first bin that they share, so that no pair is
counted twice and nothing has to be made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARIES = ("max", "mean", "center_max", "center_mean")


def bins(start: Column, end: Column, width: int) -> Column:
    first = F.floor(start / width)
    return F.sequence(first, F.greatest(first, F.floor((end - 1) / width)))


def overlaps(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs of left(chrom, start, end, ...) and right(chrom, start, end, ...) that share a base.

    right's columns but chrom get the prefix r_. width: about the length of a typical interval.
    """
    a = left.withColumn("_bin", F.explode(bins(F.col("start"), F.col("end"), width)))
    b = right.select("chrom", *[F.col(c).alias(f"r_{c}") for c in right.columns if c != "chrom"])
    b = b.withColumn("_bin", F.explode(bins(F.col("r_start"), F.col("r_end"), width)))
    met = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    first = F.greatest(F.floor(F.col("start") / width), F.floor(F.col("r_start") / width))
    return a.join(b, ["chrom", "_bin"]).where(met & (F.col("_bin") == first)).drop("_bin")


def center_window(start: Column, end: Column, width: int, length: Column | None = None) -> tuple[Column, Column]:
    """A window of fixed width around the middle; clamped to the contig, or at 0 and to one base."""
    s = F.floor((start + end) / 2).cast("long") - width // 2
    e = s + width
    if length is not None:
        return F.greatest(F.lit(0), F.least(s, length)), F.greatest(F.lit(0), F.least(e, length))
    s0 = F.greatest(F.lit(0).cast("long"), s)
    return s0, F.greatest(s0 + 1, e)


def summarise(intervals: DataFrame, signal: DataFrame, summary: str = "max", window_bp: int = 100, bin_width: int = 4096, weighted: bool = False) -> DataFrame:
    """chrom, start, end, value of every distinct interval; 0 where nothing overlaps.

    weighted: means weigh a record by the bases it shares, else all records weigh alike.
    """
    if summary not in SUMMARIES:
        raise ValueError(f"summary is one of {SUMMARIES}, not {summary}")
    asked = intervals.select(F.col("chrom"), F.col("start").alias("_s"), F.col("end").alias("_e")).distinct()
    s, e = center_window(F.col("_s"), F.col("_e"), window_bp) if summary.startswith("center_") else (F.col("_s"), F.col("_e"))
    asked = asked.withColumn("start", s).withColumn("end", e)
    met = overlaps(asked, signal, bin_width)
    shared = F.least("end", "r_end") - F.greatest("start", "r_start")
    value = F.max("r_value") if summary.endswith("max") else F.sum(F.col("r_value") * shared) / F.sum(shared) if weighted else F.avg("r_value")
    found = met.groupBy("chrom", "_s", "_e").agg(value.alias("value"))
    out = asked.select("chrom", "_s", "_e").join(found, ["chrom", "_s", "_e"], "left")
    clean = F.when(F.isnan("value") | (F.abs("value") == float("inf")), F.lit(0.0)).otherwise(F.coalesce("value", F.lit(0.0)))
    return out.select("chrom", F.col("_s").alias("start"), F.col("_e").alias("end"), clean.alias("value"))
