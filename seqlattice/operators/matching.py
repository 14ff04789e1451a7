"""Matches of variant and scan windows against a unique k-mer index.

A probe is one question to the index: the tested window with one allele, on one strand. All
probes of all variants are one table, joined to the index by k-mer; a region is hit at most
once for each window and allele, by the strand that the rule names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S

MOST_BROADCAST = 100_000  # k-mers, of some bytes each


def variant_windows(variants: DataFrame, k: int) -> DataFrame:
    """variants(variant, seq, at, ...) with the windows over the tested base: motif_pos, j, kmer."""
    at = variants.withColumn("motif_pos", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("j", F.col("at") - F.col("motif_pos"))
    at = at.where(F.col("j").between(0, k - 1))
    return at.withColumn("kmer", F.substring(F.col("seq"), F.col("motif_pos") + 1, F.lit(k))).where(F.length("kmer") == k)


def interval_windows(intervals: DataFrame, k: int) -> DataFrame:
    """intervals(interval, seq) with every window and every tested place in it: motif_pos, j, kmer."""
    rows = intervals.select("interval", F.explode(S.windows("seq", k)).alias("w")).select("interval", (F.col("w.offset") - 1).alias("motif_pos"), "w.kmer")
    return rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def probes(windows: DataFrame, k: int, *, palindrome: str = "reverse") -> DataFrame:
    """windows with allele, filled, probe, is_reverse: both strands of each filled window.

    palindrome: a window that is its own reverse complement is asked once, flagged 'forward'
    or 'reverse', or 'both' to ask it on both strands.
    """
    rows = windows.withColumn("allele", F.explode(F.array(*map(F.lit, S.BASES)))).withColumn("filled", S.replaced("kmer", F.col("j"), F.col("allele")))
    rows = rows.withColumn("_rc", S.reverse_complement("filled"))
    forward, reverse = F.struct(F.col("filled").alias("probe"), F.lit(False).alias("is_reverse")), F.struct(F.col("_rc").alias("probe"), F.lit(True).alias("is_reverse"))
    own = {"reverse": F.array(reverse), "forward": F.array(forward), "both": F.array(forward, reverse)}[palindrome]
    return rows.withColumn("_p", F.explode(F.when(F.col("_rc") == F.col("filled"), own).otherwise(F.array(forward, reverse)))).select(*windows.columns, "allele", "filled", "_p.probe", "_p.is_reverse")


def among(index: DataFrame, kmers: DataFrame) -> DataFrame:
    """The index behind kmers(kmer): few enough are broadcast, and so sift the tokens before the index's shuffle."""
    if kmers.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        return index
    return index.join(F.broadcast(kmers), "kmer", "left_semi")


def match(windows: DataFrame, index: DataFrame, k: int, by: list[str], *, last_strand: bool = False, palindrome: str = "reverse") -> DataFrame:
    """by..., allele, region, place (of the tested base in the region).

    by: the columns that name a window. A region hit on both strands counts once, by the
    forward strand, or by the reverse one with last_strand.
    """
    asked = probes(windows, k, palindrome=palindrome).select(*by, "j", "allele", F.col("probe").alias("kmer"), "is_reverse").distinct()
    found = asked.join(index if index.is_cached else among(index, asked.select("kmer").distinct()), "kmer").withColumn("place", S.wildcard_place(F.col("offset"), F.col("j"), k, F.col("is_reverse")))
    pick = F.max_by if last_strand else F.min_by
    return found.groupBy(*by, "allele", "region").agg(pick("place", "is_reverse").alias("place"))


def unambiguous(matches: DataFrame, by: list[str]) -> DataFrame:
    """matches of regions that one allele of the window alone hits."""
    code = S.base_code("allele")
    out = matches.groupBy(*by, "region").agg(F.min(code).alias("_low"), F.max(code).alias("_high"), F.min("place").alias("place")).where("_low = _high")
    return out.select(*by, "region", S.base_of(F.col("_low")).alias("allele"), "place")


def design(matches: DataFrame, by: list[str], intensity: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """by..., region, allele, y, lp, sl [, cpg_oe]: the rows of each window's regression.

    context(region, cpg_oe) is joined from the left; a missing value is the window's median,
    0 if the window has none.
    """
    rows = unambiguous(matches, by).join(intensity.select("region", F.col("value").alias("y")), "region")
    size = S.region_length("region")
    rows = rows.withColumn("sl", size.cast("double")).withColumn("lp", S.folded_place(F.col("place"), size))
    if context is None:
        return rows.select(*by, "region", "allele", "y", "lp", "sl")
    rows = rows.join(context.select("region", F.when(~F.isnan("cpg_oe"), F.col("cpg_oe")).alias("cpg_oe")), "region", "left")
    short = rows.where("cpg_oe is null").select(*by).distinct()
    middle = rows.join(short, by, "left_semi").groupBy(*by).agg(F.percentile("cpg_oe", F.lit(0.5)).alias("_middle"))
    filled = rows.join(middle, by, "left").withColumn("cpg_oe", F.coalesce("cpg_oe", "_middle", F.lit(0.0)))
    return filled.select(*by, "region", "allele", "y", "lp", "sl", "cpg_oe")


def masked_tests(windows: DataFrame, mask: str) -> DataFrame:
    """windows with allele and code, the signature with that allele; only windows whose tested place is a one take part."""
    tested = windows.where(F.col("j").isin(list(S.informative(mask))))
    return tested.withColumn("allele", F.explode(F.array(*map(F.lit, S.BASES)))).withColumn("code", S.signature(S.replaced("kmer", F.col("j"), F.col("allele")), mask)).where("code is not null")


def masked_match(windows: DataFrame, regions: DataFrame, mask: str, by: list[str]) -> DataFrame:
    """match() by the spaced signature of a mask; only windows whose tested place is a one take part."""
    asked = masked_tests(windows, mask)
    from .index import masked_hits

    hits = masked_hits(regions, mask, asked, by_strand=True)
    return asked.select(*by, "j", "allele", "code").distinct().join(hits, "code").select(*by, "allele", "region", S.wildcard_place(F.col("offset"), F.col("j"), len(mask), F.col("is_reverse")).alias("place"))
