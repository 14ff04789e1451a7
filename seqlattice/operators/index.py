"""K-mer indexes: tokenise regions, group into an inverted index, keep unique occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S


CHUNK = 512  # starts a chunk; a substring walks to its place, so long sequences are cut first


def windows(regions: DataFrame, k: int) -> DataFrame:
    """region, offset (1-based), kmer of every window of k characters of regions(region, seq), in upper case."""
    long_ = regions.select("region", F.upper("seq").alias("_s")).where(F.length("_s") >= k)
    chunks = long_.select("region", "_s", F.explode(F.sequence(F.lit(0), F.length("_s") - k, F.lit(CHUNK))).alias("_from"))
    cut = chunks.select("region", "_from", F.substring(F.col("_s"), F.col("_from") + 1, F.lit(CHUNK + k - 1)).alias("_c"))
    at = cut.select("region", "_from", "_c", F.explode(F.sequence(F.lit(1), F.length("_c") - (k - 1))).alias("_i"))
    return at.select("region", (F.col("_from") + F.col("_i")).alias("offset"), F.substring(F.col("_c"), F.col("_i"), F.lit(k)).alias("kmer"))


def tokens(regions: DataFrame, k: int) -> DataFrame:
    """region, kmer, offset (1-based) of every window of A, C, G and T of regions(region, seq).

    Projections and generators that compile into one stage: no shuffle, no lambda.
    """
    return windows(regions, k).where(F.col("kmer").rlike("^[ACGT]+$")).select("region", "kmer", "offset")


def inverted_index(regions: DataFrame, k: int) -> DataFrame:
    """kmer, region, n, offsets (ascending): one shuffle by (kmer, region), counts combined before it."""
    return tokens(regions, k).groupBy("kmer", "region").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("offset")).alias("offsets"))


def unique_index(regions: DataFrame, k: int) -> DataFrame:
    """kmer, region, offset of the k-mers that a region holds exactly once.

    Count and least offset are partial aggregates; nothing is collected in lists.
    """
    return tokens(regions, k).groupBy("kmer", "region").agg(F.count("*").alias("n"), F.min("offset").alias("offset")).where("n = 1").drop("n")


def masked_tokens(regions: DataFrame, mask: str) -> DataFrame:
    """region, code, offset (1-based), is_reverse of the spaced signatures of both strands.

    The reverse signature of a window is the signature of its reverse complement.
    """
    both = windows(regions, len(mask)).withColumn("is_reverse", F.explode(F.array(F.lit(False), F.lit(True))))
    strand = F.when(F.col("is_reverse"), S.reverse_complement("kmer")).otherwise(F.col("kmer"))
    return both.select("region", S.signature(strand, mask).alias("code"), "offset", "is_reverse").where("code is not null")


def masked_hits(regions: DataFrame, mask: str, targets: DataFrame, *, by_strand: bool) -> DataFrame:
    """code, region, offset, is_reverse of target signatures (code) that a region holds once.

    by_strand: the two strands of one window are two occurrences; else one.
    """
    found = masked_tokens(regions, mask).join(targets.select("code").distinct(), "code")
    places = F.count_distinct("offset", "is_reverse") if by_strand else F.count_distinct("offset")
    return found.groupBy("code", "region").agg(places.alias("n"), F.min("offset").alias("offset"), F.min("is_reverse").alias("is_reverse")).where("n = 1").drop("n")


def index_text(index: DataFrame, order: DataFrame) -> DataFrame:
    """The text form of inverted_index(): kmer, entries 'region;count;offsets' in the order of order(region, ord)."""
    entry = F.concat_ws(";", "region", F.col("n").cast("string"), F.concat_ws(" ", F.transform("offsets", lambda o: o.cast("string"))))
    rows = index.join(order.select("region", "ord"), "region").groupBy("kmer").agg(F.array_sort(F.collect_list(F.struct("ord", entry.alias("entry")))).alias("e"))
    return rows.select("kmer", F.concat_ws(",", F.transform("e", lambda e: e["entry"])).alias("entries")).orderBy("kmer")


def missing_kmers(index: DataFrame, k: int) -> DataFrame:
    """The k-mers of 4**k that the index lacks."""
    spark, n = index.sparkSession, 4**k
    digits = [F.substring(F.lit("ACGT"), (F.shiftright("id", 2 * i).bitwiseAND(F.lit(3).cast("long")) + 1).cast("int"), F.lit(1)) for i in range(k - 1, -1, -1)]
    return spark.range(n).select(F.concat(*digits).alias("kmer")).join(index.select("kmer"), "kmer", "left_anti")
