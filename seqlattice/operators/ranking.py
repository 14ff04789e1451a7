"""Ranks over whole tables and statistics of rank sets.

A global rank is never computed in one task: rows fall into value buckets, the small table of
bucket counts gives each bucket's first rank, and only a bucket's rows are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S


def global_rank(rows: DataFrame, value: str, tie: str, buckets: int | None = None, in_bucket: int = 100_000) -> DataFrame:
    """rows with rank (0 is the highest value, NaN and null last, ties by the number ``tie`` up) and n_total.

    Bucket bounds are approximate quantiles of the value, so buckets are of like size; their
    number follows that of the rows (``in_bucket`` each), 4,096 at most. A value that is a
    bound more than once, and the missing ones, are cut further by quantiles of ``tie``. One
    pass fetches all bounds.
    """
    clean = F.when(~F.isnan(value), F.col(value))
    if buckets is None:
        buckets = min(4096, max(32, rows.count() // in_bucket))
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    found = rows.agg(F.percentile_approx(clean, shares, F.lit(10000)).alias("b"), F.percentile_approx(F.col(tie).cast("double"), shares, F.lit(10000)).alias("t")).first()
    cuts = found["b"] or []
    doubles = lambda v: F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")
    bounds, heavy, ties = doubles(sorted(set(cuts))), doubles(sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})), doubles(sorted(set(found["t"] or [])))
    often = clean.isNull() | F.array_contains(heavy, F.coalesce(clean, F.lit(0.0)))
    above = F.when(clean.isNull(), F.lit(buckets + 1)).otherwise(F.size(F.filter(bounds, lambda x: x > clean)))
    slot = F.when(often, F.size(F.filter(ties, lambda x: x < F.col(tie).cast("double"))) + 1).otherwise(0)
    keyed = rows.withColumn("_bucket", above * (buckets + 2) + slot)  # within a bound the values above it come first
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    order = W.orderBy("_bucket")
    first = counts.select("_bucket", F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"), F.sum("_n").over(W.partitionBy()).alias("n_total"))
    at = F.row_number().over(W.partitionBy("_bucket").orderBy(clean.desc_nulls_last(), tie)) - 1
    return keyed.withColumn("_at", at).join(F.broadcast(first), "_bucket").withColumn("rank", F.col("_first") + F.col("_at")).drop("_bucket", "_at", "_first")


def rounded_means(rows: DataFrame, key: str, values: list[str], order: list[Column], places: int = 6, broadcast: int = 100_000) -> DataFrame:
    """key, n and the mean of each value, rounded half up, as its doubles added in that order of the rows give it.

    The order of a sum decides a rounded mean only where the mean is within the error of its sum
    of a tie. The rows of such keys alone are read again and added in order, as running sums, so
    that no task holds the rows of a key; up to ``broadcast`` of these keys are sent to the tasks.
    """
    scale = float(10**places)
    mean, size, many = (lambda v, t=t: f"_{t}_{v}" for t in ("mean", "size", "many"))
    sums = [F.avg(v).alias(mean(v)) for v in values] + [F.sum(F.abs(v)).alias(size(v)) for v in values] + [F.count(v).alias(many(v)) for v in values]
    found = rows.groupBy(key).agg(F.count("*").alias("n"), *sums).persist()
    shown = lambda v: F.abs(F.col(mean(v)) * scale)
    error = lambda v: F.col(size(v)) / F.col(many(v)) * (F.col(many(v)) + 4) * (scale * 2.0**-52)
    unsure = F.lit(False)
    for v in values:
        unsure |= (F.col(many(v)) > 0) & (F.abs(shown(v) - F.floor(shown(v)) - 0.5) <= error(v))
    keys = found.where(unsure).select(F.col(key).alias("_key"))
    again = rows.select(key, *values, F.struct(*order).alias("_order"))
    again = again.join(F.broadcast(keys) if keys.count() <= broadcast else keys, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    by = W.partitionBy(key).orderBy("_order")
    upto = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = again.select(F.col(key).alias("_key"), F.row_number().over(by).alias("_at"), F.struct(*[F.sum(v).over(upto).alias(v) for v in values]).alias("_sums"))
    last = summed.groupBy("_key").agg(F.max_by("_sums", "_at").alias("_sums"))
    out = found.join(last, F.col(key).eqNullSafe(F.col("_key")), "left")
    exact = lambda v: F.when(F.col("_sums").isNull(), F.col(mean(v))).otherwise(F.col("_sums")[v] / F.nullif(many(v), F.lit(0)))
    return out.select(key, "n", *[(F.round(exact(v) * scale) / scale).alias(v) for v in values])


def exact_means(rows: DataFrame, key: str, values: list[str], places: int = 6) -> DataFrame:
    """key, n and the mean of each value, rounded half up, of sums of its decimals: no order of the rows decides a tie.

    Values that no decimal of 10 digits before the point holds (NaN and infinite ones too) are added as doubles.
    """
    scale = float(10**places)
    decimal = lambda v: F.col(v).try_cast("decimal(28,18)")
    mean = lambda v: F.when(F.count(decimal(v)) == F.count(v), F.sum(decimal(v)).cast("double") / F.nullif(F.count(v), F.lit(0))).otherwise(F.avg(v))
    return rows.groupBy(key).agg(F.count("*").alias("n"), *[(F.round(mean(v) * scale) / scale).alias(v) for v in values])


def e_score(f: Column, rank_sum: Column, n_total: Column) -> Column:
    """AUC less one half of f ranks with that sum among n_total; null if f is none or all."""
    b = n_total - f
    doubled = 2 * f * (n_total - 1) - 2 * rank_sum - f * (f - 1)
    return F.when((f > 0) & (b > 0), doubled / (2 * f * b) - 0.5)


def scored(sets: DataFrame, ranks: DataFrame, by: list[str], min_f: int) -> DataFrame:
    """by..., F, E of the sets (by..., region) with min_f ranked regions at least."""
    found = sets.select(*by, "region").distinct().join(ranks.select("region", "rank", "n_total"), "region")
    out = found.groupBy(*by).agg(F.count("*").alias("F"), F.sum("rank").alias("_sum"), F.max("n_total").alias("_n")).where(F.col("F") >= min_f)
    return out.select(*by, "F", e_score(F.col("F"), F.col("_sum"), F.col("_n")).alias("E"))


def probe_sets(index: DataFrame, combine_revcomp: bool = True) -> DataFrame:
    """kmer, region: distinct pairs, both strands under the canonical k-mer."""
    key = S.canonical("kmer") if combine_revcomp else F.col("kmer")
    return index.select(key.alias("kmer"), "region").distinct()


def choose_seed(sets: DataFrame, ranks: DataFrame, k: int, *, min_f: int = 20, max_gaps: int = 3) -> DataFrame:
    """kmer, E, F, gaps of every k-mer and gapped pattern, all masks in one job.

    Patterns group the stored strings as they are, without their reverse complements.
    """
    masks = [m for g in range(0, min(max_gaps, k) + 1) for m in S.gap_masks(k, g)]
    patterns = F.array(*[F.struct(S.gapped("kmer", m, k).alias("pattern"), F.lit(k - len(m)).alias("gaps")) for m in masks])
    rows = sets.select("region", F.explode(patterns).alias("p")).select(F.col("p.pattern").alias("kmer"), "p.gaps", "region")
    return scored(rows, ranks, ["kmer", "gaps"], min_f).select("kmer", "E", "F", "gaps")


def disjoint(sets: DataFrame, by: list[str]) -> DataFrame:
    """sets(by..., base, region) without the regions that two bases of a group share."""
    code = S.base_code("base")
    out = sets.groupBy(*by, "region").agg(F.min(code).alias("_low"), F.max(code).alias("_high")).where("_low = _high")
    return out.select(*by, "region", S.base_of(F.col("_low")).alias("base"))


def reduced_scores(sets: DataFrame, ranks: DataFrame, by: list[str], least: int = 1, buckets: int = 256) -> DataFrame:
    """by..., base, F, B, E_reduced, z of each base's regions against those of the group's other bases.

    sets are disjoint. Ranks are taken among the group's regions, the lowest rank highest; z
    is the normal approximation of the Mann-Whitney statistic, without corrections. A base of
    fewer than ``least`` regions has no score, but its regions stay in the background.
    """
    joined = sets.join(ranks.select("region", F.col("rank").alias("_r"), "n_total"), "region")
    joined = joined.withColumn("_bucket", F.floor((F.col("n_total") - 1 - F.col("_r")) * buckets / F.col("n_total")))
    counts = joined.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    first = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    own = F.col("_first") + F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(F.col("_r").desc()))
    out = joined.join(first, [*by, "_bucket"]).withColumn("_own", own).groupBy(*by, "base").agg(F.count("*").alias("F"), F.sum("_own").alias("_sum"))
    total = F.sum("F").over(W.partitionBy(*by))
    out = out.withColumn("B", total - F.col("F"))
    u = F.col("_sum") - F.col("F") * (F.col("F") + 1) / 2
    fb = F.col("F") * F.col("B")
    good = (F.col("B") > 0) & (F.col("F") >= least)
    z = (u - fb / 2) / F.sqrt(fb * (F.col("F") + F.col("B") + 1) / 12)
    return out.select(*by, "base", "F", F.when(good, F.col("B")).otherwise(0).alias("B"), F.when(good, u / fb - 0.5).alias("E_reduced"), F.when(good, z).alias("z"))


def cumulative_rates(rows: DataFrame, hit: str, buckets: int = 256) -> DataFrame:
    """rank, fg, fg_rate, bg_rate along rows(rank, n_total, hit 0/1): running counts by rank buckets."""
    keyed = rows.withColumn("_bucket", F.floor(F.col("rank") * buckets / F.col("n_total")))
    counts = keyed.groupBy("_bucket").agg(F.sum(hit).alias("_h"), F.count("*").alias("_n"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("_bucket", F.coalesce(F.sum("_h").over(before), F.lit(0)).alias("_first"), F.sum("_h").over(W.partitionBy()).alias("_hits"), F.sum("_n").over(W.partitionBy()).alias("_all"))
    run = F.sum(hit).over(W.partitionBy("_bucket").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    out = keyed.withColumn("_run", run).join(F.broadcast(first), "_bucket").withColumn("fg", F.col("_first") + F.col("_run"))
    return out.select("rank", "fg", F.round(F.col("fg") / F.col("_hits"), 9).alias("fg_rate"), F.round((F.col("rank") + 1 - F.col("fg")) / (F.col("_all") - F.col("_hits")), 9).alias("bg_rate"))
