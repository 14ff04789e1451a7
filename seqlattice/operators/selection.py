"""Multiple testing and the choice of one window a variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def finite(x: Column | str) -> Column:
    """x, null where it is NaN or infinite."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def holm(rows: DataFrame, family: list[str], p: str = "pval", out: str = "pval_holm", order: list[str] | None = None) -> DataFrame:
    """rows with the Holm-adjusted p of each family; missing p-values take no part.

    Step-down: (m - rank + 1) p, running maximum, 1 at most.
    """
    valid = F.when(finite(p).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), finite(p))))
    keyed = rows.withColumn("_p", valid).withColumn("_no", F.col("_p").isNull())
    by_p = W.partitionBy(*family, "_no").orderBy("_p", *(order or []))
    m = F.count("_p").over(W.partitionBy(*family, "_no"))
    step = (m - F.row_number().over(by_p) + 1) * F.col("_p")
    keyed = keyed.withColumn("_step", step)
    run = F.max("_step").over(by_p.rowsBetween(W.unboundedPreceding, 0))
    return keyed.withColumn(out, F.when(~F.col("_no"), F.least(run, F.lit(1.0)))).drop("_p", "_no", "_step")


def holm_within_variant(rows: DataFrame) -> DataFrame:
    """rows(variant, label, motif_pos, allele, ref, alt, pval) with pval_holm.

    Two families a variant: AFF of the alternative allele, RAND of both alleles. Other rows
    have none.
    """
    member = F.when((F.col("label") == "AFF") & (F.col("allele") == F.col("alt")), "AFF").when((F.col("label") == "RAND") & (F.col("allele").isin("A", "C", "G", "T")) & ((F.col("allele") == F.col("ref")) | (F.col("allele") == F.col("alt"))), "RAND")
    keyed = rows.withColumn("_family", member)
    out = holm(keyed.withColumn("_test", F.when(F.col("_family").isNotNull(), F.col("pval"))), ["variant", "_family"], "_test", "pval_holm", ["motif_pos", "allele"])
    return out.drop("_family", "_test")


def _choice(rows: DataFrame, use_holm: bool, level: float) -> DataFrame:
    """rows with _key: for the windows that may be chosen, what orders them (the least is chosen)."""
    p = finite("pval_holm" if use_holm else "pval")
    passes = (F.col("label") == "RAND") & ((F.col("allele") == F.col("alt")) | (F.col("allele") == F.col("ref"))) & (p < level) & (finite("coef") > 0)
    supported = F.max(F.coalesce(passes, F.lit(False)).cast("int")).over(W.partitionBy("variant", "motif_pos"))
    raw = F.when(~F.isnan("pval"), F.col("pval"))
    key = F.struct((1 - F.col("_supported")).alias("a"), raw.alias("p"), F.coalesce(-F.abs(finite("coef")), F.lit(0.0)).alias("c"), F.col("motif_pos").alias("motif_pos"))
    asked = (F.col("label") == "AFF") & (F.col("allele") == F.col("alt")) & raw.isNotNull()
    return rows.withColumn("_supported", supported).withColumn("_key", F.when(asked, key)).drop("_supported")


def best_window(rows: DataFrame, use_holm: bool = False, level: float = 0.05) -> DataFrame:
    """variant, motif_pos: of the windows by AFF p, then effect size, then place, the first whose
    background test of either allele is positive and below the level; else the first.
    """
    best = _choice(rows, use_holm, level).groupBy("variant").agg(F.min("_key").alias("_key")).where("_key is not null")
    return best.select("variant", "_key.motif_pos")


def summary_rows(rows: DataFrame, use_holm: bool = False, level: float = 0.05) -> DataFrame:
    """Three rows a variant at its best window: AFF of the alternative, RAND of the reference and
    of the alternative; without values where there is no such row. One shuffle by variant.
    """
    best = F.min("_key").over(W.partitionBy("variant"))["motif_pos"]
    chosen = _choice(rows, use_holm, level).withColumn("_best", best)
    values = F.struct(F.col("coef").alias("effect"), F.col("pval").alias("raw_pval"), (F.col("pval_holm") if use_holm else F.col("pval")).alias("pval"))
    wanted = [("AFF", "alt"), ("RAND", "ref"), ("RAND", "alt")]
    here = F.col("motif_pos") == F.col("_best")
    picks = [F.min(F.when(here & (F.col("label") == t) & (F.col("allele") == F.col(a)), values)).alias(f"_{i}") for i, (t, a) in enumerate(wanted)]
    wide = chosen.groupBy("variant", "ref", "alt").agg(F.first("_best").alias("motif_pos"), *picks)
    lines = F.array(*[F.struct(F.lit(i).alias("line"), F.lit(t).alias("label"), F.col(a).alias("allele"), F.col(f"_{i}").alias("v")) for i, (t, a) in enumerate(wanted)])
    return wide.select("variant", "motif_pos", F.explode(lines).alias("l")).select("variant", "l.line", "l.label", "l.allele", "motif_pos", "l.v.effect", "l.v.raw_pval", "l.v.pval")


def best_p(rows: DataFrame, by: list[str]) -> DataFrame:
    """The row of the smallest positive p of each group, larger effects first, then window order."""
    usable = rows.where(~F.isnan("pval") & (F.col("pval") > 0))
    order = W.partitionBy(*by).orderBy("pval", F.abs("coef").desc(), "motif_pos", "j")
    out = usable.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")
    return out.withColumn("method", F.concat("method", F.lit("|best_pval")))
