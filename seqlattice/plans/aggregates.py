"""Aggregations: the index, scores, reduced scores, summaries and fits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.stats import normal_p
from ..operators import background, calibrate, capped, fits, index, local, matching, motif, ranking, signal
from ..operators.selection import finite
from ..sources import tables
from . import sql
from .matches import _FAMILY_ALL, _INTERVALS, _SNV, WINDOW, _index, _long, _windows
from .registry import query
from .scalars import CPG, K, MASK


def ranks(spark, sf_dir):
    return ranking.global_rank(tables.intensity(spark, sf_dir), "value", "ord")


def sets(spark, sf_dir, k=K):
    return ranking.probe_sets(_index(spark, sf_dir, k))


@query("AGG-1_inverted_index", sql.with_(sql.REGIONS, sql.tokens(K)) + "select kmer, region, count(*) as n, string_agg(off, ' ' order by off) as places from tok group by kmer, region")
def inverted_index(spark, sf_dir):
    rows = index.inverted_index(tables.regions(spark, sf_dir), K)
    return rows.select("kmer", "region", "n", F.concat_ws(" ", F.transform("offsets", lambda o: o.cast("string"))).alias("places"))


_MET = "select iv.chrom, iv.s, iv.e, {0} as value from iv left join sig on iv.chrom = sig.chrom and sig.s < {2} and {1} < sig.e group by 1, 2, 3"


@query("AGG-2_signal_summary", f"with {_INTERVALS} select a.chrom, a.s as start, a.e as \"end\", a.value as max, round(b.value, 6) as mean, c.value as center_max from ({_MET.format('coalesce(max(value), 0.0)', 'iv.s', 'iv.e')}) a join ({_MET.format('coalesce(avg(value), 0.0)', 'iv.s', 'iv.e')}) b using (chrom, s, e) join ({_MET.format('coalesce(max(value), 0.0)', '(iv.s + iv.e) // 2 - 300', '(iv.s + iv.e) // 2 + 300')}) c using (chrom, s, e)")
def signal_summary(spark, sf_dir):
    iv, sig = tables.intervals(spark, sf_dir), tables.signal(spark, sf_dir)
    out = signal.summarise(iv, sig, "max", bin_width=3600).withColumnRenamed("value", "max")
    for name, kind in (("mean", "mean"), ("center_max", "center_max")):
        part = signal.summarise(iv, sig, kind, window_bp=600, bin_width=3600)
        out = out.join(part.withColumnRenamed("value", name), ["chrom", "start", "end"])
    return out.withColumn("mean", F.round("mean", 6))


@query("AGG-3_unambiguous", _SNV + ", " + sql.unambiguous("variant, motif_pos") + " select variant, motif_pos, allele, count(*) as n, cast(sum(place) as bigint) as places from single group by 1, 2, 3")
def unambiguous(spark, sf_dir):
    out = local.counts(_windows(spark, sf_dir), tables.regions(spark, sf_dir), K, WINDOW, lambda: _index(spark, sf_dir), alone=True)
    return _long(out, "motif_pos")


_SETS = f"sets as (select distinct {sql.canonical('kmer')} as kmer, region from idx)"
_SEED = "ATTAAT"
_WOBBLE = (
    sql.index(K),
    _SETS,
    sql.RANKS,
    f"asked as (select p as grp, allele as base, substr('{_SEED}', 1, cast(p as integer)) || allele || substr('{_SEED}', cast(p as integer) + 2) as kmer from range({K}) t(p), {sql.ALLELES})",
    "hit as (select grp, base, region from asked join sets using (kmer))",
    "clean as (select grp, region, min(base) as base from hit group by grp, region having count(distinct base) = 1)",
    "own as (select clean.*, row_number() over (partition by grp order by rank desc) as r from clean join ranks using (region))",
    "sums as (select grp, base, count(*) as f, sum(r) as s from own group by grp, base)",
    "tot as (select *, sum(f) over (partition by grp) - f as b from sums)",
)


def _wobble_sets(spark, sf_dir):
    patterns = {(i, b): _SEED[:i] + b + _SEED[i + 1 :] for i in range(K) for b in S.BASES}
    return motif._pattern_sets(sets(spark, sf_dir), patterns, False)


@query("AGG-4_disjoint_sets", sql.with_(*_WOBBLE) + "select cast(grp as bigint) as \"group\", base, count(*) as n from clean group by grp, base")
def disjoint_sets(spark, sf_dir):
    out = ranking.disjoint(_wobble_sets(spark, sf_dir), ["group"]).groupBy("group", "base").agg(F.count("*").alias("n"))
    return _long(out, "group")


@query("AGG-5_probe_sets", sql.with_(sql.index(K), _SETS) + "select kmer, count(*) as n from sets group by kmer")
def probe_sets(spark, sf_dir):
    return sets(spark, sf_dir).groupBy("kmer").agg(F.count("*").alias("n"))


_E = "(2 * f * (n - 1) - 2 * s - f * (f - 1)) / (2 * f * (n - f)) - 0.5"


@query("AGG-6_e_score", sql.with_(sql.index(K), _SETS, sql.RANKS) + f"select kmer, f as \"F\", round({_E}, 9) as \"E\" from (select kmer, count(*) as f, sum(rank) as s, max(n_total) as n from sets join ranks using (region) group by kmer having count(*) >= 20) where f < n")
def e_score(spark, sf_dir):
    return ranking.scored(sets(spark, sf_dir), ranks(spark, sf_dir), ["kmer"], 20).select("kmer", "F", F.round("E", 9).alias("E"))


@query("AGG-7_reduced_e_score", sql.with_(*_WOBBLE) + "select cast(grp as bigint) as \"group\", base, f as \"F\", case when b > 0 then b else 0 end as \"B\", round((s - f * (f + 1) / 2) / (f * b) - 0.5, 9) as \"E_reduced\", round((s - f * (f + 1) / 2 - f * b / 2) / sqrt(f * b * (f + b + 1) / 12), 9) as z from (select grp, base, f, cast(s as bigint) as s, cast(b as bigint) as b from tot) where b > 0")
def reduced_e_score(spark, sf_dir):
    out = ranking.reduced_scores(ranking.disjoint(_wobble_sets(spark, sf_dir), ["group"]), ranks(spark, sf_dir), ["group"]).where("B > 0")
    return _long(out.withColumn("E_reduced", F.round("E_reduced", 9)).withColumn("z", F.round("z", 9)), "group")


_MWU = """, z as (select cast(grp as bigint) as "group", base, f as "F", case when b > 0 then b else 0 end as "B", case when b > 0 then (s - f * (f + 1) / 2) / (f * b) - 0.5 end as e, case when b > 0 then (s - f * (f + 1) / 2 - f * b / 2) / sqrt(f * b * (f + b + 1) / 12) end as z from (select grp, base, f, cast(s as bigint) as s, cast(b as bigint) as b from tot))"""


@query("AGG-7_mann_whitney_p", sql.with_(*_WOBBLE).rstrip() + _MWU + f' select "group", base, "F", "B", round(e, 9) as "E_reduced", round(z, 9) as z, round({sql.two_sided_normal("z")}, 9) as p from z')
def mann_whitney_p(spark, sf_dir):
    rows = ranking.reduced_scores(ranking.disjoint(_wobble_sets(spark, sf_dir), ["group"]), ranks(spark, sf_dir), ["group"])
    return _long(rows.withColumn("p", normal_p("z")).withColumns({c: F.round(c, 9) for c in ("E_reduced", "z", "p")}), "group")


def _masks(k: int, gaps: int) -> str:
    rows = [(g, m) for g in range(gaps + 1) for m in S.gap_masks(k, g)]
    return " union all ".join("select " + " || ".join(f"substr(kmer, {i + 1}, 1)" if i in m else "'.'" for i in range(k)) + f" as pattern, {g} as gaps, region from sets" for g, m in rows)


SEED_SQL = sql.with_(sql.index(4), _SETS, sql.RANKS, f"pats as ({_masks(4, 2)})", f"sc as (select pattern as kmer, gaps, count(*) as f, cast(sum(rank) as bigint) as s, max(n) as n from (select distinct pattern, gaps, region from pats) join (select region, rank, n_total as n from ranks) using (region) group by 1, 2 having count(*) >= 20)")


@query("AGG-8_choose_seed", SEED_SQL + f"select kmer, round({_E}, 9) as \"E\", f as \"F\", gaps from sc where f < n")
def choose_seed(spark, sf_dir):
    out = ranking.choose_seed(sets(spark, sf_dir, 4), ranks(spark, sf_dir), 4, min_f=20, max_gaps=2)
    return out.where("E is not null").withColumn("E", F.round("E", 9))


@query("AGG-9_mask_candidates", sql.with_(sql.REGIONS, sql.RANKS, sql.masked_tokens(MASK)) + "select code, count(*) as n from (select distinct region, code from codes) join ranks using (region) where rank < 500 group by code order by n desc, code limit 100")
def mask_candidates(spark, sf_dir):
    return motif.mask_candidates(index.masked_tokens(tables.regions(spark, sf_dir), MASK), ranks(spark, sf_dir), 500, 100)


_PATTERN = " || ".join(f"substr('ACGT', cast((code >> {2 * (MASK.count('1') - 1 - [j for j, c in enumerate(MASK) if c == '1'].index(i))}) & 3 as integer) + 1, 1)" if c == "1" else "'.'" for i, c in enumerate(MASK))


@query("AGG-10_mask_seeds", sql.with_(sql.REGIONS, sql.RANKS, sql.masked_tokens(MASK), "hits as (select code, region from codes group by code, region having count(distinct off) = 1)", "sc as (select code, count(*) as f, cast(sum(rank) as bigint) as s, max(n_total) as n from hits join ranks using (region) group by code having count(*) >= 20)") + f"select {_PATTERN} as kmer, code, round({_E}, 9) as \"E\", f as \"F\", {MASK.count('0')} as gaps from sc where f < n")
def mask_seeds(spark, sf_dir):
    regions = tables.regions(spark, sf_dir)
    hits = index.masked_hits(regions, MASK, index.masked_tokens(regions, MASK), by_strand=False)
    return motif.mask_seeds(hits, ranks(spark, sf_dir), MASK, 20).where("E is not null").withColumn("E", F.round("E", 9))


@query("AGG-11_mean_by_base", sql.with_(*_WOBBLE) + ", e as (select grp, base, cast(s - f * (f + 1) / 2 as double) / (f * b) - 0.5 as e from (select grp, base, f, cast(s as bigint) as s, cast(b as bigint) as b from tot) where b > 0) select cast(grp as bigint) as \"group\", " + ", ".join(f"round(avg(e) filter (base = '{b}'), 9) as \"{b}\"" for b in "ACGT") + " from e group by grp")
def mean_by_base(spark, sf_dir):
    rows = ranking.reduced_scores(ranking.disjoint(_wobble_sets(spark, sf_dir), ["group"]), ranks(spark, sf_dir), ["group"]).where("B > 0")
    out = rows.groupBy("group").pivot("base", list(S.BASES)).agg(F.avg("E_reduced"))
    return _long(out.select("group", *[F.round(b, 9).alias(b) for b in S.BASES]), "group")


@query("AGG-12_histogram", "with b as (select min(value) as lo, max(value) as hi from events) select cast(least(floor((value - lo) / ((hi - lo) / 60)), 59) as integer) as bin, count(*) as n from events, b where value is not null group by 1")
def histogram(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events").where("value is not null")
    ends = rows.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 60)), F.lit(59)).cast("int")
    return rows.join(F.broadcast(ends), F.lit(True)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


@query("AGG-13_quantile_bins", "with q as (select " + ", ".join(f"quantile_cont(l_extendedprice, {i / 20}) as q{i}" for i in range(1, 20)) + " from lineitem) select " + " + ".join(f"cast(l_extendedprice > q{i} as integer)" for i in range(1, 20)) + " as bin, round(avg(l_extendedprice), 4) as mean_x, round(avg(l_discount), 6) as mean_y, count(*) as n from lineitem, q group by 1")
def quantile_bins(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem")
    cuts = rows.agg(F.percentile("l_extendedprice", F.array(*[F.lit(i / 20) for i in range(1, 20)])).alias("q"))
    at = F.size(F.filter("q", lambda x: x < F.col("l_extendedprice")))
    return rows.join(F.broadcast(cuts), F.lit(True)).groupBy(at.alias("bin")).agg(F.round(F.avg("l_extendedprice"), 4).alias("mean_x"), F.round(F.avg("l_discount"), 6).alias("mean_y"), F.count("*").alias("n"))


_FAM_DESIGN = (*_FAMILY_ALL, sql.unambiguous("fam"))


def family_design(spark, sf_dir, asked=None):
    """Design rows of all families, or of those asked for."""
    idx = _index(spark, sf_dir).persist()
    found = calibrate.family_matches(calibrate.families(idx, K) if asked is None else asked, idx, K)
    value = tables.intensity(spark, sf_dir).select("region", F.log1p("value").alias("value"))
    single = matching.unambiguous(found, ["family"]).join(value, "region")
    size = S.region_length("region")
    return single.select("family", "region", "allele", "place", F.col("value").alias("y"), S.folded_place(F.col("place"), size).alias("lp"), size.cast("double").alias("sl"))


@query("AGG-14_reference_allele", sql.with_(*_FAM_DESIGN) + "select fam as family, allele as ref from (select fam, allele, row_number() over (partition by fam order by count(*) desc, allele) as at_ from single group by fam, allele) where at_ = 1")
def reference_allele(spark, sf_dir):
    return calibrate.reference_allele(family_design(spark, sf_dir), ["family"])


@query("AGG-15_minor_fraction", sql.with_(*_FAM_DESIGN) + ", c as (select fam, allele, count(*) as n from single group by 1, 2) select fam as family, cast(sum(n) as bigint) as n_probes, count(*) as n_alleles, " + ", ".join(f"cast(coalesce(sum(n) filter (allele = '{b}'), 0) as bigint) as \"n_{b}\"" for b in "ACGT") + ", case when count(*) > 1 then round(min(n) / sum(n), 9) end as minor_allele_fraction from c group by fam")
def minor_fraction(spark, sf_dir):
    return calibrate.minor_fraction(family_design(spark, sf_dir), ["family"]).withColumn("minor_allele_fraction", F.round("minor_allele_fraction", 9))


@query("AGG-16_cap_curves")
def cap_curves(spark, sf_dir):
    """Every family of two alleles at least, at each cap that it reaches; seeded draws have no SQL twin."""
    regions = tables.sequences(spark, sf_dir).select("region", "seq", F.log1p("value").alias("y"))
    return capped.curves(regions, calibrate.every_family(K), K, [20, 40], repeats=10)


_CURVE = "select l_orderkey as family, cast(10 * (1 + l_linenumber % 3) as integer) as cap_probes, l_discount as sd, l_tax as bias from lineitem"


@query("AGG-17_cap_summary", f"with c as ({_CURVE}), a as (select o_orderkey as family, o_orderkey % 45 as n from orders), t as (select count(*) as total, count(*) filter (n >= 10) as e10, count(*) filter (n >= 20) as e20, count(*) filter (n >= 30) as e30 from a) select cap_probes, total as n_families_total, case cap_probes when 10 then e10 when 20 then e20 else e30 end as n_families_eligible, n as n_families_evaluated, round(case cap_probes when 10 then e10 when 20 then e20 else e30 end / total, 9) as eligible_fraction, round(sd90, 9) as effect_sd_norm_p90, round(b90, 9) as effect_bias_norm_p90 from (select cap_probes, count(*) as n, quantile_cont(sd, 0.9) as sd90, quantile_cont(bias, 0.9) as b90 from c group by 1), t")
def cap_summary(spark, sf_dir):
    return _summary(spark, sf_dir).select("cap_probes", "n_families_total", "n_families_eligible", "n_families_evaluated", *[F.round(c, 9).alias(c) for c in ("eligible_fraction", "effect_sd_norm_p90", "effect_bias_norm_p90")])


def _summary(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("family"), (10 * (1 + F.col("l_linenumber") % 3)).cast("int").alias("cap_probes"), F.col("l_discount").alias("effect_sd_norm"), F.col("l_tax").alias("effect_bias_norm"))
    rows = rows.withColumns({c: F.lit(0.0) for c in ("effect_rmse_norm", "neglog10p_median", "n_probes_kept_median")})
    available = tables.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 45).alias("n_probes_available"))
    return calibrate.cap_summary(rows, available, [10, 20, 30])


@query("AGG-17_cap_recommendation", f"with c as ({_CURVE}), a as (select o_orderkey % 45 as n from orders), s as (select cap_probes, quantile_cont(sd, 0.9) as sd, quantile_cont(bias, 0.9) as bias, (select count(*) filter (n >= cap_probes) / count(*) from a) as share from c group by 1), ok as (select *, lag(cap_probes) over (order by cap_probes) as prev from s where true), good as (select * from ok where share >= 0.5 and sd <= 0.095 and bias <= 0.08) select (select min(cap_probes) from good) as recommended_max_probes, (select prev from good order by cap_probes limit 1) as previous_tested_cap, case when count(*) = 0 then 'NO_TESTED_CAP_MET_STABILITY_CRITERIA' else 'RECOMMENDED' end as status from good")
def cap_recommendation(spark, sf_dir):
    return calibrate.recommend_cap(_summary(spark, sf_dir), 0.095, 0.08).select("recommended_max_probes", "previous_tested_cap", "status")


@query("AGG-18_effect_quartiles", "with r as (select l_orderkey as family, l_linenumber as contrast, max(l_tax * l_quantity) as v, max(l_discount) as y from lineitem group by 1, 2), q as (select quantile_cont(v, 0.25) as a, quantile_cont(v, 0.5) as b, quantile_cont(v, 0.75) as c from r) select case when v <= a then 'Q1 smallest' when v <= b then 'Q2' when v <= c then 'Q3' else 'Q4 largest' end as effect_quartile, 10 as cap_probes, count(*) as n_contrasts, round(quantile_cont(y, 0.5), 9) as neglog10p_median, round(quantile_cont(v, 0.5), 9) as full_effect_abs_norm_median from r, q group by 1")
def effect_quartiles(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("family"), F.col("l_linenumber").alias("contrast")).agg(F.max(F.col("l_tax") * F.col("l_quantity")).alias("full_effect_abs_norm"), F.max("l_discount").alias("sample_neglog10p_median")).withColumn("cap_probes", F.lit(10))
    out = calibrate.quartile_summary(rows)
    return out.select("effect_quartile", "cap_probes", "n_contrasts", F.round("neglog10p_median", 9).alias("neglog10p_median"), F.round("full_effect_abs_norm_median", 9).alias("full_effect_abs_norm_median"))


@query("AGG-19_mask_ranking", "select mask, row_number() over (order by sd, resid, -share, mask) as stability_rank from (select cast(l_suppkey as varchar) as mask, round(avg(l_discount), 6) as sd, round(avg(l_tax), 6) as resid, count(*) as share from lineitem group by 1)")
def mask_ranking(spark, sf_dir):
    rows = supplier_means(spark, sf_dir).select(F.col("l_suppkey").cast("string").alias("mask"), "l_discount", "l_tax", "n")
    return _long(rows.select("mask", F.row_number().over(W.orderBy(F.asc_nulls_last("l_discount"), F.asc_nulls_last("l_tax"), F.desc("n"), F.asc_nulls_last("mask"))).alias("stability_rank")), "stability_rank")


def supplier_means(spark, sf_dir):
    """l_suppkey, n, l_discount, l_tax: means at 6 places, exact at a tie, as the sums of SQL on several threads mostly are."""
    return ranking.exact_means(tables.table(spark, sf_dir, "lineitem"), "l_suppkey", ["l_discount", "l_tax"])


@query("AGG-20_outlier_influence", "select l_returnflag, count(*) as n_probes, count(*) filter (l_linestatus = 'F') as n_allele, round((max(l_extendedprice) filter (l_linestatus = 'F') - quantile_cont(l_extendedprice, 0.5) filter (l_linestatus <> 'F')) / (quantile_cont(l_extendedprice, 0.75) filter (l_linestatus <> 'F') - quantile_cont(l_extendedprice, 0.25) filter (l_linestatus <> 'F') + 1e-6), 3) as influence from lineitem group by l_returnflag")
def outlier_influence(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem")
    own, other = (F.when(c, F.col("l_extendedprice")) for c in (F.col("l_linestatus") == "F", F.col("l_linestatus") != "F"))
    q = F.percentile(other, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy("l_returnflag").agg(F.count("*").alias("n_probes"), F.count(own).alias("n_allele"), F.max(own).alias("top"), q.alias("q"))
    return out.select("l_returnflag", "n_probes", "n_allele", F.round((F.col("top") - F.col("q")[1]) / (F.col("q")[2] - F.col("q")[0] + 1e-6), 3).alias("influence"))


@query("AGG-22_ols", "select l_returnflag, 'l_quantity' as term, round(regr_slope(l_extendedprice, l_quantity), 4) as coef, count(*) as n from lineitem group by 1 union all select l_returnflag, 'const', round(regr_intercept(l_extendedprice, l_quantity), 4), count(*) from lineitem group by 1")
def ols(spark, sf_dir):
    out = fits.ols(tables.table(spark, sf_dir, "lineitem"), ["l_returnflag"], {"l_quantity": F.col("l_quantity")}, F.col("l_extendedprice"))
    return out.select("l_returnflag", "term", F.round("coef", 4).alias("coef"), "n")


@query("AGG-23_negative_binomial")
def negative_binomial(spark, sf_dir):
    """Iterated fits have no SQL twin; tests hold them against the score equations."""
    rows = tables.table(spark, sf_dir, "events").where("value is not null").select("event_type", F.abs("value").alias("y"), (F.col("user_id") % 5).cast("double").alias("lp"))
    return fits.negative_binomial(rows, ["event_type"], ["lp"], "y")


_POOLED = "select \"position\", allele, round(effect, 6) as effect, round(" + sql.two_sided_t("t", "gdf") + ", 6) as pval from pooled"


@query("AGG-24_pooled", "with rows as (select l_returnflag as \"position\", ['A', 'C', 'G', 'T'][l_linenumber % 4 + 1] as allele, 'A' as ref, l_linestatus as \"window\", cast(l_suppkey as varchar) as region, l_quantity as y, l_discount as lp, l_tax as sl from lineitem), " + sql.pooled("rows", '"position"') + " " + _POOLED)
def pooled(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("position"), F.element_at(F.array(*map(F.lit, S.BASES)), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("allele"), F.lit("A").alias("ref"), F.col("l_linestatus").alias("window"), F.col("l_suppkey").cast("string").alias("region"), F.col("l_quantity").alias("y"), F.col("l_discount").alias("lp"), F.col("l_tax").alias("sl"))
    return shown_pooled(fits.pooled(rows, ["position"]))


def shown_pooled(rows):
    return rows.withColumns({c: F.round(finite(c), 6) for c in ("effect", "pval")})


_HOT = [f"{b.lower()}_" for b in S.BASES]
_LENGTH = "cast(greatest(1, cast(split_part(region, '-', 2) as bigint)) as double)"
_PAIRS = " union all ".join(f"select family, '{a}-{b}' as contrast, n, m[{i}][7] - m[{j}][7] as e, m[{i}][{i}] + m[{j}][{j}] - m[{i}][{j}] - m[{j}][{i}] as v, m[7][7] as rss, df, y_sd from swept where have[{i}] and have[{j}]" for i, a in enumerate(S.BASES, 1) for j, b in enumerate(S.BASES, 1) if i < j)
_CONTRASTS = sql.with_(
    *_FAM_DESIGN,
    f"d as (select fam as family, region, allele, ln(1 + regions.value) as y, case when place / {_LENGTH} > 0.5 then 1 - place / {_LENGTH} else place / {_LENGTH} end as lp, {_LENGTH} as sl from single join regions using (region))",
    "r as (select family, allele as ref from (select family, allele, row_number() over (partition by family order by count(*) desc, allele) as at_ from d group by family, allele) where at_ = 1)",
    "rows as (select d.*, " + ", ".join(f"cast(allele = '{b}' and ref <> '{b}' as double) as {b.lower()}_" for b in S.BASES) + " from d join r using (family))",
    sql.least_squares("rows", "family", [*_HOT, "lp", "sl"], "y", "count(*) >= 30 and count(distinct allele) > 1", ", stddev_pop(y) as y_sd, [" + ", ".join(f"count(*) filter (allele = '{b}') > 0" for b in S.BASES) + "] as have"),
    f"pairs as (select *, e / sqrt(rss / df * v) as t from ({_PAIRS}))",
)


@query("AGG-25_contrasts", _CONTRASTS + f"select family, contrast, cast(n as bigint) as n_probes_available, round(e, 6) as full_effect, round(abs(e) / y_sd, 6) as full_effect_abs_norm, round(-log10({sql.two_sided_t('t', 'df')}), 6) + 0 as full_neglog10p, round(y_sd, 6) as y_sd, round(sqrt(rss / n) / y_sd, 6) as residual_sd_ratio from pairs")
def contrasts(spark, sf_dir):
    """Fits of sums that are added where a region is: no row of a design is made."""
    regions = tables.sequences(spark, sf_dir).select("region", "seq", F.log1p("value").alias("y"))
    out = capped.full_effects(regions, calibrate.every_family(K), K, doubles=True)
    return out.withColumns({c: F.round(c, 6) for c in ("full_effect", "full_effect_abs_norm", "full_neglog10p", "y_sd", "residual_sd_ratio")})


@query("AGG-26_payload_summary", "select event_type, count(*) as n, min(value) as y_min, max(value) as y_max, round(avg(value), 6) as y_mean, max(cast(value is null or not isfinite(value) as integer)) as has_missing, cast(sum(cast(value = 0 as integer)) = count(*) as boolean) as all_zero from events group by event_type")
def payload_summary(spark, sf_dir):
    v = finite("value")
    return tables.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min(v).alias("y_min"), F.max(v).alias("y_max"), F.round(F.avg(v), 6).alias("y_mean"), F.max(v.isNull().cast("int")).alias("has_missing"), (F.sum((F.col("value") == 0).cast("int")) == F.count("*")).alias("all_zero"))


@query("AGG-27_mask_counters", sql.with_(sql.REGIONS, sql.masked_tokens(MASK), "h as (select code, region, count(distinct (off, is_reverse)) as n from codes group by 1, 2)") + f"select (select count(*) from regions) as regions, (select count(*) from regions where length(seq) >= {len(MASK)}) as valid_regions, (select count(*) from tok) as windows, count(*) filter (n = 1) as hits, count(*) filter (n > 1) as ambiguous from h")
def mask_counters(spark, sf_dir):
    regions = tables.regions(spark, sf_dir)
    tokens = index.masked_tokens(regions, MASK)
    sizes = regions.agg(F.count("*").alias("regions"), F.sum((F.length("seq") >= len(MASK)).cast("long")).alias("valid_regions"), F.sum(F.greatest(F.length("seq") - (len(MASK) - 1), F.lit(0))).alias("windows"))
    hits = tokens.groupBy("code", "region").agg(F.count_distinct("offset", "is_reverse").alias("n")).agg(F.sum((F.col("n") == 1).cast("long")).alias("hits"), F.sum((F.col("n") > 1).cast("long")).alias("ambiguous"))
    return sizes.join(hits, F.lit(True))
