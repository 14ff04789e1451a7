"""Scalar functions, filters and readers over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.register import register
from ..functions.stats import scientific
from ..operators import index, signal
from ..operators import selection
from ..sources import formats, tables
from . import sql
from .registry import query

K, MASK = 6, "1101011"


def _lines(spark: SparkSession, sf_dir: str, text) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), text.alias("line"))


def _doc(suffix: str = "") -> object:
    return F.concat(F.lit("doc"), F.col("doc_id"), F.lit(suffix))


@query("SRC-1_bed", "select doc_id as ord, 'doc' || doc_id as chrom, cast(0 as bigint) as start, n_chars as \"end\" from documents where n_chars is not null")
def bed(spark, sf_dir):
    text = F.concat_ws(" \t", _doc(), F.lit("0"), F.col("n_chars").cast("string"), F.lit("x"))
    return formats.bed(_lines(spark, sf_dir, F.when(F.col("n_chars").isNotNull(), text).otherwise(F.lit("# none"))))


@query(
    "SRC-2_bed_once",
    "select min(doc_id) as ord, source as chrom, cast(0 as bigint) as start, n_chars % 50 as \"end\" from documents group by source, n_chars % 50",
)
def bed_once(spark, sf_dir):
    text = F.concat_ws("\t", "source", F.lit("0"), (F.col("n_chars") % 50).cast("string"), F.col("doc_id").cast("string"))
    return formats.bed_once(_lines(spark, sf_dir, text)).select("ord", "chrom", "start", "end")


@query("SRC-4_intensities", "select source || ':0-9' as region, cast(max_by(n_chars, doc_id) as double) as value, min(doc_id) as ord from documents where n_chars % 7 <> 0 group by source")
def read_intensities(spark, sf_dir):
    value = F.when(F.col("n_chars") % 7 == 0, F.lit("none")).otherwise(F.col("n_chars").cast("string"))
    return formats.intensities(_lines(spark, sf_dir, F.concat(F.col("source"), F.lit(":0-9  "), value)))


@query("SRC-5_wide_intensities", "select case when doc_id % 2 = 0 then source || ':0-9' else source || ':3-8' end as region, cast(max_by(n_chars, doc_id) as double) as value, min(doc_id) as ord from documents where doc_id % 5 <> 0 group by 1")
def read_wide_intensities(spark, sf_dir):
    n = F.col("n_chars").cast("string")
    line = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("# "), n)).when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit(":0-9\t"), n)).otherwise(F.concat_ws("\t", "source", F.lit("3"), F.lit("8"), n))
    return formats.wide_intensities(_lines(spark, sf_dir, line))


_ARRAY_TEXT = sql.with_(sql.index(K))


@query("SRC-6_kmer_array", _ARRAY_TEXT + "select kmer, region, cast(off as integer) as \"offset\" from idx")
def read_array(spark, sf_dir):
    regions = tables.regions(spark, sf_dir)
    text = index.index_text(index.inverted_index(regions, K), regions)
    return formats.kmer_array(text.select(F.lit(0).cast("long").alias("ord"), F.concat("kmer", F.lit("\t"), "entries").alias("line")))


@query("SRC-7_kmer_array_strict", _ARRAY_TEXT + "select kmer, count(*) as n, cast(sum(off) as bigint) as places from idx group by kmer")
def read_array_strict(spark, sf_dir):
    regions = tables.regions(spark, sf_dir)
    text = index.index_text(index.inverted_index(regions, K), regions)
    rows = formats.kmer_array(text.select(F.lit(0).cast("long").alias("ord"), F.concat("kmer", F.lit("\t"), "entries").alias("line")), strict=True)
    return rows.groupBy("kmer").agg(F.count("*").alias("n"), F.sum("offset").alias("places"))


@query("SRC-9_bedgraph", "select event_type as chrom, event_id as start, event_id + 1 as \"end\", case when event_id % 9 = 0 then 0.0 else value end as value from events where value is not null")
def read_bedgraph(spark, sf_dir):
    value = F.when(F.col("event_id") % 9 == 0, F.lit(".")).otherwise(F.col("value").cast("string"))
    line = F.concat_ws("\t", "event_type", F.col("event_id").cast("string"), (F.col("event_id") + 1).cast("string"), value)
    rows = tables.table(spark, sf_dir, "events").where("value is not null").select(F.col("event_id").alias("ord"), line.alias("line"))
    return formats.bedgraph(rows)


@query("SRC-10_variant_list", "select doc_id as ord, 'doc' || doc_id || ':' || n_chars || ':A>C' as variant from documents where doc_id % 4 <> 0")
def variant_list(spark, sf_dir):
    line = F.when(F.col("doc_id") % 4 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  "), _doc(":"), F.col("n_chars"), F.lit(":A>C ")))
    return formats.variant_list(_lines(spark, sf_dir, line))


@query("SRC-11_masks", "select * from (values (0, '1101'), (1, '111'), (2, '10101')) t(ord, mask)")
def mask_list(spark, sf_dir):
    masks = formats.parse_masks("1101, 111 # comment\n10101\t1101\n# 11\n")
    return spark.createDataFrame(list(enumerate(masks)), "ord int, mask string")


@query("SRC-14_openness", "select 'chr' || source || ':' || doc_id || '-' || (doc_id + 9) as region, cast(n_chars as double) as open from documents where n_chars is not null")
def openness(spark, sf_dir):
    line = F.concat_ws("\t", F.concat(F.lit("chr"), "source"), F.col("doc_id").cast("string"), (F.col("doc_id") + 9).cast("string"), F.lit("name"), F.col("n_chars").cast("string"), F.lit("x"))
    return formats.openness(formats.bed_once(_lines(spark, sf_dir, line)))[0]


@query("SNK-1_array_text", sql.with_(sql.REGIONS, sql.tokens(4)) + "select kmer, string_agg(entry, ',' order by ord) as entries from (select kmer, ord, region || ';' || count(*) || ';' || string_agg(off, ' ' order by off) as entry from tok group by kmer, ord, region) group by kmer")
def array_text(spark, sf_dir):
    regions = tables.regions(spark, sf_dir)
    return index.index_text(index.inverted_index(regions, 4), regions)


@query("SNK-7_p_text", "select doc_id, case when n_chars = 0 then 'NA' else printf('%.3e', 1.0 / n_chars) end as shown from documents")
def p_text(spark, sf_dir):
    p = 1.0 / F.nullif("n_chars", F.lit(0))  # a Python function is given all rows, whatever branch it stands in
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") == 0, F.lit("NA")).otherwise(scientific(p, 3)).alias("shown"))


@query("SNK-13_missing_kmers", sql.with_(sql.REGIONS, sql.tokens(K)) + f"select kmer from (select string_agg(substr('ACGT', cast((i >> (2 * d)) & 3 as integer) + 1, 1), '' order by d desc) as kmer from range({4**K}) t(i), range({K}) u(d) group by i) where kmer not in (select kmer from tok)")
def missing(spark, sf_dir):
    return index.missing_kmers(index.inverted_index(tables.regions(spark, sf_dir), K), K)


@query("STR-1_reverse_complement", sql.with_(sql.REGIONS) + f"select region, {sql.rc('seq')} as rc from regions")
def reverse_complement(spark, sf_dir):
    return tables.regions(spark, sf_dir).select("region", S.reverse_complement("seq").alias("rc"))


@query("STR-2_canonical", sql.with_(sql.REGIONS, sql.tokens(K)) + f"select {sql.canonical('kmer')} as kmer, count(*) as n from tok group by 1")
def canonical(spark, sf_dir):
    return index.tokens(tables.regions(spark, sf_dir), K).groupBy(S.canonical("kmer").alias("kmer")).agg(F.count("*").alias("n"))


@query("STR-3_tokens", sql.with_(sql.REGIONS, sql.tokens(K)) + "select kmer, count(*) as n, cast(sum(off) as bigint) as places, count(distinct region) as regions from tok group by kmer")
def tokens(spark, sf_dir):
    rows = index.tokens(tables.regions(spark, sf_dir), K)
    return rows.groupBy("kmer").agg(F.count("*").alias("n"), F.sum("offset").alias("places"), F.count_distinct("region").alias("regions"))


@query("STR-4_wildcards", sql.with_(sql.REGIONS, sql.tokens(K)) + f"select substr(kmer, 1, cast(j as integer)) || '.' || substr(kmer, cast(j as integer) + 2) as pattern, count(*) as n from tok, range({K}) t(j) group by 1")
def wildcards(spark, sf_dir):
    kmers = index.tokens(tables.regions(spark, sf_dir), K).groupBy("kmer").agg(F.count("*").alias("n"))
    patterns = F.explode(F.array(*[S.replaced("kmer", j, ".") for j in range(K)]))
    return kmers.select(patterns.alias("pattern"), "n").groupBy("pattern").agg(F.sum("n").alias("n"))


@query("STR-5_pattern_lookup", sql.with_(sql.index(K)) + "select region, min(off) as \"offset\", count(*) as n from idx where regexp_full_match(kmer, 'A.T..A') group by region")
def pattern_lookup(spark, sf_dir):
    rows = index.unique_index(tables.regions(spark, sf_dir), K).where(F.col("kmer").rlike("^A.T..A$"))
    return rows.groupBy("region").agg(F.min("offset").cast("long").alias("offset"), F.count("*").alias("n"))


@query("STR-7_signatures", sql.with_(sql.REGIONS, sql.masked_tokens(MASK)) + "select code, is_reverse, count(*) as n, cast(sum(off) as bigint) as places from codes group by code, is_reverse")
def signatures(spark, sf_dir):
    rows = index.masked_tokens(tables.regions(spark, sf_dir), MASK)
    return rows.groupBy("code", "is_reverse").agg(F.count("*").alias("n"), F.sum("offset").alias("places"))


@query("STR-8_signature_patterns", sql.with_(sql.REGIONS, sql.tokens(len(MASK))) + "select distinct " + " || ".join(f"substr(kmer, {i + 1}, 1)" if c == "1" else "'.'" for i, c in enumerate(MASK)) + f" as pattern, {sql.signature('kmer', MASK)} as code from tok")
def signature_patterns(spark, sf_dir):
    codes = index.masked_tokens(tables.regions(spark, sf_dir), MASK).where("not is_reverse").select("code").distinct()
    return codes.select(S.signature_pattern("code", MASK).alias("pattern"), "code")


@query("STR-9_masked_display", sql.with_(sql.variants(len(MASK))) + "select variant, motif_pos, " + " || ".join(f"case when j = {i} then '.' else substr(kmer, {i + 1}, 1) end" if c == "1" else "'x'" for i, c in enumerate(MASK)) + " as shown, " + " || ".join(f"case when j = {i} then alt else substr(kmer, {i + 1}, 1) end" if c == "1" else "'x'" for i, c in enumerate(MASK)) + " as filled from windows")
def masked_display(spark, sf_dir):
    from ..operators.matching import variant_windows

    rows = variant_windows(tables.variants(spark, sf_dir, len(MASK)), len(MASK))
    return rows.select("variant", F.col("motif_pos").cast("long").alias("motif_pos"), S.masked_display("kmer", MASK, F.col("j")).alias("shown"), S.masked_display("kmer", MASK, F.col("j"), F.col("alt")).alias("filled"))


@query("STR-10_region_parts", sql.with_(sql.REGIONS) + "select region, 'doc' || ord as chrom, cast(0 as bigint) as start, length(seq) as \"end\" from regions")
def region_parts(spark, sf_dir):
    return tables.regions(spark, sf_dir).select("region", *[S.region_part("region", p).alias(p) for p in ("chrom", "start", "end")])


@query("STR-11_variant_parts", sql.with_(sql.variants(K)) + "select variant, split_part(variant, ':', 1) as chrom, cast(split_part(variant, ':', 2) as bigint) as pos, ref, alt from variants")
def variant_parts(spark, sf_dir):
    parts = S.parse_variant("variant")
    return tables.variants(spark, sf_dir, K).select("variant", *[c.alias(n) for n, c in parts.items()])


_COUNTS = "length(regexp_replace(seq, '[^{0}]', '', 'g'))"


@query("NUM-1_gc_fraction", sql.with_(sql.REGIONS) + "select region, case when length(seq) > 0 then round(length(regexp_replace(seq, '[AT]', '', 'g')) / length(seq), 9) else 0.0 end as gc from regions")
def gc_fraction(spark, sf_dir):
    return tables.regions(spark, sf_dir).select("region", F.round(S.gc_fraction("seq"), 9).alias("gc"))


_C, _G = "length(regexp_replace(seq, '[^C]', '', 'g'))", "length(regexp_replace(seq, '[^G]', '', 'g'))"
CPG = f"case when {_C} > 0 and {_G} > 0 then (length(seq) - length(replace(seq, 'CG', ''))) // 2 * length(seq) / ({_C} * {_G}) else 0.0 end"


@query("NUM-2_cpg_observed_expected", sql.with_(sql.REGIONS) + f"select region, round({CPG}, 9) as cpg_oe from regions")
def cpg(spark, sf_dir):
    return tables.regions(spark, sf_dir).select("region", F.round(S.cpg_observed_expected("seq"), 9).alias("cpg_oe"))


@query("NUM-3_region_length", sql.with_(sql.REGIONS) + "select region, greatest(1, length(seq)) as size from regions")
def region_size(spark, sf_dir):
    return tables.regions(spark, sf_dir).select("region", S.region_length("region").alias("size"))


@query("NUM-4_folded_place", sql.with_(sql.index(K)) + "select region, round(sum(case when off / length > 0.5 then 1 - off / length else off / length end), 6) as places from (select region, off, greatest(1, cast(split_part(region, '-', 2) as bigint)) as length from idx) group by region")
def folded_place(spark, sf_dir):
    rows = index.unique_index(tables.regions(spark, sf_dir), K).select("region", S.folded_place(F.col("offset"), S.region_length("region")).alias("lp"))
    return rows.groupBy("region").agg(F.round(F.sum("lp"), 6).alias("places"))


@query("NUM-5_wildcard_place", sql.with_(sql.index(K)) + f"select j, cast(sum(off + j) as bigint) as forward, cast(sum(off + {K - 1} - j) as bigint) as reverse from idx, range({K}) t(j) group by j")
def wildcard_place(spark, sf_dir):
    rows = index.unique_index(tables.regions(spark, sf_dir), K).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(K - 1).cast("long"))))
    return rows.groupBy("j").agg(F.sum(S.wildcard_place(F.col("offset"), F.col("j"), K, F.lit(False))).alias("forward"), F.sum(S.wildcard_place(F.col("offset"), F.col("j"), K, F.lit(True))).alias("reverse"))


@query("NUM-6_winsorize", "select doc_id, round(least(n_chars, (select quantile_cont(n_chars, 0.99) from documents)), 6) as value from documents where n_chars is not null")
def winsorize(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").where("n_chars is not null")
    high = docs.agg(F.percentile("n_chars", F.lit(0.99)).alias("high"))
    return docs.join(F.broadcast(high), F.lit(True)).select("doc_id", F.round(F.least(F.col("n_chars").cast("double"), "high"), 6).alias("value"))


@query("NUM-7_z_scores", "select l_orderkey, l_linenumber, case when s > 0 then round((l_quantity - m) / s, 6) else 0.0 end as z from (select l_orderkey, l_linenumber, l_quantity, m, s from lineitem join (select l_returnflag as f, avg(l_quantity) as m, stddev_pop(l_quantity) as s from lineitem group by 1) on l_returnflag = f)")
def z_scores(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem")
    stats = rows.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    return rows.join(F.broadcast(stats), "l_returnflag").select("l_orderkey", "l_linenumber", F.when(F.col("s") > 0, F.round((F.col("l_quantity") - F.col("m")) / F.col("s"), 6)).otherwise(0.0).alias("z"))


@query("NUM-8_softmax", "select o_orderkey, l_linenumber, round(exp(10 * (l_discount - m)) / sum(exp(10 * (l_discount - m))) over (partition by o_orderkey), 9) as p from (select l_orderkey as o_orderkey, l_linenumber, l_discount, max(l_discount) over (partition by l_orderkey) as m from lineitem)")
def softmax(spark, sf_dir):
    by = W.partitionBy("o_orderkey")
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_discount")
    w = F.exp(10 * (F.col("l_discount") - F.max("l_discount").over(by)))
    return rows.withColumn("w", w).select("o_orderkey", "l_linenumber", F.round(F.col("w") / F.sum("w").over(by), 9).alias("p"))


_BASE_COUNTS = sql.with_(sql.REGIONS) + "select region, n, a / n as pa, c / n as pc, g / n as pg, t / n as pt from (select region, length(seq) as n, " + ", ".join(f"greatest(length(regexp_replace(seq, '[^{b}]', '', 'g')), 1e-12) as {b.lower()}" for b in "ACGT") + " from regions where length(seq) > 0)"


@query("NUM-9_information", f"select region, round(1 + (pa * ln(pa) + pc * ln(pc) + pg * ln(pg) + pt * ln(pt)) / ln(4), 6) as ic, round(2 + pa * log2(pa) + pc * log2(pc) + pg * log2(pg) + pt * log2(pt), 6) as bits from ({_BASE_COUNTS})")
def information(spark, sf_dir):
    rows = tables.regions(spark, sf_dir).where("length(seq) > 0")
    p = [F.greatest(F.regexp_count("seq", F.lit(b)).cast("double"), F.lit(1e-12)) / F.length("seq") for b in S.BASES]
    h = sum((x * F.log(x) for x in p[1:]), p[0] * F.log(p[0]))
    return rows.select("region", F.round(1 + h / math.log(4), 6).alias("ic"), F.round(2 + h / math.log(2), 6).alias("bits"))


_PPM = {0: (0.7, 0.1, 0.1, 0.1), 1: (0.1, 0.2, 0.3, 0.4), 2: (0.25, 0.25, 0.25, 0.25), 3: (0.05, 0.05, 0.8, 0.1)}


@query("NUM-10_motif_logscore", sql.with_(sql.REGIONS, sql.tokens(4)) + "select distinct kmer, round(" + " + ".join("case substr(kmer, {0}, 1) ".format(i + 1) + " ".join(f"when '{b}' then ln({p})" for b, p in zip("ACGT", row)) + " end" for i, row in _PPM.items()) + ", 6) as score from tok")
def motif_logscore(spark, sf_dir):
    rows = index.tokens(tables.regions(spark, sf_dir), 4).select("kmer").distinct()
    ppm = F.array(*[F.array(*[F.lit(math.log(max(p, 1e-12))) for p in row]) for row in _PPM.values()])
    parts = [F.element_at(ppm[i], F.instr(F.lit("ACGT"), F.substring("kmer", i + 1, 1))) for i in range(4)]
    return rows.select("kmer", F.round(parts[0] + parts[1] + parts[2] + parts[3], 6).alias("score"))


@query("NUM-11_center_window", "select doc_id, greatest(0, n_chars // 2 - 50) as start, greatest(greatest(0, n_chars // 2 - 50) + 1, n_chars // 2 + 50) as \"end\", greatest(0, least(n_chars // 2 - 50, 400)) as c_start, greatest(0, least(n_chars // 2 + 50, 400)) as c_end from documents")
def center_window(spark, sf_dir):
    n = F.col("n_chars")
    (s, e), (cs, ce) = signal.center_window(F.lit(0), n, 100), signal.center_window(F.lit(0), n, 100, F.lit(400))
    return tables.table(spark, sf_dir, "documents").select("doc_id", s.alias("start"), e.alias("end"), cs.cast("long").alias("c_start"), ce.cast("long").alias("c_end"))


@query("NUM-12_log1p", "select o_orderkey, round(ln(1 + greatest(o_totalprice - 50000, 0)), 9) as logged, round(exp(ln(1 + greatest(o_totalprice - 50000, 0)) / 10) - 1, 9) as back from orders")
def log1p(spark, sf_dir):
    y = F.log1p(F.greatest(F.col("o_totalprice") - 50000, F.lit(0.0)))
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", F.round(y, 9).alias("logged"), F.round(F.expm1(y / 10), 9).alias("back"))


@query("NUM-13_half_even", "select doc_id, round_even(n_chars / 2.0, 0) as half, round_even(-n_chars / 2.0, 0) as minus from documents")
def half_even(spark, sf_dir):
    n = F.col("n_chars")
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.rint(n / 2.0).alias("half"), (F.rint(-n / 2.0) + 0.0).alias("minus"))


@query("NUM-14_md5_prefix", "select doc_id, cast('0x' || substr(md5(coalesce(text, '')), 1, 8) as bigint) as h from documents")
def md5_prefix(spark, sf_dir):
    h = F.conv(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    return tables.table(spark, sf_dir, "documents").select("doc_id", h.alias("h"))


@query("NUM-15_tolerant_number", "select doc_id, try_cast(coalesce(case when doc_id % 3 = 0 then 'NA' else cast(n_chars as varchar) end) as double) as value from documents")
def tolerant_number(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.lit("NA")).otherwise(F.col("n_chars").cast("string"))
    return tables.table(spark, sf_dir, "documents").select("doc_id", selection.finite(text.try_cast("double")).alias("value"))


@query("NUM-16_quantiles", "select l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) as median, round(quantile_cont(l_extendedprice, 0.9), 6) as p90 from lineitem where l_discount > 0 group by l_returnflag")
def quantiles(spark, sf_dir):
    x = F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).otherwise(F.lit(float("nan")))
    rows = tables.table(spark, sf_dir, "lineitem").select("l_returnflag", selection.finite(x).alias("x"))
    return rows.groupBy("l_returnflag").agg(F.round(F.percentile("x", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("x", F.lit(0.9)), 6).alias("p90"))


@query("NUM-17_one_hot", "select l_orderkey, l_linenumber, cast(l_returnflag = 'A' as double) as \"flag_A\", cast(l_returnflag = 'N' as double) as \"flag_N\", cast(l_returnflag = 'R' as double) as \"flag_R\" from lineitem")
def one_hot(spark, sf_dir):
    return tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *S.one_hot("l_returnflag", ("A", "N", "R"), "flag_"))


@query("NUM-18_absolute_place", sql.with_(sql.variants(K)) + "select variant, motif_pos, j, coalesce(nullif(motif_pos + j, -1), 0) as absolute_pos from windows")
def absolute_place(spark, sf_dir):
    from ..operators.matching import variant_windows

    rows = variant_windows(tables.variants(spark, sf_dir, K), K)
    return rows.select("variant", F.col("motif_pos").cast("long").alias("motif_pos"), F.col("j").cast("long").alias("j"), (F.col("motif_pos") + F.col("j")).cast("long").alias("absolute_pos"))


@query("FLT-1_finite", "select event_id, value from events where value is not null and isfinite(value)")
def finite(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").where(selection.finite("value").isNotNull()).select("event_id", "value")


@query("FLT-2_informative_windows", sql.with_(sql.variants(len(MASK))) + f"select variant, motif_pos, j from windows where j in ({', '.join(str(i) for i, c in enumerate(MASK) if c == '1')})")
def informative_windows(spark, sf_dir):
    from ..operators.matching import variant_windows

    rows = variant_windows(tables.variants(spark, sf_dir, len(MASK)), len(MASK)).where(F.col("j").isin(list(S.informative(MASK))))
    return rows.select("variant", F.col("motif_pos").cast("long").alias("motif_pos"), F.col("j").cast("long").alias("j"))


@query("FLT-3_support", sql.with_(sql.index(K)) + "select kmer, count(*) as n from idx group by kmer having count(*) >= 20")
def support(spark, sf_dir):
    return index.unique_index(tables.regions(spark, sf_dir), K).groupBy("kmer").agg(F.count("*").alias("n")).where("n >= 20")


@query("FN_sql_functions", sql.with_(sql.REGIONS) + f"select region, {sql.rc('seq')} as rc, round(case when length(seq) > 0 then length(regexp_replace(seq, '[AT]', '', 'g')) / length(seq) else 0.0 end, 9) as gc, {sql.text_number('region')} as number, round({sql.two_sided_t('(length(seq) % 7 / 2.0 + 0.25)', '(length(seq) % 50 + 3.0)')}, 9) as student, round({sql.two_sided_normal('(length(seq) % 9 / 2.0)')}, 9) as normal from regions")
def sql_functions(spark, sf_dir):
    """The functions as spark.sql has them."""
    register(spark)
    tables.regions(spark, sf_dir).createOrReplaceTempView("regions_for_functions")
    return spark.sql("select region, reverse_complement(seq) as rc, round(gc_fraction(seq), 9) as gc, text_number(region) as number, round(student_two_sided(length(seq) % 7 / 2.0 + 0.25, length(seq) % 50 + 3.0), 9) as student, round(normal_two_sided(length(seq) % 9 / 2.0), 9) as normal from regions_for_functions")


@query("FN_kmers_of", sql.with_(sql.REGIONS, sql.tokens(K)) + "select kmer, count(*) as n, cast(sum(off) as bigint) as places from tok group by kmer")
def sql_kmers(spark, sf_dir):
    """The table function, joined laterally."""
    register(spark)
    tables.regions(spark, sf_dir).createOrReplaceTempView("regions_for_functions")
    return spark.sql(f"select k.kmer, count(*) as n, sum(k.at) as places from regions_for_functions r, lateral kmers_of(r.seq, {K}) k group by k.kmer")


@query("SRC-3_fetch_sequence", sql.with_(sql.REGIONS) + ", asked as (select region, seq, unnest([0, 17, 250, 1000]) as first, unnest([5, 300, 262, 1003]) as last from regions) select region, cast(first as bigint) as start, cast(last as bigint) as \"end\", upper(substr(seq, cast(first as integer) + 1, cast(last - first as integer))) as seq from asked where length(seq) > 0")
def fetch_sequence(spark, sf_dir):
    """Random access to sequences that are cut into chunks: within one, across several, past the end."""
    chunk = 256
    contigs = tables.regions(spark, sf_dir).where("length(seq) > 0").select(F.col("region").alias("chrom"), "seq")
    starts = F.sequence(F.lit(0), F.length("seq") - 1, F.lit(chunk))
    genome = contigs.withColumn("start", F.explode(starts)).select("chrom", F.col("start").cast("long").alias("start"), F.substring(F.col("seq"), F.col("start") + 1, F.lit(chunk)).alias("seq"))
    places = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for a, b in ((0, 5), (17, 300), (250, 262), (1000, 1003))])
    asked = contigs.select("chrom", F.explode(places).alias("p")).select("chrom", "p.start", "p.end")
    found = formats.sequences(asked, genome, chunk)
    return asked.join(found, ["chrom", "start", "end"], "left").select(F.col("chrom").alias("region"), "start", "end", F.coalesce("seq", F.lit("")).alias("seq"))
