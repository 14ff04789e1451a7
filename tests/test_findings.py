"""Findings of the second round, each on the smallest input that showed it."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlattice.functions import sequence as S
from seqlattice.functions.stats import scientific
from seqlattice.operators import background, beside, calibrate, capped, fits, local, matching, ranking
from seqlattice.operators.index import masked_hits, masked_tokens, unique_index
from seqlattice.plans import registry, sql


def test_scientific_text_rounds_the_binary_value(spark):
    values = [1 / 64, 1 / 128, 0.012345, 1 / 3, 2.0, 0.0, None, float("nan")]
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(scientific(F.col("x"), 3)).collect()]
    assert found == [None if v is None else f"{v:.3e}" for v in values] and found[0] == "1.562e-02"


def test_holm_best_window_of_shared_lines_equals_its_sql(spark, tmp_path):
    rows = [(1, 3, 1, 1, 13.0, 0.0, 0.08), (1, 3, 2, 1, 1.0, 0.0, 0.0), (1, 4, 3, 1, 1.0, 0.08, 0.05), (1, 6, 5, 2, 1.0, 0.0, 0.0), (2, 2, 1, 1, 1.0, 0.1, 0.0), (2, 1, 1, 1, 1.0, 0.0, 0.04), (2, 1, 1, 2, 13.0, 0.0, 0.04)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    name = "WIN-3_best_window_holm"
    found = sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).select("variant", "motif_pos").collect()))
    assert found == sorted(con.sql(f"select variant, motif_pos from ({registry.oracle_sql()[name]})").fetchall()) and ("1", 1) in found


def _small(spark):
    draw = random.Random(3)
    seqs = ["".join(draw.choices("ACGTN" if i % 9 == 0 else "ACGT", k=draw.choice([0, 3, 20, 90]))) for i in range(150)]
    rows = [(f"d{i % 120}:0-{len(s)}", s if i % 5 else s.lower(), draw.random(), draw.random()) for i, s in enumerate(seqs)]
    rows += [("d7:0-9", "ACGTACCGT", 0.5, 0.5), ("d7:0-9", "TTACGTAAA", 0.2, 0.1)]  # two rows, one region
    windows = [(f"v{i}", i % 3, "".join(draw.choices("ACGT", k=4)), draw.randrange(4)) for i in range(60)] + [("p", 0, "ACGT", 1), ("p", 1, "TGCA", 3)]
    return spark.createDataFrame(rows, "region string, seq string, y double, cpg_oe double"), spark.createDataFrame(windows, "variant string, motif_pos int, kmer string, j int")


@pytest.mark.parametrize("palindrome, last", [("reverse", False), ("both", True), ("forward", False)])
@pytest.mark.parametrize("alone", [True, False])
def test_counts_beside_regions_equal_the_joined_matches(spark, palindrome, last, alone):
    regions, windows = _small(spark)
    by = ["variant", "motif_pos"]
    found = matching.match(windows, unique_index(regions, 4), 4, by, palindrome=palindrome, last_strand=last)
    found = matching.unambiguous(found, by) if alone else found
    plain = found.groupBy(*by, "allele").agg(F.count("*").alias("n"), F.sum("place").alias("places"))
    got = local.counts(windows, regions, 4, by, None, alone=alone, palindrome=palindrome, last_strand=last)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() > 20


def test_moments_beside_regions_give_the_fits_of_the_joined_design(spark):
    regions, windows = _small(spark)
    by, regions = ["variant", "motif_pos"], regions.dropDuplicates(["region"])
    keyed = windows.withColumn("ref", F.substring(F.col("kmer"), F.col("j") + 1, F.lit(1)))
    design = matching.design(matching.match(windows, unique_index(regions, 4), 4, by), by, regions.withColumnRenamed("y", "value"), regions)
    covariates = ("lp", "sl", "cpg_oe")
    plain = fits.affinity(design.join(keyed.select(*by, "ref"), by), by, F.col("ref"), covariates=covariates)
    got = fits.affinity_of(local.design_moments(keyed, regions, local.asked_patterns(windows), 4, by, covariates), by, covariates)
    rows = [sorted((tuple(None if x is None or x != x else round(x, 7) if isinstance(x, float) else x for x in r) for r in f.collect()), key=str) for f in (got, plain)]
    assert rows[0] == rows[1] and len(rows[0]) > 20


@pytest.mark.parametrize("name", ["AGG-3_unambiguous", "JOIN-2_scan_matches", "SMP-1_sample_sizes", "OP-2_affinity", "OP-6_scan", "OP-4_against_background", "OP-3_variant_rows", "OP-3_best_windows", "OP-8_holm_scan", "OP-7_pooled_scan", "OP-19_pooled_background"])
def test_no_row_of_the_index_is_shuffled(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "mapInPandas" in plan.lower().replace("mapinpandas", "mapInPandas") and "min(offset" not in plan and "_h, " not in plan


def test_sample_of_candidates_equals_that_of_all_matches(spark):
    regions, windows = _small(spark)
    by = ["variant", "motif_pos"]
    found = matching.match(windows, unique_index(regions, 4), 4, by)
    few = local.sample_candidates(windows, regions, 4, by, 5)
    sizes = local.counts(windows, regions, 4, by, None, alone=False)
    names = [*by, "allele", "region", "place"]
    plain, got = (sorted(map(tuple, f.select(*names).collect())) for f in (background.stratified_subsample(found, by, 5), background.stratified_subsample(few, by, 5, sizes=sizes)))
    assert got == plain and few.count() < found.count()


def _variants(spark):
    """Windows of some variants over the regions of _small(), and what they hit, in shuffles."""
    regions, windows = _small(spark)
    regions = regions.where("region != 'd7:0-9'").dropDuplicates(["region"]).select("region", "seq", (F.col("y") * 40).alias("y")).persist()
    windows = windows.withColumn("variant", F.concat(F.lit("v"), (F.monotonically_increasing_id() % 9).cast("string"))).withColumn("motif_pos", (F.col("j") % 3).cast("int"))
    windows = windows.dropDuplicates(["variant", "motif_pos"]).withColumn("ref", F.substring(F.col("kmer"), F.col("j") + 1, F.lit(1))).persist()
    found = matching.match(windows, unique_index(regions, 4), 4, ["variant", "motif_pos"]).persist()
    return regions, windows, found, beside.held(windows)


def _same(got, plain, *names):
    rows = [sorted((tuple(None if x is None or x != x else round(x, 6) if isinstance(x, float) else x for x in r) for r in f.select(*names).collect()), key=str) for f in (got, plain)]
    assert rows[0] == rows[1] and rows[0]


@pytest.fixture
def many_tasks(spark):
    """Most tasks are empty."""
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for values in (settings, before):
        for k, v in values.items():
            spark.conf.set(k, v)
        if values is settings:
            yield


def test_empty_tasks_have_typed_columns(spark, many_tasks):
    regions, windows, _, held = _variants(spark)
    few = regions.where("length(seq) > 60").limit(14).persist()
    drawn = beside.sample(beside.places(few, held, 4), held.variants, 3, 6).select("variant", "motif_pos", "region", (F.col("offset") + F.col("motif_pos")).alias("place"))
    assert beside.pooled(held, few, 4, drawn).count() and beside.hit_sums(few, held.patterns, 4).count()


@pytest.mark.parametrize("n", [1, 4, 400])
def test_background_of_bits_is_that_of_the_joined_ring(spark, n):
    regions, windows, found, held = _variants(spark)
    first = unique_index(regions, 4).groupBy("region").agg(F.min("offset").alias("offset"))
    plain = background.sample_background(windows.select("variant").distinct(), found, first, 3, n)
    _same(beside.sample(beside.places(regions, held, 4), held.variants, 3, n), plain, "variant", "motif_pos", "region", "offset")


def test_fits_against_the_background_need_no_matches(spark):
    by = ["variant", "motif_pos"]
    regions, windows, found, held = _variants(spark)
    drawn = beside.sample(beside.places(regions, held, 4), held.variants, 3, 6).select(*by, "region", (F.col("offset") + F.col("motif_pos")).alias("place"))
    plain = background.against_background(found, drawn, by, regions.withColumnRenamed("y", "value"))
    _same(beside.against_background(windows, regions, drawn, held.patterns, 4, by), plain, *plain.columns)


@pytest.mark.parametrize("with_background", [False, True])
def test_pooled_fits_need_no_matches(spark, with_background):
    by = ["variant", "motif_pos"]
    regions, windows, found, held = _variants(spark)
    drawn = beside.sample(beside.places(regions, held, 4), held.variants, 3, 6).select(*by, "region", (F.col("offset") + F.col("motif_pos")).alias("place")) if with_background else None
    hits = matching.unambiguous(found, by).join(windows.select(*by, "ref"), by).select(*by, "region", "allele", "place", "ref")
    if drawn is not None:
        hits = hits.withColumn("ref", F.lit("none")).unionByName(drawn.select(*by, "region", "place", F.lit("none").alias("allele"), F.lit("none").alias("ref")))
    size = S.region_length("region")
    rows = hits.join(regions.select("region", "y"), "region").select("variant", F.col("motif_pos").cast("string").alias("window"), "region", "allele", "ref", "y", S.folded_place(F.col("place"), size).alias("lp"), size.cast("double").alias("sl"))
    plain = fits.pooled(rows.withColumn("ref", F.lit("none")) if with_background else rows.withColumn("ref", F.lit("A")), ["variant"])
    if not with_background:
        held = beside.held(windows.withColumn("ref", F.lit("A")))
    _same(beside.pooled(held, regions, 4, drawn), plain, *plain.columns)


@pytest.mark.parametrize("mask", ["1101", "1011", "10101"])
def test_masked_background_needs_no_signatures_in_shuffles(spark, mask):
    regions, _ = _small(spark)
    regions = regions.select("region", "seq").persist()
    draw = random.Random(8)
    windows = spark.createDataFrame([(f"v{i % 12}", i % 3, "".join(draw.choices("ACGT", k=len(mask))), i % len(mask)) for i in range(40)], "variant string, motif_pos int, kmer string, j int")
    found = matching.masked_match(windows, regions, mask, ["variant", "motif_pos"])
    once = masked_tokens(regions, mask).where("not is_reverse").groupBy("code", "region").agg(F.count("*").alias("n"), F.min("offset").alias("offset")).where("n = 1")
    plain = background.sample_background(windows.select("variant").distinct(), found, once.groupBy("region").agg(F.min("offset").alias("offset")), 3, 5)
    names = sorted({r["variant"] for r in windows.select("variant").collect()})
    tested = [tuple(r) for r in matching.masked_tests(windows, mask).select("variant", "code").distinct().collect()]
    _same(beside.sample(beside.masked_places(regions, mask, tested, names), names, 3, 5), plain, "variant", "motif_pos", "region", "offset")


@pytest.mark.parametrize("kept", [2, 3, 99])
def test_design_sums_beside_regions_equal_those_of_the_joined_design(spark, kept):
    by = ["variant", "motif_pos"]
    regions, windows = _small(spark)
    regions = regions.withColumn("cpg_oe", F.when(F.crc32("region") % 4 < kept, F.round("cpg_oe", 1 if kept == 3 else 9))).persist()
    plain = matching.design(matching.match(windows, unique_index(regions, 4), 4, by), by, regions.withColumnRenamed("y", "value"), regions)
    plain = plain.groupBy(*by, "allele").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("y", "lp", "sl", "cpg_oe")])
    sums = beside.design_sums(regions.withColumnRenamed("cpg_oe", "c"), local.asked_patterns(windows), 4)
    _same(windows.select(*by, local.pattern_of("kmer", "j").alias("pattern")).distinct().join(sums, "pattern"), plain, *plain.columns)


def test_capped_curves_are_those_of_the_whole_design(spark):
    regions, _ = _small(spark)
    regions = regions.select("region", "seq", "y").persist()
    patterns = calibrate.every_family(4)
    idx = unique_index(regions, 4)
    assert {r["family"] for r in calibrate.families(idx, 4).collect()} <= set(patterns)
    size = S.region_length("region")
    single = matching.unambiguous(calibrate.family_matches(calibrate.families(idx, 4), idx, 4), ["family"]).join(regions.select("region", "y"), "region")
    rows = single.select("family", "region", "allele", "place", "y", S.folded_place(F.col("place"), size).alias("lp"), size.cast("double").alias("sl"))
    rows = rows.orderBy("region", "y").coalesce(1).persist()  # rows of one region in the order of y
    able = rows.groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("allele").alias("a")).where("n >= 20 and a > 1")
    plain = calibrate.curves(rows.join(F.broadcast(able.select("family")), "family"), [20, 30], repeats=3)[0].persist()
    assert plain.count() > 20
    _same(capped.curves(regions, patterns, 4, [20, 30], repeats=3), plain, *plain.columns)


def test_cap_curves_shuffle_no_row_of_the_design(spark):
    plan = registry.queries()["AGG-16_cap_curves"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("by_strand", [False, True])
@pytest.mark.parametrize("mask", ["1101", "11011", "101"])
def test_masked_hits_shuffle_no_signature(spark, mask, by_strand):
    regions, _ = _small(spark)
    regions = regions.select("region", "seq").persist()
    targets = spark.range(4 ** mask.count("1")).where("id % 3 > 0").withColumnRenamed("id", "code").persist()
    plain = masked_hits(regions, mask, targets, by_strand=by_strand)
    got = local.masked_hits(regions, mask, targets, by_strand=by_strand)
    _same(got, plain, "code", "region", "offset", "is_reverse")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_rounded_means_follow_the_order_of_rows_at_a_tie(spark):
    """Means of 64 hundredths, some at a tie of the sixth place; a key without values, a null one and one without ties."""
    draw = random.Random(8)
    rows, expected = [], {}
    for key in [*range(40), None, 99]:
        values = [(i * 7 % 11) / 100 for i in range(32)] if key == 99 else draw.choices([x / 100 for x in range(9)], k=64)
        values = [None] * 5 if key == 7 else values
        total = 0.0
        for at, v in enumerate(values):
            rows.append((key, v, -v if v is not None else None, at))
            total += v or 0.0
        mean = None if key == 7 else total / len(values)
        expected[key] = (len(values), mean and int(mean * 1e6 + 0.5) / 1e6, mean and -int(mean * 1e6 + 0.5) / 1e6)
    ties = sum(abs(sum(round(v * 100) for k, v, _, _ in rows if k == key and v is not None) * 10000 / 64 % 1 - 0.5) < 1e-9 for key in range(40))
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, "k long, a double, b double, at int").repartition(7)
    for most in (100_000, 0):  # the keys at a tie sent to the tasks, or met in a shuffle
        got = {r["k"]: (r["n"], r["a"], r["b"]) for r in ranking.rounded_means(table, "k", ["a", "b"], [F.col("at")], broadcast=most).collect()}
        assert got == expected and ties > 0


def test_vanishing_p_values_are_those_of_the_sql():
    """Beyond 1e-308 doubles lose digits, and -log10 of a p that ends at 0 is infinite in SQL."""
    draw = random.Random(5)
    tests = [(draw.uniform(20, 60), float(draw.randrange(1500, 28000))) for _ in range(4000)]
    t, df = (np.array(x) for x in zip(*tests))
    con = duckdb.connect()
    con.sql("create table tests(i int, t double, df double)")
    con.executemany("insert into tests values (?, ?, ?)", [(i, *x) for i, x in enumerate(tests)])
    known = np.array([r[0] for r in con.sql(f"select round(-log10({sql.two_sided_t('t', 'df')}), 6) + 0 from tests order by i").fetchall()])
    got = np.round(calibrate.neglog10_double(t, df), 6)
    tail = (known > 317) & np.isfinite(known)
    assert np.isinf(known).sum() > 100 and tail.sum() > 10 and (np.isinf(got) == np.isinf(known)).all()
    assert np.abs(np.where(np.isinf(known), 0, got) - np.where(np.isinf(known), 0, known)).max() < 2e-6


def test_full_effects_of_sums_are_those_of_the_whole_design(spark):
    regions, _ = _small(spark)
    regions = regions.select("region", "seq", "y").persist()
    idx = unique_index(regions, 4)
    size = S.region_length("region")
    single = matching.unambiguous(calibrate.family_matches(calibrate.families(idx, 4), idx, 4), ["family"]).join(regions.select("region", "y"), "region")
    rows = single.select("family", "region", "allele", "y", S.folded_place(F.col("place"), size).alias("lp"), size.cast("double").alias("sl")).persist()
    able = rows.groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("allele").alias("a")).where("n >= 30 and a > 1")
    plain = calibrate.full_effects(rows.join(able.select("family"), "family"))
    assert 20 < able.count() < rows.select("family").distinct().count()
    _same(capped.full_effects(regions, calibrate.every_family(4), 4), plain, *plain.columns)


def test_contrasts_shuffle_no_row_of_the_design(spark):
    plan = registry.queries()["AGG-25_contrasts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "FlatMapGroupsInPandas" not in plan


def test_mask_curves_are_those_of_the_joined_design(spark):
    regions, _ = _small(spark)
    regions = regions.select("region", "seq", "y").persist()
    masks, n, least = ["1101", "10101"], 12, 15
    got, got_curves = capped.mask_curves(regions, masks, n, least=least, repeats=3)
    families, curves = {}, []
    for mask in masks:
        asked = calibrate.mask_families(regions, mask, n, 1).persist()
        hits = masked_hits(regions, mask, asked, by_strand=True)
        found = asked.join(hits, "code").select("family", "allele", "region", S.wildcard_place(F.col("offset"), F.col("tested"), len(mask), F.col("is_reverse")).alias("place"))
        size = S.region_length("region")
        design = matching.unambiguous(found, ["family"]).join(regions.select("region", "y"), "region").select("family", "region", "allele", "place", "y", S.folded_place(F.col("place"), size).alias("lp"), size.cast("double").alias("sl"))
        design = design.orderBy("region", "y").coalesce(1).persist()
        full = calibrate.full_effects(design).groupBy("family").agg(F.max("residual_sd_ratio").alias("ratio"))
        rows = asked.select("family").distinct().join(calibrate.minor_fraction(design, ["family"]), "family", "left").join(full, "family", "left").toPandas()
        for r in rows.itertuples():
            families[r.family] = (mask, r.n_probes, r.n_alleles, r.minor_allele_fraction, r.ratio, bool(r.n_probes >= least and r.n_alleles > 1 and r.ratio == r.ratio))
        able = [(f,) for f, r in families.items() if r[0] == mask and r[-1]]
        curves.append(calibrate.curves(design.join(F.broadcast(spark.createDataFrame(able, "family string")), "family"), [least - 1], repeats=3)[0])
    assert len(got) == len(families) and 5 < got["eligible"].sum() < len(got)
    for r in got.itertuples(index=False):
        mask, *values, eligible = families[r.family]
        assert (r.mask, r.eligible) == (mask, eligible) and list(r[2:6]) == pytest.approx([0 if i < 2 and v != v else v for i, v in enumerate(values)], nan_ok=True)
    _same(got_curves, curves[0].unionByName(curves[1]), *curves[0].columns)


def test_long_masks_are_looked_up_without_a_table():
    asked = capped.MaskFamilies([("11111111111|ACGTACGTAC.", 10, a, 4 * int("0123012301", 4) + i) for i, a in enumerate("ACGT")])
    region, family, allele, place, alone = asked.found([["TTACGTACGTACGAA"], ["ACGTACGTACG", "ACGTACGTACG"], ["ACGTACGTACGNACGTACGTACT"], ["ACGTA"]])
    assert region.tolist() == [0, 1, 2, 2] and allele.tolist() == [2, 2, 2, 3] and place[[0, 1]].tolist() == [13, 11] and alone.tolist() == [True, True, False, False]


def test_p_text_of_empty_documents_equals_its_sql(spark, tmp_path):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    rows = list(enumerate([0, 5, None, 64, 128, 1]))
    spark.createDataFrame(rows, "doc_id long, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = sorted(map(tuple, registry.queries()["SNK-7_p_text"](spark, str(tmp_path)).select("doc_id", "shown").collect()))
    assert found == sorted(con.sql(registry.oracle_sql()["SNK-7_p_text"]).fetchall()) and found[0] == (0, "NA")


def _suppliers_without_values(spark, folder):
    """600 line items each of 12 suppliers: one without discounts, one without taxes, one without both, one that is null, one with NaN."""
    draw = random.Random(4)
    rows = [(None if k == 6 else k, None if k in (2, 4) else float("nan") if k == 8 and i == 5 else draw.randrange(9) / 100, None if k in (3, 4) else draw.randrange(9) / 100) for k in range(12) for i in range(600 if k != 7 else 60)]
    spark.createDataFrame(rows, "l_suppkey long, l_discount double, l_tax double").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{folder}/lineitem.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["WIN-6_stability_ranks", "AGG-19_mask_ranking"])
def test_missing_averages_rank_last_as_in_sql(spark, tmp_path, name):
    con = _suppliers_without_values(spark, tmp_path)
    found = registry.queries()[name](spark, str(tmp_path))
    known = con.sql(f"select {', '.join(found.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, known)) and len(known) == 12


def test_exact_means_round_a_tie_up_in_any_order(spark):
    draw = random.Random(8)
    groups = {k: draw.choices(range(9), k=64) for k in range(60)}
    rows = [(k, v / 100) for k, values in groups.items() for v in values] + [(60, float("nan")), (61, None), (61, 1e30)]
    draw.shuffle(rows)
    got = {r["k"]: (r["n"], r["a"]) for r in ranking.exact_means(spark.createDataFrame(rows, "k int, a double").repartition(5), "k", ["a"]).collect()}
    ties = [k for k, v in groups.items() if sum(v) * 10000 * 2 % 128 == 64]
    assert ties and all(got[k] == (64, (sum(v) * 10000 * 2 + 64) // 128 / 1e6) for k, v in groups.items())
    assert got[60][1] != got[60][1] and got[61] == (2, 1e30)
