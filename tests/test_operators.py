"""Operators on small tables, against plain Python."""

from __future__ import annotations

import itertools
import math
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqlattice.functions import sequence as S
from seqlattice.operators import background, calibrate, fits, index, matching, motif, ranking, selection, signal
from seqlattice.sources import bigwig, formats
from seqlattice.streaming import variants as streaming


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "ord long, line string")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def regions(spark):
    rng = random.Random(0)
    return spark.createDataFrame([(f"c:{100 * i}-{100 * i + 40}", "".join(rng.choice("ACGT") for _ in range(40)), i) for i in range(60)], "region string, seq string, ord long")


# -- readers --------------------------------------------------------------------


def test_readers_skip_bad_lines(spark):
    assert rows_of(formats.bed(lines(spark, "# x", "", "c 1\t5 extra", "c 1", "c a b")), "chrom", "start", "end") == [("c", 1, 5)]
    once = formats.bed_once(lines(spark, "c\t1\t5\tfirst", "c\t1\t5\tsecond", "c 1 5"))
    assert rows_of(once, "chrom", "start", "end", "fields") == [("c", 1, 5, ["c", "1", "5", "first"])]
    assert rows_of(formats.intensities(lines(spark, "a 1", "b x", "a 2.5e0", "", "c")), "region", "value", "ord") == [("a", 2.5, 0)]
    assert rows_of(formats.wide_intensities(lines(spark, "#h", "a:1-2 3", "c 5 9 4 x", "c 5 9")), "region", "value") == [("a:1-2", 3.0), ("c:5-9", 4.0)]
    assert rows_of(formats.kmer_array(lines(spark, "AC\tr;1;3,s;2;1 9,t;1;x", "bad")), "kmer", "region", "offset") == [("AC", "r", 3)]
    assert rows_of(formats.bedgraph(lines(spark, "track x", "c 0 5 .", "c 5 9 1.5")), "start", "value") == [(0, 0.0), (5, 1.5)]
    assert formats.parse_masks("11,101 # 111\n11") == ["11", "101"] and formats.parse_caps("40, 20,40") == [20, 40]
    with pytest.raises(ValueError):
        formats.parse_caps("5")


def test_openness_chooses_its_column(spark):
    rows = formats.bed_once(lines(spark, "c\t1\t5\tn\t7\t.", "c\t9\t12\tm\t8\t."))
    found, name = formats.openness(rows)
    assert name == "col5" and rows_of(found, "region", "open") == [("c:1-5", 7.0), ("c:9-12", 8.0)]
    assert formats.openness(formats.bed_once(lines(spark, "c\t1\t5\tn")))[1] is None


def test_fasta_slices_cross_chunks(spark, tmp_path):
    seq = "".join(random.Random(1).choice("acgtN") for _ in range(500))
    (tmp_path / "g.fa").write_text(">one extra\n" + "\n".join(seq[i : i + 60] for i in range(0, 500, 60)) + "\n>two\nAC\n")
    genome = formats.fasta(spark, str(tmp_path / "g.fa"), chunk=64)
    asked = spark.createDataFrame([("one", 50, 210), ("one", 0, 1), ("one", 490, 600), ("two", 0, 2)], "chrom string, start long, end long")
    found = {(r["chrom"], r["start"]): r["seq"] for r in formats.sequences(asked, genome, chunk=64).collect()}
    assert found == {("one", 50): seq[50:210].upper(), ("one", 0): seq[:1].upper(), ("one", 490): seq[490:].upper(), ("two", 0): "AC"}


def bigwig_bytes(records: list[tuple[int, int, float]], length: int = 1000) -> bytes:
    """A one-contig file of one compressed bedGraph section."""
    block = struct.pack("<IIIIIBBH", 0, records[0][0], records[-1][1], 0, 0, 1, 0, len(records)) + b"".join(struct.pack("<IIf", *r) for r in records)
    packed = zlib.compress(block)
    chroms = struct.pack("<IIIIQQ", bigwig.CHROM_TREE, 1, 4, 8, 1, 0) + struct.pack("<BBH", 1, 0, 1) + b"chr1" + struct.pack("<II", 0, length)
    chrom_at = 64
    data_at = chrom_at + len(chroms)
    index_at = data_at + len(packed)
    tree = struct.pack("<IIQIIIIQII", bigwig.INDEX_TREE, 1, 1, 0, records[0][0], 0, records[-1][1], index_at, 1, 0) + struct.pack("<BBH", 1, 0, 1) + struct.pack("<IIIIQQ", 0, records[0][0], 0, records[-1][1], data_at, len(packed))
    return struct.pack("<IHHQQQHHQQIQ", bigwig.BIGWIG, 4, 0, chrom_at, data_at, index_at, 0, 0, 0, 0, len(block), 0) + chroms + packed + tree


def test_bigwig_records(spark, tmp_path):
    (tmp_path / "s.bw").write_bytes(bigwig_bytes([(0, 10, 1.0), (10, 30, 2.5), (50, 60, -1.0)]))
    assert rows_of(bigwig.read_bigwig(spark, str(tmp_path / "s.bw")), "chrom", "start", "end", "value") == [("chr1", 0, 10, 1.0), ("chr1", 10, 30, 2.5), ("chr1", 50, 60, -1.0)]
    assert bigwig.chrom_sizes(bigwig_bytes([(0, 1, 1.0)])) == {"chr1": 1000} and bigwig.is_bigwig("a.bigWig")


# -- index and matches -------------------------------------------------------------


def plain_index(regions, k):
    out = {}
    for r in regions.collect():
        for i in range(len(r["seq"]) - k + 1):
            out.setdefault((r["seq"][i : i + k], r["region"]), []).append(i + 1)
    return out


def test_index_and_its_text(spark, regions):
    want = plain_index(regions, 3)
    table = index.inverted_index(regions, 3)
    assert {(r["kmer"], r["region"]): r["offsets"] for r in table.collect()} == want
    back = formats.kmer_array(index.index_text(table, regions).select(F.lit(0).cast("long").alias("ord"), F.concat("kmer", F.lit("\t"), "entries").alias("line")))
    single = sorted((k, r, o[0]) for (k, r), o in want.items() if len(o) == 1)
    assert sorted(map(tuple, back.collect())) == single == sorted(map(tuple, index.unique_index(regions, 3).collect()))
    seen = {k for k, _ in want}
    assert {r["kmer"] for r in index.missing_kmers(table, 3).collect()} == {"".join(p) for p in itertools.product("ACGT", repeat=3)} - seen


def test_long_sequences_are_cut_without_loss(spark):
    seq = "".join(random.Random(2).choice("ACGTN") for _ in range(2000))
    found = index.tokens(spark.createDataFrame([("r", seq)], "region string, seq string"), 7).collect()
    assert sorted((r["offset"], r["kmer"]) for r in found) == [(i + 1, seq[i : i + 7]) for i in range(1994) if "N" not in seq[i : i + 7]]


@pytest.mark.parametrize("last", [False, True])
def test_strand_rules(spark, regions, last):
    k, seq = 4, "ACGTACGTTTGCAAA"
    variants = spark.createDataFrame([("v", seq[:7], 3, "T", "A"), ("w", seq[5:12], 3, "T", "C")], "variant string, seq string, at int, ref string, alt string")
    table = {(x, r): o[0] for (x, r), o in plain_index(regions, k).items() if len(o) == 1}
    found = matching.match(matching.variant_windows(variants, k), index.unique_index(regions, k), k, ["variant", "motif_pos"], last_strand=last, palindrome="both" if last else "reverse")
    want = {}
    for name, window in (("v", seq[:7]), ("w", seq[5:12])):
        for p in range(k):
            kmer, j = window[p : p + k], 3 - p
            for a in "ACGT":
                full = kmer[:j] + a + kmer[j + 1 :]
                other = motif.reverse_complement(full)
                asked = [(full, False), (other, True)] if full != other or last else [(full, True)]
                for kmer_, back in asked:
                    for (x, r), o in table.items():
                        if x == kmer_ and (last or (name, p, a, r) not in want):
                            want[name, p, a, r] = o + (k - 1 - j if back else j)
    assert {(r["variant"], r["motif_pos"], r["allele"], r["region"]): r["place"] for r in found.collect()} == want


def test_masked_hits_by_strand_or_place(spark):
    regions = spark.createDataFrame([("p", "ACGT"), ("q", "AACGTA")], "region string, seq string")
    codes = index.masked_tokens(regions, "1111")
    assert index.masked_hits(regions, "1111", codes.where("region = 'p'"), by_strand=True).count() == 0  # its own reverse complement
    assert rows_of(index.masked_hits(regions, "1111", codes.where("region = 'p'"), by_strand=False), "region", "offset") == [("p", 1), ("q", 2)]


# -- ranks and scores -----------------------------------------------------------------


def test_global_rank_with_ties_and_missing(spark):
    rows = [(i, v) for i, v in enumerate([3.0, 1.0, 3.0, float("nan"), None, 2.0, 1.0])]
    found = ranking.global_rank(spark.createDataFrame(rows, "ord long, value double"), "value", "ord", buckets=3)
    assert [r["ord"] for r in found.orderBy("rank").collect()] == [0, 2, 5, 1, 6, 3, 4] and found.first()["n_total"] == 7


def test_e_score_is_the_area_under_the_curve(spark):
    rng = random.Random(3)
    ranks = spark.createDataFrame([(f"r{i}", i, 40) for i in range(40)], "region string, rank long, n_total long")
    mine = rng.sample(range(40), 12)
    got = ranking.scored(spark.createDataFrame([("k", f"r{i}") for i in mine], "kmer string, region string"), ranks, ["kmer"], 1).first()
    others = set(range(40)) - set(mine)
    assert got["F"] == 12 and got["E"] == pytest.approx(sum(a < b for a in mine for b in others) / (12 * 28) - 0.5)


def test_reduced_scores(spark):
    rng = random.Random(4)
    ranks = spark.createDataFrame([(f"r{i}", i, 50) for i in range(50)], "region string, rank long, n_total long")
    sets = [(0, rng.choice("ACG"), f"r{i}") for i in rng.sample(range(50), 30)]
    found = ranking.reduced_scores(spark.createDataFrame(sets, "group int, base string, region string"), ranks, ["group"], buckets=4)
    for r in found.collect():
        mine = [int(x[1:]) for _, b, x in sets if b == r["base"]]
        rest = [int(x[1:]) for _, b, x in sets if b != r["base"]]
        u = sum(a < b for a in mine for b in rest)
        assert (r["F"], r["B"]) == (len(mine), len(rest)) and r["E_reduced"] == pytest.approx(u / len(mine) / len(rest) - 0.5)
        n = len(mine) * len(rest)
        assert r["z"] == pytest.approx((u - n / 2) / math.sqrt(n * 31 / 12))


def test_disjoint_sets_drop_shared_regions(spark):
    rows = [(0, "A", "x"), (0, "C", "x"), (0, "A", "y"), (1, "A", "x")]
    assert rows_of(ranking.disjoint(spark.createDataFrame(rows, "group int, base string, region string"), ["group"]), "group", "base", "region") == [(0, "A", "y"), (1, "A", "x")]


# -- tests and choices -------------------------------------------------------------------


def test_holm_known_values(spark):
    rows = [(i, p) for i, p in enumerate([0.01, 0.04, 0.03, float("nan"), None, 0.005])]
    got = {r["i"]: r["pval_holm"] for r in selection.holm(spark.createDataFrame(rows, "i int, pval double"), []).collect()}
    assert got[5] == pytest.approx(0.02) and got[0] == pytest.approx(0.03) and got[2] == got[1] == pytest.approx(0.06) and got[3] is got[4] is None


def test_best_window_prefers_support(spark):
    rows = [("v", "AFF", 0, "T", 0.5, 0.001), ("v", "AFF", 1, "T", -0.9, 0.01), ("v", "RAND", 0, "T", 0.5, 0.2), ("v", "RAND", 1, "A", 0.5, 0.01), ("w", "AFF", 2, "T", 0.1, 0.5), ("x", "AFF", 2, "T", 0.1, float("nan"))]
    df = spark.createDataFrame(rows, "variant string, label string, motif_pos int, allele string, coef double, pval double").withColumn("ref", F.lit("A")).withColumn("alt", F.lit("T"))
    assert rows_of(selection.best_window(df), "variant", "motif_pos") == [("v", 1), ("w", 2)]
    lines_ = selection.summary_rows(df).orderBy("variant", "line").collect()
    assert [(r["variant"], r["label"], r["effect"]) for r in lines_][:3] == [("v", "AFF", -0.9), ("v", "RAND", 0.5), ("v", "RAND", None)] and len(lines_) == 9


# -- background -----------------------------------------------------------------------------


def test_quotas_round_halves_to_even():
    assert background.quotas({"A": 1, "C": 9}, 20) == {"A": 1, "C": 9}
    assert background.quotas({"A": 1, "C": 50, "G": 49}, 10) == {"A": 1, "C": 5, "G": 5}


def test_seeded_draws_repeat():
    universe = [(k, [(f"r{k}{i}", i) for i in range(4)]) for k in "abcdefgh"]
    one = background.seeded_background(universe, [0, 1], {"ra0"}, "v", 5)
    assert one == background.seeded_background(universe, [0, 1], {"ra0"}, "v", 5)
    used = [r for m in one.values() for r in m]
    assert len(used) == len(set(used)) == 10 and "ra0" not in used


def test_sampled_background_is_whole_and_free_of_matches(spark):
    variants = spark.createDataFrame([("v",), ("w",)], "variant string")
    places = spark.createDataFrame([(f"r{i}", i) for i in range(100)], "region string, offset int")
    hit = spark.createDataFrame([("v", f"r{i}") for i in range(0, 60, 2)], "variant string, region string")
    found = background.sample_background(variants, hit, places, 3, 10).collect()
    for v in "vw":
        mine = [r["region"] for r in found if r["variant"] == v]
        assert len(mine) == len(set(mine)) == 30
    assert not {r["region"] for r in found if r["variant"] == "v"} & {f"r{i}" for i in range(0, 60, 2)}


def test_stratified_subsample_sizes(spark):
    rows = [("v", a, f"{a}{i}") for a, n in (("A", 100), ("C", 50), ("G", 1)) for i in range(n)]
    found = background.stratified_subsample(spark.createDataFrame(rows, "variant string, allele string, region string"), ["variant"], 30)
    assert rows_of(found.groupBy("allele").count(), "allele", "count") == [("A", 20), ("C", 10), ("G", 1)]


# -- fits --------------------------------------------------------------------------------------


def test_affinity_against_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [("v", "C", "ACGT"[int(rng.integers(3))], float(rng.normal()), float(rng.uniform(0, 0.5)), float(rng.integers(100, 900))) for _ in range(60)]
    df = spark.createDataFrame(rows, "variant string, ref string, allele string, y double, lp double, sl double")
    got = {r["allele"]: r for r in fits.affinity(df, ["variant"], F.col("ref")).collect()}
    assert got["C"]["method"] == "na_ref" and got["T"]["method"] == "na_missing" and got["A"]["n"] == 60
    x = np.array([[1, r[2] == "A", r[2] == "G", r[4], r[5]] for r in rows], float)
    x[:, 3:] = (x[:, 3:] - x[:, 3:].mean(0)) / x[:, 3:].std(0)
    beta = np.linalg.lstsq(x, np.array([r[3] for r in rows]), rcond=None)[0]
    assert [got["A"]["coef"], got["G"]["coef"]] == pytest.approx(beta[1:3].tolist(), rel=1e-8)
    assert fits.affinity(df.limit(5), ["variant"], F.col("ref")).count() == 0


def test_pooled_fit_is_clustered(spark):
    rng = np.random.default_rng(6)
    rows = [("p", f"w{i % 2}", f"r{i // 2}", "AC"[int(rng.integers(2))], "A", float(rng.uniform(0, 9)), float(rng.uniform()), float(rng.uniform())) for i in range(80)]
    got = fits.pooled(spark.createDataFrame(rows, "position string, window string, region string, allele string, ref string, y double, lp double, sl double"), ["position"])
    r = {x["allele"]: x for x in got.collect()}
    assert r["A"]["effect"] is None or math.isnan(r["A"]["effect"])
    assert 0 < r["C"]["pval"] <= 1


def test_residuals_are_orthogonal(spark):
    rng = np.random.default_rng(7)
    rows = [(f"r{i}", float(rng.uniform(-1, 50)), float(rng.uniform())) for i in range(200)]
    df = spark.createDataFrame(rows, "region string, value double, gc double")
    pdf = fits.residualize(df, ["gc"]).toPandas()
    assert abs(pdf["corrected"].sum()) < 1e-8 and abs((pdf["corrected"] * pdf["gc"]).sum()) < 1e-8
    assert fits.residualize(df, ["gc"], "intensity_like").agg(F.min("corrected")).first()[0] >= 0
    with pytest.raises(ValueError):
        fits.residualize(df, ["gc"], "other")


# -- signal ---------------------------------------------------------------------------------------


def test_overlaps_equal_the_plain_condition(spark):
    rng = random.Random(8)
    a = [("c", s, s + rng.randint(1, 90)) for s in (rng.randrange(500) for _ in range(60))]
    b = [("c", s, s + rng.randint(1, 40), float(i)) for i, s in enumerate(rng.randrange(500) for _ in range(80))]
    got = signal.overlaps(spark.createDataFrame(a, "chrom string, start long, end long").distinct(), spark.createDataFrame(b, "chrom string, start long, end long, value double"), 16)
    want = sorted((s, e, v) for _, s, e in set(a) for _, t, u, v in b if s < u and t < e)
    assert sorted((r["start"], r["end"], r["r_value"]) for r in got.collect()) == want


def test_summaries(spark):
    iv = spark.createDataFrame([("c", 0, 10), ("c", 20, 30), ("d", 0, 5)], "chrom string, start long, end long")
    sig = spark.createDataFrame([("c", 0, 4, 2.0), ("c", 4, 12, 5.0), ("c", 25, 26, float("nan"))], "chrom string, start long, end long, value double")
    assert rows_of(signal.summarise(iv, sig, "mean"), "chrom", "start", "value") == [("c", 0, 3.5), ("c", 20, 0.0), ("d", 0, 0.0)]
    assert rows_of(signal.summarise(iv, sig, "mean", weighted=True).where("chrom = 'c'"), "start", "value")[0] == (0, pytest.approx((4 * 2 + 6 * 5) / 10))
    with pytest.raises(ValueError):
        signal.summarise(iv, sig, "median")


# -- motifs and calibration ---------------------------------------------------------------------------


def test_probabilities_fall_back():
    s = motif.Settings(min_per_base=5, min_support=2)
    row = lambda f, e: {"F": f, "B": 1, "E_reduced": e, "p": 1.0}
    nan = math.nan
    assert motif.probabilities({"A": row(9, 0.5), "C": row(0, nan), "G": row(1, nan), "T": row(0, nan)}, "G", s) == [1, 0, 0, 0]
    assert motif.probabilities({b: row(0, nan) for b in "ACGT"}, "G", s) == [0, 0, 1, 0]
    assert motif.probabilities({b: row(0, nan) for b in "ACGT"}, ".", s) == [0.25] * 4
    p = motif.probabilities({"A": row(9, 0.4), "C": row(9, -0.4), "G": row(1, nan), "T": row(0, nan)}, "A", s)
    assert sum(p) == pytest.approx(1) and p[0] > 0.99 and p[2] == p[3] == 0


def test_matrix_helpers():
    ppm = {0: [1.0, 0, 0, 0], 1: [0.25] * 4}
    assert motif.reversed_ppm(ppm) == {0: [0.25] * 4, 1: [0, 0, 0, 1.0]}
    heights = motif.bits(ppm)
    assert heights[0][0] == pytest.approx(2) and heights[1] == pytest.approx([0] * 4)
    assert motif.information([1, 0, 0, 0]) == pytest.approx(1) and motif.information([0.25] * 4) == pytest.approx(0)
    turned = motif.reversed_reduced([{"pos": 0, "base": "A"}, {"pos": 3, "base": "C"}])
    assert turned == [{"pos": 0, "base": "G"}, {"pos": 3, "base": "T"}]


def test_planted_motif_is_found(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        seq = "".join(rng.choice("ACGT") for _ in range(30))
        if i < 120:
            seq = seq[:10] + "GATTAC" + seq[16:]
        rows.append((f"r{i}", seq, 300.0 - i if i < 120 else rng.uniform(0, 150), i))
    df = spark.createDataFrame(rows, "region string, seq string, value double, ord long")
    sets = ranking.probe_sets(index.unique_index(df, 4))
    ranks = ranking.global_rank(df, "value", "ord")
    best = ranking.choose_seed(sets, ranks, 4, min_f=30, max_gaps=0).orderBy(F.desc("E")).first()["kmer"]
    assert best in ("GATT", "ATTA", "TTAC") or motif.reverse_complement(best) in ("GATT", "ATTA", "TTAC")
    found = motif.build(best, sets, ranks, motif.Settings(min_per_base=3), 2, 2)
    assert min(found.ppm) >= -2 and max(found.ppm) <= 5


def test_caps_are_recommended_strictly(spark):
    rows = [(20, 100, 60, 9, 0.6, 0.2, 0.05), (40, 100, 55, 9, 0.55, 0.09, 0.05), (80, 100, 20, 9, 0.2, 0.05, 0.05)]
    summary = spark.createDataFrame(rows, "cap_probes int, n_families_total long, n_families_eligible long, n_families_evaluated long, eligible_fraction double, effect_sd_norm_p90 double, effect_bias_norm_p90 double")
    r = calibrate.recommend_cap(summary).first()
    assert r["recommended_max_probes"] == 40 and r["previous_failed_criteria"] == "effect_sd_norm_p90" and not r["previous_cap_borderline"]
    none = calibrate.recommend_cap(summary, max_sd=0.01).first()
    assert none["recommended_max_probes"] is None and none["status"].startswith("NO_") and none["best_tested_cap"] == 80
    near = calibrate.recommend_cap(summary, max_sd=0.195).first()
    assert near["previous_cap_borderline"] and near["recommended_max_probes"] == 40


def test_controls_are_never_recommended():
    base = {"mask_span": 4, "n_informative": 3, "n_families_evaluated": 5, "eligible_fraction": 0.9, "residual_sd_ratio_p90": 1.0, "effect_bias_norm_p90": 0.1, "minor_allele_fraction_median": 0.1}
    s = pd.DataFrame([{**base, "mask": m, "mask_role": r, "control_source": c, "effect_sd_norm_p90": v} for m, r, c, v in (("1101", "candidate", "candidate", 0.2), ("1011", "candidate", "candidate", 0.205), ("1111", "control", "random", 0.1))])
    marked, best = calibrate.recommend_mask(s)
    assert best["recommended_mask"] == "1101" and best["n_near_optimal"] == 2 and best["control_status"].startswith("CONTROL_OUT")
    assert best["random_control_empirical_p"] == 1.0 and marked["stability_rank"].tolist() == [2, 3, 1]


def test_global_rank_splits_values_that_many_rows_share(spark):
    rng = np.random.default_rng(2)
    rows = [(i, None if i % 9 == 0 else 5.0 if i % 9 < 5 else float(rng.integers(0, 12))) for i in range(900)]
    found = ranking.global_rank(spark.createDataFrame(rows, "ord long, value double"), "value", "ord", buckets=16)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    assert [r["ord"] for r in found.orderBy("rank").collect()] == [r[0] for r in want]
    assert found.agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first() == (0, 899, 900)


def test_seeded_places_are_those_of_the_subsample():
    lookup = {"A": {f"r{i:02d}": i for i in range(30)}, "C": {f"s{i:02d}": i for i in range(9)}}
    drawn = background.seeded_places({"A": 30, "C": 9}, 10, 4, ("x", 1))
    regions = {a: [sorted(lookup[a])[i] for i in x] for a, x in drawn.items()}
    assert {a: sorted(x) for a, x in background.seeded_subsample(lookup, 10, 4, ("x", 1)).items()} == regions


def test_random_masks_match_their_reference():
    found = calibrate.random_masks("1101011", 4, 3, ("1011101",))
    assert len(set(found)) == 4 and all(len(m) == 7 and m.count("1") == 5 and m[0] == m[-1] == "1" for m in found)
    assert not {m for m in found} & {m[::-1] for m in ("1101011", "1011101")}
    with pytest.raises(ValueError):
        calibrate.random_masks("111", 2)


# -- streaming ----------------------------------------------------------------------------------------


def test_stream_of_variants_matches_as_a_table(spark, regions, tmp_path):
    k = 4
    variants = spark.createDataFrame([(f"v{i}", "ACGTTGC"[i:] + "ACGTTGC"[:i], 3, "T", "A") for i in range(5)], "variant string, seq string, at int, ref string, alt string")
    variants.repartition(3).write.parquet(str(tmp_path / "in"))
    table = index.unique_index(regions, k)
    stream = spark.readStream.schema(variants.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.start(stream, table, k, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = matching.match(matching.variant_windows(variants, k), table, k, ["variant", "motif_pos"])
    names = ["variant", "motif_pos", "allele", "region", "place"]
    assert rows_of(spark.read.parquet(str(tmp_path / "out")), *names) == rows_of(want, *names)


def test_late_events_are_dropped(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 01:00:00", "a", 2.0)]
    df = spark.createDataFrame(rows, "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    q = streaming.event_rates(stream).writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rates").where("n = 1 and total = 1.0").count() == 1


def test_choose_reference_breaks_ties_by_letter(spark):
    rows = [("f", a, str(i)) for i, a in enumerate("CCAATG")]
    assert calibrate.reference_allele(spark.createDataFrame(rows, "family string, allele string, region string"), ["family"]).first()["ref"] == "A"


def test_display_of_p(spark):
    from seqlattice.functions.stats import p_text

    rows = [(0.012345,), (0.0,), (None,), (float("nan"),)]
    assert [r[0] for r in spark.createDataFrame(rows, "p double").select(p_text(F.col("p"))).collect()] == ["1.235e-02", "<1e-300", "NA", "NA"]
