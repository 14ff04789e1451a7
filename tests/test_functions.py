"""Scalar functions, tails and solvers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqlattice.functions import sequence as S
from seqlattice.functions import stats
from seqlattice.operators.motif import reverse_complement

BASES = st.text("ACGT", min_size=1, max_size=12)


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_reverse_complement_keeps_case_and_other_letters(spark):
    assert values(spark, [("ACgtN.",), (None,)], "s string", S.reverse_complement("s")) == [(".NacGT",), (None,)]


@settings(max_examples=50, deadline=None)
@given(BASES)
def test_reverse_complement_is_its_own_inverse(s):
    assert reverse_complement(reverse_complement(s)) == s


def test_kmers_drop_other_letters_but_not_offsets(spark):
    found = values(spark, [("acNgtac",), ("AC",), ("",)], "s string", F.transform(S.kmers("s", 3), lambda w: F.concat(w["kmer"], w["offset"].cast("string"))))
    assert found == [(["GTA4", "TAC5"],), ([],), ([],)]


def test_composition(spark):
    rows = [("CGCG",), ("ATAT",), ("",), ("CCNG",)]
    found = values(spark, rows, "s string", S.gc_fraction("s"), S.cpg_observed_expected("s"))
    assert found[0] == (1.0, 2.0) and found[1] == (0.0, 0.0) and found[2] == (0.0, 0.0)
    assert found[3][0] == 1.0 and found[3][1] == 0.0


def test_regions_and_variants(spark):
    rows = [("chr1:5-9",), ("a:b:7-3",), ("none",)]
    assert values(spark, rows, "r string", S.region_part("r", "chrom"), S.region_length("r")) == [("chr1", 4), ("a:b", 1), (None, 200)]
    parts = S.parse_variant("r")
    assert values(spark, [("chr1:12:a>t",), ("bad",)], "r string", *parts.values()) == [("chr1", 12, "A", "T"), (None,) * 4]


def test_masks():
    assert S.informative("1101") == (0, 1, 3)
    for bad in ("", "12", "1000", "1" * 32):
        with pytest.raises(ValueError):
            S.informative(bad)


def test_signatures(spark):
    mask = "1101"
    rows = [("ACGT",), ("ACNT",), ("NCGT",), ("AC",)]
    found = values(spark, rows, "w string", S.signature("w", mask), S.signature_pattern(S.signature("w", mask), mask))
    assert found == [(0 * 16 + 1 * 4 + 3, "AC.T"), (7, "AC.T"), (None, None), (None, None)]
    shown = values(spark, [("ACGT",)], "w string", S.masked_display("w", mask, 1), S.masked_display("w", mask, 1, "G"))
    assert shown == [("A.xT", "AGxT")]


def test_t_tail_known_values():
    # P(|T| > t): 1 - 2 atan(t) / pi for one degree of freedom; 1 - t / sqrt(2 + t^2) for two
    t = np.array([0.1, 1.0, 5.0, 1e6])
    assert np.exp(stats.log_t_two_sided(t, np.ones(4))) == pytest.approx(1 - 2 * np.arctan(t) / math.pi, rel=1e-9)
    assert np.exp(stats.log_t_two_sided(t[:3], np.full(3, 2.0))) == pytest.approx(1 - t[:3] / np.sqrt(2 + t[:3] ** 2), rel=1e-12)
    assert stats.log_t_two_sided(np.array([1e5]), np.array([200.0]))[0] < -1000
    assert stats.log_t_two_sided(np.array([1.96]), np.array([1e7]))[0] == pytest.approx(math.log(math.erfc(1.96 / math.sqrt(2))), abs=1e-5)


def test_moment_fit_is_least_squares():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3)) * [1, 50, 0.1] + [0, 300, 2]
    y = x @ [1.0, 0.02, -3] + rng.normal(size=80)
    both = np.column_stack([x, y])
    centred = both - both.mean(axis=0)
    found = stats.fit_moments(80, both.mean(axis=0), centred.T @ centred, ["A", "sl", "lp"], {"sl", "lp"})
    scaled = np.column_stack([np.ones(80), x[:, 0], (x[:, 1:] - x[:, 1:].mean(0)) / x[:, 1:].std(0)])
    beta, cov, df = stats.lstsq_fit(scaled, y)
    assert [found[k][0] for k in ("const", "A", "sl", "lp")] == pytest.approx(beta.tolist(), rel=1e-9)
    p = np.exp(stats.log_t_two_sided(beta / np.sqrt(np.diag(cov)), np.full(4, df)))
    assert [found[k][1] for k in ("const", "A", "sl", "lp")] == pytest.approx(p.tolist(), rel=1e-7)


def test_rank_deficient_fit_has_least_norm():
    rng = np.random.default_rng(1)
    a = rng.normal(size=50)
    x, y = np.column_stack([a, 2 * a]), a + rng.normal(size=50)
    both = np.column_stack([x, y])
    centred = both - both.mean(axis=0)
    found = stats.fit_moments(50, both.mean(axis=0), centred.T @ centred, ["a", "b"], set())
    beta, _, df = stats.lstsq_fit(np.column_stack([np.ones(50), x]), y)
    assert df == 48 and [found[k][0] for k in ("const", "a", "b")] == pytest.approx(beta.tolist(), rel=1e-6)


def test_negative_binomial_solves_its_score_equations():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(300), rng.normal(size=300)])
    y = rng.poisson(np.exp(0.5 + 0.7 * x[:, 1])).astype(float)
    beta, _ = stats.negative_binomial(x, y)
    mu = np.exp(x @ beta)
    assert x.T @ ((y - mu) / (1 + mu)) == pytest.approx(np.zeros(2), abs=1e-3)
    with pytest.raises(ValueError):
        stats.negative_binomial(x, np.zeros(300))
