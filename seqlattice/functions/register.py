"""The engine's functions by name, for ``spark.sql``.

Those that Spark's own functions express are SQL functions, which the optimiser inlines; the
distribution tails are vectorised. All are temporary functions of one session.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import stats

_LETTERS = "length(regexp_replace(upper(seq), '[^{0}]', ''))"
SQL_FUNCTIONS = {
    "reverse_complement": "(seq STRING) RETURNS STRING RETURN reverse(translate(seq, 'ACGTacgt', 'TGCAtgca'))",
    "canonical_kmer": "(kmer STRING) RETURNS STRING RETURN least(kmer, reverse(translate(kmer, 'ACGTacgt', 'TGCAtgca')))",
    "gc_fraction": f"(seq STRING) RETURNS DOUBLE RETURN CASE WHEN {_LETTERS.format('ACGT')} > 0 THEN {_LETTERS.format('CG')} / {_LETTERS.format('ACGT')} ELSE 0D END",
    "folded_place": "(place DOUBLE, size DOUBLE) RETURNS DOUBLE RETURN CASE WHEN place / size > 0.5D THEN 1D - place / size ELSE place / size END",
    "wildcard_kmer": "(kmer STRING, place INT) RETURNS STRING RETURN concat(substring(kmer, 1, place), '.', substring(kmer, place + 2))",
    "information_content": "(a DOUBLE, c DOUBLE, g DOUBLE, t DOUBLE) RETURNS DOUBLE RETURN 2D + aggregate(array(a, c, g, t), 0D, (s, p) -> s + CASE WHEN p > 0 THEN p * log2(p) ELSE 0D END)",
    "text_number": "(x STRING) RETURNS BIGINT RETURN cast(conv(substring(md5(x), 1, 15), 16, 10) as bigint)",
    "kmers_of": "(seq STRING, k INT) RETURNS TABLE (at INT, kmer STRING) RETURN SELECT i, substring(upper(seq), i, k) FROM (SELECT explode(CASE WHEN length(seq) >= k THEN sequence(1, length(seq) - k + 1) ELSE array() END) AS i) WHERE substring(upper(seq), i, k) RLIKE '^[ACGT]+$'",
}


def _student(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(np.exp(stats.log_t_two_sided(t.to_numpy(float), df.to_numpy(float))))


def _normal(z: pd.Series) -> pd.Series:
    return pd.Series(stats.normal_two_sided(z.to_numpy(float)))


def register(spark: SparkSession) -> list[str]:
    """Registers all functions and returns their names."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udf.register("student_two_sided", F.pandas_udf(_student, "double"))
    spark.udf.register("normal_two_sided", F.pandas_udf(_normal, "double"))
    return [*SQL_FUNCTIONS, "student_two_sided", "normal_two_sided"]
