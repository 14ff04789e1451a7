"""Empty tables, hostile texts and hash collisions for the text operators, and the queries as registered."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from seqlattice.llm import html_extraction, jaccard_join, packing, paragraph_dedup, quality_rules, queries, sentence_pieces, sharding, suffix_dedup, top_k, toxicity
from seqlattice.llm.common import ShortSpans, Spans, names_of, same_spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
PAGES = "page_id long, url string, html string"
VECTORS = "vec_id long, embedding array<float>, label int"


def thue_morse(n: int, letters: str = "ab") -> tuple[str, str]:
    """Two texts of n characters that every polynomial modulo 2**64 takes for equal (from 1,024 on)."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return tuple("".join(letters[b ^ x] for b in bits) for x in (0, 1))


def write(spark, folder, **tables):
    kinds = {"documents": DOCS, "labels": LABELS, "pages": PAGES, "embeddings": VECTORS}
    for name, kind in kinds.items():
        spark.createDataFrame(tables.get(name, []), kind).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


COLUMNS = {
    "op1_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op2_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op3_jaccard_join": {"doc_id", "class_id", "n_links"},
    "op4_html_extraction": {"page_id", "url", "text", "n_chars"},
    "op5_toxicity": {"doc_id", "held_out", "score", "predicted", "spans"},
    "op6_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op7_top_k": {"query_id", "rank", "vec_id", "score"},
    "op8_sentence_pieces": {"doc_id", "n_ids"},
    "op9_paragraph_dedup": {"doc_id", "n_paragraphs", "n_removed", "removed", "kept_in"},
    "op10_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_queries_of_empty_tables_are_empty(spark, tmp_path, name):
    out = queries.QUERIES[name](spark, write(spark, tmp_path))
    assert COLUMNS[name] <= set(out.columns) and out.count() == 0


def test_queries_of_small_tables(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", "  ", " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(40)) for _ in range(60)), "x" * 5000]
    docs = [(i, t, None, None, None) for i, t in enumerate(texts)] * 2 + [(None, None, None, None, None)]
    pages = [(1, None, None), (2, "http://a/b", "<p>Text</p>"), (2, "http://a/b", "<p>Text</p>")]
    vectors = [(0, [1.0, -0.5], 1), (1, [0.25, 4.0], 0), (50, None, None), (100, [2.0], 0)]
    folder = write(spark, tmp_path, documents=docs, labels=[(3, 1, 0), (4, 0, 1), (9, None, None)], pages=pages, embeddings=vectors)
    out = {name: f(spark, folder).collect() for name, f in queries.QUERIES.items()}
    for name in ("op2_quality_rules", "op3_jaccard_join", "op5_toxicity", "op6_sharding", "op8_sentence_pieces", "op9_paragraph_dedup", "op10_suffix_dedup"):
        assert Counter(r["doc_id"] for r in out[name]) == Counter(d[0] for d in docs), name
    assert {r["doc_id"] for r in out["op1_packing"]} == {d[0] for d in docs}
    assert [r["n_chars"] for r in sorted(out["op4_html_extraction"], key=lambda r: r["page_id"])] == [0, 4, 4]
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out["op7_top_k"]} == {(0, 1, 100, 131072), (0, 2, 1, 256 * 64 - 128 * 1024), (100, 1, 0, 131072), (100, 2, 1, 512 * 64)}
    crc = {(r["doc_id"], r["size"], r["text_crc32"]) for r in out["op6_sharding"]}
    assert crc == {(d[0], len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in docs}


def test_pipeline_of_empty_and_awkward_tables(spark, tmp_path):
    empty = write(spark, tmp_path / "empty")
    assert corpus_pipeline.run(spark, empty).count() == 0
    docs = [(0, None, None, None, None), (0, None, None, None, None), (None, "", None, None, None), (None, None, "en", "s", 0)]
    text = " ".join(f"word{k}" for k in range(80))
    docs += [(5, text, None, None, None)] * 3 + [(None, text, None, None, None), (6, text + " tail", None, None, 3)]
    folder = write(spark, tmp_path / "odd", documents=docs)
    rows = spark.read.parquet(f"{folder}/documents.parquet").withColumn("key", F.lit("clash")).withColumn("_key", F.lit(1)).withColumn("kept", F.lit(None).cast("boolean"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, folder)
        assert k == 4 or out.columns == rows.columns
        assert stage(spark, rows.limit(0), folder).count() == 0
        rows = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.run(spark, folder).agg(F.countDistinct("doc_id")).first()[0] <= 1


# -- equality is that of bytes ------------------------------------------------------------------------


def test_polynomials_alone_would_take_them_for_equal():
    a, b = thue_morse(1024)
    data = np.frombuffer((a + b).encode(), np.uint8)
    start, end = np.array([0, 1024]), np.array([1024, 2048])
    with pytest.raises(ValueError):
        ShortSpans(data).hash(start, end)
    one, two = Spans(data).hash(start, end)
    assert one != two


def test_names_are_those_of_the_bytes(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 3000)
    end = start + rng.integers(0, 9, 3000)
    raw = [data[a:b].tobytes() for a, b in zip(start, end)]
    for weak in (False, True):
        if weak:  # nearly every hash collides
            monkeypatch.setattr(Spans, "hash", lambda self, a, b: ((b - a) % 3).astype(np.uint64))
        name, first = names_of(data, start, end)
        assert len(set(zip(raw, name.tolist()))) == len(set(raw)) == len(set(name.tolist())) == len(first)
        assert all(raw[first[n]] == r for n, r in zip(name, raw))
    assert same_spans(data, start, start, end - start).all()
    other = start[::-1]
    size = np.minimum(end - start, 3999 - other)
    assert same_spans(data, start, other, size, long_=4).tolist() == same_spans(data, start, other, size).tolist() == [data[a : a + n].tobytes() == data[b : b + n].tobytes() for a, b, n in zip(start, other, size)]


def test_counts_do_not_rest_on_the_hash(monkeypatch):
    rng = random.Random(7)
    lines = [" ".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(1, 9))) for _ in range(12)]
    texts = ["\n".join(rng.choices(lines, k=30)) for _ in range(4)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    want = quality_rules.base_counts(data, at, quality_rules.Rules())
    for t, dup, repeat in zip(texts, want["n_dup_lines"], want["n_repeat_words"]):
        w = t.split()
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        assert dup == 30 - len(set(t.split("\n"))) and repeat == len({j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})
    monkeypatch.setattr(Spans, "hash", lambda self, a, b: ((b - a) % 2).astype(np.uint64))
    got = quality_rules.base_counts(data, at, quality_rules.Rules())
    assert all(np.array_equal(want[k], got[k]) for k in want)


def test_lines_and_words_that_hash_alike_stay_apart(spark):
    a, b = thue_morse(1024)
    docs = spark.createDataFrame([(0, f"{a}\n{b}\n{a}"), (1, f"{a} {b}")], "doc_id long, text string")
    model = quality_rules.fit(docs, spark.createDataFrame([(0, 1)], "doc_id long, quality int"))
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality_rules.result(docs, model).collect()} == {0: 1, 1: 0}
    import public_tokenizers

    pieces = sentence_pieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    for r in sentence_pieces.transcode(docs, pieces).collect():
        assert r["decoded"] == (f"{a}\n{b}\n{a}", f"{a} {b}")[r["doc_id"]]
    spaced = [f"x{t}x" for t in thue_morse(1024, "a ")]
    data = np.frombuffer("".join(spaced).encode(), np.uint8)
    row, _, n, ids, _, _ = paragraph_dedup._lines(paragraph_dedup.Words(data, np.array([0, 1026, 2052])), 5, 25)
    assert len(n) == 2 and ids[0] != ids[1]
    long_ = thue_morse(4096)
    lines = spark.createDataFrame([(k, t) for k, t in enumerate(long_)], "doc_id long, text string")
    out = suffix_dedup.dedup(lines).collect()
    count = Counter(t[k : k + 200] for t in long_ for k in range(4096 - 199))
    for r in out:
        gone = np.zeros(4096, bool)
        for k in range(4096 - 199):
            if count[long_[r["doc_id"]][k : k + 200]] > 1:
                gone[k : k + 200] = True
        assert sum(s["end"] - s["start"] for s in r["spans"]) == gone.sum()


# -- long texts -----------------------------------------------------------------------------------------


def test_a_million_spaces_are_packed(spark):
    docs = spark.createDataFrame([(0, " " * 1_000_000), (1, "word")], "doc_id long, text string")
    pieces = packing.pack(docs, queries.tokenizer_paths()).select("doc_id", "length").collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] == 0) == 1_000_001 and sum(r["length"] for r in pieces if r["doc_id"] == 1) == 2


def test_marginals_of_long_sequences_are_those_of_single_steps():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 2500, 3, 512, 513, 1025, 0, 700]
    at = np.cumsum([0, *sizes])
    odds, a = np.exp(rng.normal(size=at[-1]) * 4), np.exp(rng.normal(size=(2, 2)))
    want = np.empty_like(odds)
    for s, t in zip(at[:-1], at[1:]):
        for i in range(s, t):
            want[i] = odds[i] * (1.7 if i == s else (a[0, 1] + a[1, 1] * want[i - 1]) / (a[0, 0] + a[1, 0] * want[i - 1]))
    assert np.allclose(toxicity.odds_along(odds, at, a, 1.7), want, rtol=1e-9)


def test_millions_of_tokens_take_thousands_of_steps():
    steps = 0
    real = toxicity.in_steps

    def counted(*x):
        nonlocal steps
        for y in real(*x):
            steps += 1
            yield y

    toxicity.in_steps = counted
    try:
        chain = toxicity.Chain(np.zeros(2), np.zeros((2, 2)), 0.0, 0.0)
        marginal = chain.marginals(np.random.default_rng(0).normal(size=2_000_000), np.array([0, 2_000_000]))[0]
    finally:
        toxicity.in_steps = real
    assert steps < 4000 and len(marginal) == 2_000_000 and 0 < marginal.min() and marginal.max() < 1


def test_long_texts_are_judged_whole(spark):
    rng = random.Random(0)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200_000))
    docs = spark.createDataFrame([(0, text), (1, text[:600_000] + "!"), (2, "q" * 3_000_000)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in jaccard_join.join(docs).collect()}
    assert len({r["class_id"] for r in out.values()}) == 3
    removed = {r["doc_id"]: r["removed"] for r in paragraph_dedup.removals(docs).collect()}
    assert sum(x["end"] - x["start"] for x in removed[1]) > 85_000 and removed[0] == []
    counts = {r["doc_id"]: r["n_words"] for r in quality_rules.result(docs, quality_rules.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))).collect()}
    assert counts == {0: 200_000, 1: len(text[:600_000].split()), 2: 1}


# -- hot keys and large numbers -----------------------------------------------------------------------------


def test_copies_of_a_row_and_null_ids_are_dealt_out(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 3000, F.lit(7)).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("hot").alias("source"))
    out = sharding.shard(rows, shards=10, buckets=64).collect()
    assert Counter(r["shard"] for r in out) == {k: 600 for k in range(10)}
    assert all(Counter(r["doc_id"] for r in out if r["shard"] == k)[7] in range(230, 371) for k in range(10))


def test_sums_beyond_a_double_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([4e6, -4e6, 0.5, 3.0]) + rng.random() for _ in range(5)]) for i in range(40)] + [(100, [2.0**24, 1.0]), (101, [-(2.0**24)])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    used = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for q, mine in used:
        if q % 10 == 0 and q < 100:
            best = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in used if i != q)[:5]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    got = top_k.search(vectors, (F.col("id") % 10 == 0) & (F.col("id") < 100), block_rows=16)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == want
    with pytest.raises(Exception, match="a score is (less|greater) than a long"):
        top_k.search(spark.createDataFrame([(0, [2.0**60]), (1, [2.0**60])], "vec_id long, embedding array<double>"), F.col("id") == 0).collect()
    with pytest.raises(Exception, match="a score is (less|greater) than a long"):
        top_k.search(spark.createDataFrame([(0, [2.0**60]), (1, [-(2.0**60)])], "vec_id long, embedding array<double>"), F.col("id") == 0).collect()


def test_the_target_counts_every_trusted_row(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(50)], "doc_id long, quality int")
    both = [quality_rules.fit(docs, labels, quality_rules.Rules(broadcast_ids=n)).log_ratio for n in (0, 1000)]
    assert np.array_equal(*both)
