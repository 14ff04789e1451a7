"""Quality rules: word and line rules, then a hashed n-gram likelihood ratio.

Two multinomials over hashed byte n-grams are counted: one over the trusted target (all rows
labelled good) and one over the whole raw corpus. A
document's score is its log-likelihood under the first less that under the second, divided
by its number of n-grams; every document is held against one fixed threshold. Byte n-grams
rather than word n-grams: one shared bucket space then serves texts of any script and words
never seen before.

Edge cases: a null or empty text has no words and no n-grams, scores 0 and fails the base
rules. Repeated rows and ids are each judged on their own; every row of a trusted id counts
for the target. Words and lines are equal if their bytes are. Texts of any length are counted
whole. An empty table gives an empty result; with no trusted rows every ratio is 1 and only
the base rules decide; null ids and labels are not trusted. Of the input
only the named id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, lines_of, mix, names_of, per_row, same_spans, shingles, text_groups, words_of

#: The symbols that the symbol count counts.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Parameters. order: bytes of an n-gram; bits: 2**bits buckets; prior: pseudo-counts that draw
    a bucket's ratio to 1; broadcast_ids: up to so many trusted ids are broadcast, more are joined
    by a shuffle (with the same counts)."""

    order: int = 3
    bits: int = 16
    prior: float = 5.0
    threshold: float = -0.4
    least_words: int = 10
    most_repeat_percent: int = 20
    window: int = 5
    broadcast_ids: int = 500_000


def buckets_of(data: np.ndarray, at: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every n-gram that lies within one text."""
    n = len(data) - rules.order + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    whole = np.zeros(n, np.uint64)
    for k in range(rules.order):
        whole = whole * np.uint64(257) + data[k : k + n] + np.uint64(1)
    bucket = (mix(whole) >> np.uint64(64 - rules.bits)).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    inside = np.arange(n) + rules.order <= at[1:][row]
    return bucket[inside], row[inside]


def base_counts(data: np.ndarray, at: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    n = len(at) - 1
    start, end, row = words_of(data, at)
    n_words = per_row(row, n)
    begins = np.cumsum(np.concatenate([[0], (data & 0xC0) != 0x80]))
    chars = per_row(row, n, begins[end] - begins[start]).astype(np.int64)
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    spans = Spans(data)
    first, gram = shingles(spans.hash(start, end), row, rules.window)
    covered = np.zeros(len(row) + 1, np.int64)
    if len(first):
        key = mix(gram + row[first].astype(np.uint64))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        if not _same_words(data, start, end, row, first[order[1:][same]], first[order[:-1][same]], rules.window):  # one hash for unequal words
            word, _ = names_of(data, start, end)
            _, gram = shingles(mix(word.astype(np.uint64) + np.uint64(1)), row, rules.window)
            key = mix(gram + row[first].astype(np.uint64))
            order = np.argsort(key)
            same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hits = first[twice]
        np.add.at(covered, hits, 1)
        np.add.at(covered, hits + rules.window, -1)
    repeated = np.cumsum(covered)[:-1] > 0
    line_start, line_end, line_row = lines_of(data, at)
    word_before = np.concatenate([[0], np.cumsum(np.bincount(start, minlength=len(data)))]) if len(data) else np.zeros(1, np.int64)
    full = word_before[line_end] > word_before[line_start]
    line_start, line_end, line_row = line_start[full], line_end[full], line_row[full]
    line = mix(spans.hash(line_start, line_end) + line_row.astype(np.uint64))
    order = np.argsort(line, kind="stable")
    a, b = order[1:][again := line[order[1:]] == line[order[:-1]]], order[:-1][again]
    size = line_end - line_start
    if not ((line_row[a] == line_row[b]) & (size[a] == size[b])).all() or not same_spans(data, line_start[a], line_start[b], size[a]).all():
        name, firsts = names_of(data, line_start, line_end)
        line = line_row * max(len(firsts), 1) + name
    _, back = np.unique(line, return_index=True)
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": symbols[at[1:]] - symbols[at[:-1]],
        "n_dup_lines": per_row(line_row, n) - per_row(line_row[back], n),
        "n_repeat_words": per_row(row[repeated], n),
    }


def _same_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> bool:
    """Whether all windows of words a[i].. and b[i].. are of one text and equal by their bytes."""
    good = row[a] == row[b]
    for k in range(window):
        size = end[a + k] - start[a + k]
        good &= size == end[b + k] - start[b + k]
        if not good.all() or not same_spans(data, start[a + k], start[b + k], size).all():
            return False
    return True


@dataclass(frozen=True)
class Ratio:
    """A fitted model: the log ratio of each bucket."""

    log_ratio: np.ndarray
    rules: Rules

    def verdicts(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """The columns that result() adds, for every text."""
        parts = []
        for first, after, data, at in text_groups(texts):
            n, rules = after - first, self.rules
            out = base_counts(data, at, rules)
            bucket, row = buckets_of(data, at, rules)
            grams = per_row(row, n)
            out["llr"] = per_row(row, n, self.log_ratio[bucket]) / np.maximum(grams, 1)
            out["base_failed"] = (out["n_words"] < rules.least_words) | (100 * out["n_repeat_words"] > rules.most_repeat_percent * out["n_words"])
            out["kept"] = ~out["base_failed"] & (out["llr"] >= rules.threshold)
            parts.append(out)
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def fit(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ratio:
    """Counts both multinomials in one pass over all of docs; what is collected is one row a bucket."""
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("id")).where("id is not null").distinct().withColumn("trusted", F.lit(True))
    if trusted.limit(rules.broadcast_ids + 1).count() <= rules.broadcast_ids:
        trusted = F.broadcast(trusted)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(trusted, "id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    size = 1 << rules.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False)
            for first, _, data, at in text_groups(batch.column(0)):
                bucket, row = buckets_of(data, at, rules)
                raw += np.bincount(bucket, minlength=size)
                target += np.bincount(bucket[good[first + row]], minlength=size)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(target[seen]), pa.array(raw[seen])], ["bucket", "target", "raw"])

    counts = rows.mapInArrow(count, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas()
    target, raw = np.zeros(size), np.zeros(size)
    target[counts["bucket"]], raw[counts["bucket"]] = counts["target"], counts["raw"]
    expected = raw * (target.sum() / max(raw.sum(), 1))
    log_ratio = np.log((target + rules.prior) / (expected + rules.prior))
    return Ratio(log_ratio.astype(np.float32), rules)


def result(docs: DataFrame, model: Ratio, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, the counts, the ratio and both verdicts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = model.verdicts(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k]) for k in NAMES)], [id_col, *NAMES])

    return docs.select(id_col, text_col).mapInArrow(judge, f"{id_col} {kind}, " + ", ".join(f"{k} {v}" for k, v in zip(NAMES, KINDS)))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
KINDS = ("long", "long", "long", "long", "long", "boolean", "boolean", "double")


def keep(docs: DataFrame, model: Ratio, text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.verdicts(batch.column(batch.schema.get_field_index(text_col)))["kept"]))

    return docs.mapInArrow(only, docs.schema)
