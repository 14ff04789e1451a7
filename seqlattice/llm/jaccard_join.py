"""N-gram Jaccard join: chosen-path join over sets of word shingles.

Each distinct text is the set of its word n-grams, sketched by min-hashes. A run begins at a
root that holds all sets. A node chooses 1/similarity of the sketch's coordinates on average
(by a hash of its path) and sends each set to the child of its value there: sets that share
the sampled token stay together. A node of at most ``limit`` sets is a bucket, compared by
brute force. A pair of exactly the threshold's similarity shares a child with probability
0.84; ``runs_for`` derives the repetitions that reach a recall at a number of levels. The runs
over all sets are 2 levels deep. A larger node of at most ``BLOCKS`` times the limit is
compared in blocks that meet pairwise (neardup), which loses nothing. Only the sets of nodes
beyond that begin anew, with the runs that ``depth`` levels need, and what is large after those
is compared in blocks too. Either part may miss half of what the target recall allows. As links
are counted, a group of n different texts that are all similar costs n * n comparisons of
sketches, dealt out in tasks of ``limit`` sets.

Edge cases: null and empty texts are equal texts. A text of fewer than n words has no n-gram
and links to nothing; equal texts are one class whatever their length. Repeated rows are
copies. A null id keeps its row; a class of null ids only has a null class id. An empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, cut_lineage, mix, mix_int, shingles, text_groups, words_of
from .neardup import components, min_hashes, multipliers, needed, text_id, verify, with_blocks


BLOCKS = 32


def runs_for(similarity: float, recall: float, levels: int = 2, size: int = 64) -> int:
    """Repetitions after which a pair of this similarity has met in a bucket `levels` deep with probability recall.

    The runs share one sketch: the pair agrees in a binomial number of its `size` coordinates.
    """
    one, rest = divmod(1 / similarity, 1)
    cases = []
    for k in range(size + 1):
        p, apart = math.comb(size, k) * similarity**k * (1 - similarity) ** (size - k), 1 - k / size
        stay = (1 - rest) * (1 - apart**one) + rest * (1 - apart ** (one + 1))
        cases.append((p, 1 - stay**levels))
    runs = 1
    while sum(p * miss**runs for p, miss in cases) > 1 - recall:
        runs += 1
    return runs


def children(path: np.ndarray, sketch: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child's path) of the children of node path[i] that set i goes to."""
    rows, keys = [], []
    wide = np.uint64(sketch.shape[1])
    share = 1 / similarity
    extra = mix(path ^ np.uint64(0xA5)) >> np.uint64(11)
    n = math.floor(share) + (extra < np.uint64(int((share % 1) * (1 << 53))))
    for k in range(int(n.max(initial=0))):
        at = np.flatnonzero(n > k)
        coordinate = (mix(path[at] + np.uint64(0x1000 + k)) % wide).astype(np.int64)
        if k:  # a second coordinate is another one
            clash = coordinate == (mix(path[at] + np.uint64(0x1000)) % wide).astype(np.int64)
            coordinate = np.where(clash, (coordinate + 1) % int(wide), coordinate)
        value = sketch[at, coordinate].astype(np.uint64)
        rows.append(at)
        keys.append(mix(mix(path[at] + np.uint64(7)) + (coordinate.astype(np.uint64) << np.uint64(32)) + value))
    return (np.concatenate(rows), np.concatenate(keys)) if rows else (np.empty(0, np.int64), np.empty(0, np.uint64))


def _sketch_array(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(n, -1)


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int, size: int, seed: int) -> DataFrame:
    """doc_id, id (of the text), n_shingles, sketch (null without shingles) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    factors = multipliers(size, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, after, data, at in text_groups(batch.column(2)):
                start, end, row = words_of(data, at)
                where, gram = shingles(Spans(data).hash(start, end), row, n)
                rows = after - first
                count = np.bincount(row[where], minlength=rows)
                sketch = min_hashes(gram, row[where], rows, factors)
                packed = pa.array([s.tobytes() if c else None for s, c in zip(sketch, count)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), batch.column(1).slice(first, rows), pa.array(count.astype(np.int32)), packed], ["doc_id", "id", "n_shingles", "sketch"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_id(F.col(text_col)).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, id long, n_shingles int, sketch binary")


def shingle_sets(texts: DataFrame, n: int) -> DataFrame:
    """id, shingles (sorted distinct uint64) of rows(id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, after, data, at in text_groups(batch.column(1)):
                start, end, row = words_of(data, at)
                where, gram = shingles(Spans(data).hash(start, end), row, n)
                cut = np.searchsorted(row[where], np.arange(after - first + 1))
                packed = [np.unique(gram[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, after - first), pa.array(packed, pa.binary())], ["id", "shingles"])

    return texts.mapInArrow(run, "id long, shingles binary")


def join(docs: DataFrame, *, threshold: float = 0.8, n: int = 5, recall: float = 0.999, size: int = 64, limit: int = 1000, depth: int = 5, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id, text_id, class_key, class_id, n_links, n_copies.

    class_key: the smallest text_id of the class; class_id: the smallest id of the rows whose texts are joined to this one by equality or by
    links (similarity >= threshold); n_links: the different texts that this text links to;
    n_copies: the rows with this text.
    """
    rows = cut_lineage(sketches(docs, id_col, text_col, n, size, seed))
    texts = cut_lineage(rows.groupBy("id").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"), F.first("sketch").alias("sketch")))
    sets = texts.where("sketch is not null").select("id", "sketch")
    buckets = _buckets(sets, threshold, recall, size, limit, depth, seed)
    members = buckets.groupBy("id").agg(F.collect_list(F.struct("key", "n")).alias("b")).join(sets, "id")
    members = members.select("id", "sketch", F.transform("b", lambda b: b["key"]).alias("keys"), F.explode("b").alias("b")).select("id", "sketch", "keys", "b.key", "b.n")
    deviation = math.sqrt(threshold * (1 - threshold) / size)
    pairs = cut_lineage(needed(with_blocks(members, limit), math.floor(size * (threshold - 5 * deviation))))
    holder = lambda c: F.xxhash64(c, F.col(c).isNull()).alias("_holder")  # noqa: E731  null ids hold texts too
    asked = pairs.select("id").distinct().join(texts, "id").select("id", holder("first"))
    source = docs.select(holder(id_col), text_id(F.col(text_col)).alias("id"), F.col(text_col).alias("text"))
    wanted = source.join(asked, ["_holder", "id"], "left_semi").select("id", "text")
    links = cut_lineage(verify(pairs.join(shingle_sets(wanted, n), "id"), threshold))
    joined = components(links.select(F.col("id").alias("u"), F.col("root").alias("v")))
    roots = joined.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(joined.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
    grouped = roots.join(texts.select("id", "first"), "id")
    least = grouped.groupBy("root").agg(F.min("first").alias("least"))
    degree = links.groupBy("id").agg(F.sum("links").alias("n_links"))
    linked = grouped.join(least, "root").select("id", "root", "least").join(degree, "id", "left")
    known = texts.join(linked, "id", "left").select("id", F.coalesce("root", "id").alias("class_key"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return rows.select("doc_id", "id").join(known, "id").select(F.col("doc_id").alias(id_col), F.col("id").alias("text_id"), "class_key", "class_id", "n_links", "n_copies")


def _buckets(sets: DataFrame, similarity: float, recall: float, size: int, limit: int, depth: int, seed: int, first_run: int = 0, levels: int = 2) -> DataFrame:
    """key, n, id of the memberships of buckets of two sets at least; nodes of over BLOCKS times the limit after `levels` are split anew, `depth` deep."""
    levels = min(levels, depth)
    runs = runs_for(similarity, (1 + recall) / 2, levels, size)

    def split(batches: Iterator[pa.RecordBatch], root: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            ids, sketch = batch.column(0), _sketch_array(batch.column(1), m)
            for run in range(first_run, first_run + runs) if root else (0,):
                path = np.full(m, mix_int(seed * 1000 + run), np.uint64) if root else batch.column(2).to_numpy().view(np.uint64)
                at, key = children(path, sketch, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids.take(pa.array(at))], ["key", "id"])

    level = sets.mapInArrow(lambda b: split(b, True), "key long, id long")
    out = None
    for d in range(levels):
        counts = level.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        found = cut_lineage(level.join(counts, "key").select("key", "n", "id"))
        last = d == depth - 1
        most = limit if d < levels - 1 else BLOCKS * limit
        here = found if last else found.where(F.col("n") <= most)
        out = here if out is None else out.unionByName(here)
        large = found.where(F.col("n") > most)
        if last or large.isEmpty():
            return out
        if d < levels - 1:
            level = large.join(sets, "id").select("id", "sketch", "key").mapInArrow(lambda b: split(b, False), "key long, id long")
    again = cut_lineage(sets.join(large.select("id").distinct(), "id", "left_semi"))
    return out.unionByName(_buckets(again, similarity, recall, size, limit, depth, seed, first_run + runs, depth))
