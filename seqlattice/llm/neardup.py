"""Near duplicates: what the similarity joins share.

Items are distinct sets of 64-bit shingles under a 64-bit id. Candidate finders put items into
buckets; an item of bucket k knows all its buckets, so a pair that meets in several is looked
at in one alone, the one of the smallest key (its owner), and links can be counted without a
pair ever being written out. A bucket of more than ``limit`` items is cut into blocks, and
every two blocks meet in a task of their own: no task holds more than about ``limit`` items,
and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, mix, mix_int

PAIRS_AT_ONCE = 1 << 17


def multipliers(n: int, seed: int) -> np.ndarray:
    return np.array([mix_int(seed * 0x10001 + k + 1) | 1 for k in range(n)], np.uint64)


def min_hashes(shingle: np.ndarray, row: np.ndarray, n_rows: int, factors: np.ndarray) -> np.ndarray:
    """uint32 [n_rows, len(factors)]; rows without shingles hold the largest value. row ascends."""
    out = np.full((n_rows, len(factors)), 0xFFFFFFFF, np.uint32)
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        for k, a in enumerate(factors):
            out[row[first], k] = np.minimum.reduceat((shingle * a) >> np.uint64(32), first)
    return out


def with_blocks(rows: DataFrame, limit: int) -> DataFrame:
    """rows(key, n, id, ...) with sub, the task's group, and part: -1 where all its pairs count, else the block."""
    blocks = F.when(F.col("n") > limit, F.ceil(F.col("n") * 2 / limit)).otherwise(1).cast("int")
    out = rows.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("id", "key"), F.col("_blocks")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    pair = F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other"))
    return out.withColumn("sub", F.when(F.col("_blocks") == 1, F.col("key")).otherwise(pair)).withColumn("part", F.when(F.col("_own") == F.col("_other"), -1).otherwise(F.col("_own"))).drop("_blocks", "_own", "_other", "n")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, limit: int = 16 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups from batches in which equal keys are adjacent."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if held and not cut and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() == keys[-1]:
            held.append(batch)
            continue
        if cut:
            held.append(batch.slice(0, cut))
            size += batch.nbytes
        if size >= limit or not cut:
            if held:
                yield pa.Table.from_batches(held)
            held, size = [], 0
        elif held:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def meeting(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key (a long) occurs twice at least; a row is held only until its neighbour is seen."""
    place = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met = None, False  # the last row so far, and whether it equals the one before it
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(place).to_numpy()
            same = np.r_[held is not None and held.column(place)[0].as_py() == keys[0], keys[1:] == keys[:-1]]
            if held is not None and (met or same[0]):
                yield held
            keep = same.copy()
            keep[:-1] |= same[1:]
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
            held, met = batch.slice(batch.num_rows - 1), bool(same[-1])
        if held is not None and met:
            yield held

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, rows.schema)


def pairs_within(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places i < j of one group (group: equal values adjacent), some at a time."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
    size = np.diff(np.r_[first, len(group)])
    for n in np.unique(size[(size > 1) & (size <= 64)]):
        i, j = np.triu_indices(n, 1)
        starts = first[size == n]
        step = max(1, PAIRS_AT_ONCE // len(i))
        for k in range(0, len(starts), step):
            at = starts[k : k + step, None]
            yield (at + i).ravel(), (at + j).ravel()
    for start, n in zip(first[size > 64], size[size > 64]):
        step = max(1, PAIRS_AT_ONCE // n)
        for k in range(0, n, step):
            i, j = np.meshgrid(np.arange(k, min(k + step, n)), np.arange(n), indexing="ij")
            keep = j > i
            yield start + i[keep], start + j[keep]


def padded(column: pa.ChunkedArray) -> np.ndarray:
    """A list<long> column as lines of equal length, short ones filled with values that occur in no other line."""
    lists = column.combine_chunks()
    at = lists.offsets.to_numpy()
    n = np.diff(at)
    out = -np.arange(1, len(n) + 1, dtype=np.int64)[:, None] - (np.int64(1) << 62) + np.zeros((1, max(int(n.max(initial=1)), 1)), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = lists.values.to_numpy()[at[0] : at[-1]]
    return out


def owned(keys: np.ndarray, key: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the smallest key that lines i and j share is the key of line i."""
    out = np.empty(len(i), bool)
    step = max(1, (1 << 22) // keys.shape[1] ** 2)
    for k in range(0, len(i), step):
        a, b = keys[i[k : k + step]], keys[j[k : k + step]]
        both = (a[:, :, None] == b[:, None, :]).any(axis=2)
        out[k : k + step] = np.where(both, a, np.iinfo(np.int64).max).min(axis=1) == key[i[k : k + step]]
    return out


def needed(members: DataFrame, least_matches: int) -> DataFrame:
    """The rows of members(key, sub, part, id, keys[, sketch]) that have a candidate partner that their bucket owns.

    sketch: uint32 min-hashes as binary; a candidate pair agrees in least_matches of them.
    """
    sketched = "sketch" in members.columns

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "sub"):
            sub, part, key = (table.column(c).to_numpy() for c in ("sub", "part", "key"))
            keys = padded(table.column("keys"))
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(len(sub), -1) if sketched else None
            hit = np.zeros(len(sub), bool)
            for i, j in pairs_within(sub):
                good = (part[i] < 0) | (part[i] != part[j])
                i, j = i[good], j[good]
                if sketched:
                    same = np.zeros(len(i), np.int16)
                    for k in range(sketch.shape[1]):
                        same += sketch[i, k] == sketch[j, k]
                    i, j = i[same >= least_matches], j[same >= least_matches]
                good = owned(keys, key, i, j)
                hit[i[good]] = hit[j[good]] = True
            yield from table.drop_columns(["sketch"] if sketched else []).filter(pa.array(hit)).to_batches()

    rows = members.repartition("sub").sortWithinPartitions("sub")
    return rows.mapInArrow(find, members.drop("sketch").schema)


def overlap_matrix(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, from posting lists; equal lists are added once."""
    m = len(sets)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    shingle = np.concatenate(sets) if m else np.empty(0, np.uint64)
    order = np.argsort(shingle, kind="stable")
    shingle, who = shingle[order], who[order]
    first = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]]) if len(shingle) else np.empty(0, np.int64)
    size = np.diff(np.r_[first, len(shingle)])
    out = np.zeros((m, m), np.int32)
    if len(first):
        name = np.add.reduceat(mix(who.astype(np.uint64) + np.uint64(1)), first)
        many = size > 1
        _, where, times = np.unique(name[many], return_index=True, return_counts=True)
        for start, n, c in zip(first[many][where], size[many][where], times):
            p = who[start : start + n]
            out[np.ix_(p, p)] += c
    return out


def verify(rows: DataFrame, threshold: float) -> DataFrame:
    """id, links, root from rows(key, sub, part, id, keys, shingles): exact Jaccard of every owned pair.

    links: similar pairs that the bucket owns and the item is in; root: the smallest id of
    the bucket that links lead to. shingles: sorted distinct uint64 as binary.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "sub"):
            sub, part, key, ids = (table.column(c).to_numpy() for c in ("sub", "part", "key", "id"))
            keys = padded(table.column("keys"))
            raw = table.column("shingles")
            first = np.flatnonzero(np.r_[True, sub[1:] != sub[:-1]])
            links, root = np.zeros(len(sub), np.int64), ids.copy()
            for a, b in zip(first, np.r_[first[1:], len(sub)]):
                _, once = np.unique(ids[a:b], return_index=True)
                at = a + once
                if len(at) < 2:
                    continue
                sets = [np.frombuffer(raw[int(x)].as_py(), np.uint64) for x in at]
                for x, y in similar_pairs(sets, threshold):
                    x, y = at[x], at[y]
                    good = ((part[x] < 0) | (part[x] != part[y])) & owned(keys, key, x, y)
                    x, y = x[good], y[good]
                    np.add.at(links, x, 1)
                    np.add.at(links, y, 1)
                    _join(root, ids, x, y, at)
            hit = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(root[hit])], ["id", "links", "root"])

    return rows.repartition("sub").sortWithinPartitions("sub").mapInArrow(check, "id long, links long, root long")


def similar_pairs(sets: list[np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = np.array([len(s) for s in sets])
    if len(sets) <= 24:
        i, j = np.triu_indices(len(sets), 1)
        able = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j])
        i, j = i[able], j[able]
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
        good = (both >= threshold * (size[i] + size[j] - both)) & (both > 0)
        yield i[good], j[good]
        return
    both = overlap_matrix(sets)
    for i in range(len(sets)):
        j = np.arange(i + 1, len(sets))
        good = (both[i, j] >= threshold * (size[i] + size[j] - both[i, j])) & (both[i, j] > 0)
        if good.any():
            yield np.full(good.sum(), i), j[good]


def _join(root: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> None:
    """Gives the linked places of a group the smallest root that links lead to."""
    while len(x):
        low = np.minimum(root[x], root[y])
        odd = (root[x] != low) | (root[y] != low)
        if not odd.any():
            return
        a = np.unique(np.stack([np.maximum(root[x], root[y])[odd], low[odd]], axis=1), axis=0)
        for big, small in a:  # as few as there are roots left to merge
            root[at[root[at] == big]] = min(small, root[at[ids[at] == small]].min(initial=small))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """u, v for every u of edges(u, v) but the smallest of its component, v: alternating large and small stars.

    Every round is one shuffle by u for each star and is written to the shared folder.
    """
    now = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = _signature(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = cut_lineage(small)
        after = _signature(now)
        if after == sign:
            return now
        sign = after
    raise RuntimeError("the components did not settle")


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def text_id(text: Column) -> Column:
    """The 64-bit id of a text: equal texts share it."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
