"""Substring dedup: paragraph MinHash banding.

A document's paragraphs are of two kinds, both runs of words. Lines: its \\n-split lines of at
least ``least_words`` words. Passages: runs of ``least_words`` words wherever a line begins or
ends, so that text within longer lines and short lines that follow each other are compared
too. A passage begins at each word whose n-gram has the least hash of ``stretch - least_words
+ 1`` n-grams in a row: two documents that share any ``stretch`` words in a row have a passage
in common for certain. A document of fewer than ``least_words`` words is one passage.

Equal paragraphs are one item from the start. The n-grams of a line are min-hashed, the hashes
cut into bands as wide as the target recall allows (``tune``), and lines that collide in a
band are compared by the exact Jaccard similarity of their n-grams; links make components, and
of each component only the first line, by document id and place, stays. Passages are too short
to differ and be similar, so their components are those of equal words; of each the first one
stays of those that lie outside the lines that go.

``least_words`` is a cut: a shorter line that repeats is not removed by itself, as single lines
of some words recur in documents that are not copies of each other.

Edge cases: a null or empty text has no paragraph. Rows equal in id and text are one document
and keep the same paragraphs; a null id comes first. A paragraph within a document that repeats
is removed like any other. Texts of any length are compared whole. An empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import GOLDEN, Spans, cut_lineage, lines_of, mix, shingles, stored, text_groups, words_of
from .neardup import components, meeting, min_hashes, multipliers, needed, verify, with_blocks

PLACE_BITS = 31
GROUP = 1 << 20  # bytes of text whose words are held at a time


def tune(hashes: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bands, rows a band): the most rows a band at which a pair of the threshold collides with probability recall."""
    able = [(hashes // r, r) for r in range(1, hashes + 1) if 1 - (1 - threshold**r) ** (hashes // r) >= recall]
    return max(able, key=lambda x: x[1]) if able else (hashes, 1)


class Words:
    """The words of a group of texts: start, end and row in the bytes, hash, and the first word of each row."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        self.start, self.end, self.row = words_of(data, at)
        self.hash = Spans(data).hash(self.start, self.end)
        self.row_at = np.searchsorted(self.row, np.arange(len(at)))


def _lines(w: Words, n: int, least: int) -> tuple[np.ndarray, ...]:
    """(row, first word, words, id, word n-grams, the line of each n-gram) of the long lines."""
    start, end, row = lines_of(w.data, w.at)
    line = np.searchsorted(start, w.start, side="right") - 1
    words = np.bincount(line, minlength=len(start))
    before = np.cumsum(words) - words
    long_ = words >= least
    number = np.cumsum(long_) - 1
    inside = long_[line]
    first, gram = shingles(w.hash[inside], number[line[inside]], n)
    ids = [blake2b(w.data[a:b], digest_size=8).digest() for a, b in zip(start[long_], end[long_])]
    row = row[long_]
    return row, before[long_] - w.row_at[row], words[long_], np.frombuffer(b"".join(ids), np.int64), gram, number[line[inside]][first]


def _passages(w: Words, n: int, size: int, stretch: int) -> tuple[np.ndarray, ...]:
    """(row, first word, words, id) of the passages."""
    have = np.diff(w.row_at)
    starts = np.maximum(have - size + 1, 0)  # words at which a passage of a row may begin
    row = np.repeat(np.arange(len(have)), starts)
    at = np.arange(len(row)) + np.repeat(w.row_at[:-1] - (np.cumsum(starts) - starts), starts)
    wide = stretch - size + 1
    chosen = np.zeros(len(row), bool)
    if len(row):
        gram = np.zeros(len(row), np.uint64)
        for k in range(min(n, size)):
            gram = mix(gram * np.uint64(GOLDEN) + w.hash[at + k])
        place_bits = np.uint64(PLACE_BITS)
        ranked = (gram >> place_bits << place_bits) | np.arange(len(row), dtype=np.uint64)
        blocks = -(-len(row) // wide) + 1
        grid = np.full(blocks * wide, np.iinfo(np.uint64).max, np.uint64)
        grid[: len(row)] = ranked
        grid = grid.reshape(blocks, wide)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        whole = np.flatnonzero(row[np.minimum(np.arange(len(row)) + wide - 1, len(row) - 1)] == row)
        whole = whole[whole + wide <= len(row)]
        low = np.minimum(behind[whole], ahead[whole + wide - 1])
        some = np.flatnonzero((starts > 0) & (starts < wide))  # rows of fewer places than that have one passage
        if len(some):
            begin = (np.cumsum(starts) - starts)[some]
            edges = np.stack([begin, begin + starts[some]], axis=1).ravel()
            least = np.minimum.reduceat(np.append(ranked, np.iinfo(np.uint64).max), edges)[::2]
            low = np.concatenate([low, least])
        chosen[(low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)] = True
    short = np.flatnonzero((have > 0) & (have < size))
    row = np.concatenate([row[chosen], short])
    first = np.concatenate([at[chosen], w.row_at[short]])
    words = np.minimum(have[row], size)
    ids = mix(words.astype(np.uint64))
    for k in range(size):
        more = words > k
        ids[more] = mix(ids[more] * np.uint64(GOLDEN) + w.hash[first[more] + k])
    return row, first - w.row_at[row], words, ids.view(np.int64)


def paragraphs(rows: DataFrame, *, n: int, least: int, stretch: int, hashes: int, bands: tuple[int, int], seed: int) -> DataFrame:
    """doc_id, key, first, words, id, bands (the band keys of a line, null for a passage), of (paragraphs of the document) of rows(doc_id, key, text)."""
    factors = multipliers(hashes, seed)
    kind = rows.schema["doc_id"].dataType.simpleString()
    b, r = bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, after, data, at in text_groups(batch.column(2), GROUP):
                w = Words(data, at)
                row, first, words, ids, gram, owner = _lines(w, n, least)
                low = min_hashes(gram, owner, len(ids), factors).astype(np.uint64)
                keys = np.empty((len(ids), b), np.uint64)
                for band in range(b):
                    key = np.full(len(ids), GOLDEN * (band + 1) & (1 << 64) - 1, np.uint64)
                    for k in range(band * r, band * r + r):
                        key = mix(key + low[:, k])
                    keys[:, band] = key
                p_row, p_first, p_words, p_ids = _passages(w, n, least, stretch)
                sizes = np.r_[np.full(len(ids), b), np.zeros(len(p_ids), np.int64)]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(keys.ravel().view(np.int64)), mask=pa.array(sizes == 0))
                row = np.r_[row, p_row]
                of = np.bincount(row, minlength=after - start)[row]
                who = pa.array(start + row)
                columns = [batch.column(0).take(who), batch.column(1).take(who), pa.array(np.r_[first, p_first].astype(np.int32)), pa.array(np.r_[words, p_words].astype(np.int32)), pa.array(np.r_[ids, p_ids]), lists, pa.array(of.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "first", "words", "id", "bands", "of"])

    return rows.select("doc_id", "key", "text").mapInArrow(run, f"doc_id {kind}, key long, first int, words int, id long, bands array<long>, of int")


def paragraph_sets(texts: DataFrame, n: int, least: int) -> DataFrame:
    """id, shingles (sorted distinct uint64) of the lines of texts(text, wanted) whose ids are wanted, once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, after, data, at in text_groups(batch.column(0), GROUP):
                row, _, _, ids, gram, owner = _lines(Words(data, at), n, least)
                cut = np.searchsorted(owner, np.arange(len(ids) + 1))
                asked = {(k, x) for k, some in enumerate(batch.column(1).slice(first, after - first).to_pylist()) for x in some}
                use = []
                for k, x in enumerate(zip(row.tolist(), ids.tolist())):
                    if x in asked:
                        asked.discard(x)
                        use.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array([np.unique(gram[cut[k] : cut[k + 1]]).tobytes() for k in use], pa.binary())], ["id", "shingles"])

    return texts.select("text", "wanted").mapInArrow(run, "id long, shingles binary")


def _similar_lines(rows: DataFrame, lines: DataFrame, items: DataFrame, threshold: float, n: int, least: int, limit: int) -> DataFrame:
    """id, least (the first place of the component) of the lines that are similar to another one."""
    keys = cut_lineage(meeting(items.select(F.explode("bands").alias("key"), "id"), "key"))
    buckets = keys.join(keys.groupBy("key").agg(F.count("*").alias("n")), "key")
    members = buckets.groupBy("id").agg(F.collect_list(F.struct("key", "n")).alias("b"))
    members = members.select("id", F.transform("b", lambda b: b["key"]).alias("keys"), F.explode("b").alias("b")).select("id", "keys", "b.key", "b.n")
    pairs = cut_lineage(needed(with_blocks(members, limit), 0))
    holders = pairs.select("id").distinct().join(items, "id").groupBy("at.key").agg(F.collect_list("id").alias("wanted"))
    sets = paragraph_sets(rows.join(holders, "key"), n, least)
    links = cut_lineage(verify(pairs.join(sets, "id"), threshold))
    joined = components(links.select(F.col("id").alias("u"), F.col("root").alias("v")))
    roots = joined.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(joined.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
    grouped = roots.join(items.select("id", "at"), "id")
    return grouped.join(grouped.groupBy("root").agg(F.min("at").alias("least")), "root").select("id", "least")


def removals(docs: DataFrame, *, threshold: float = 0.8, n: int = 5, least_words: int = 25, stretch: int = 51, hashes: int = 32, recall: float = 0.999, limit: int = 1000, seed: int = 23, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id, key (of id and text), n_paragraphs, removed (runs of words, as
    the first word and the one after the last, from 0) and kept_in (the ids of the documents in
    which the first ones of the removed paragraphs stay).
    """
    bands = tune(hashes, threshold, recall)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(id_col).isNull(), text).alias("key"), text.alias("text"))
    found = stored(paragraphs(rows, n=n, least=least_words, stretch=stretch, hashes=hashes, bands=bands, seed=seed))
    place = F.struct("doc_id", "key", "first").alias("at")

    lines = found.where("bands is not null")
    items = cut_lineage(lines.groupBy("id").agg(F.min(place).alias("at"), F.count("*").alias("times"), F.first("bands").alias("bands")))
    similar = _similar_lines(rows, lines, items, threshold, n, least_words, limit)
    # what a hot id is joined with is written first, so that the join stands alone and can split it
    stays = cut_lineage(items.select("id", "at", "times").join(similar, "id", "left").where("times > 1 or least is not null").select("id", F.coalesce("least", "at").alias("stays")))
    gone = cut_lineage(lines.join(stays, "id").where("key <> stays.key or first <> stays.first").select("key", "first", "words", F.col("stays.doc_id").alias("kept_in")))

    passages = found.where("bands is null").select("id", "doc_id", "key", "first", "words")
    again = passages.join(cut_lineage(passages.groupBy("id").agg(F.count("*").alias("times")).where("times > 1").select("id")), "id")
    cut = gone.groupBy("key").agg(F.collect_set(F.struct("first", "words")).alias("cut"))
    apart = F.col("cut").isNull() | ~F.exists("cut", lambda x: (x["first"] < F.col("first") + F.col("words")) & (F.col("first") < x["first"] + x["words"]))
    again = cut_lineage(again.join(cut, "key", "left").where(apart).drop("cut"))
    more = again.join(cut_lineage(again.groupBy("id").agg(F.min(place).alias("stays"))), "id").where("key <> stays.key or first <> stays.first")
    gone = gone.unionByName(more.select("key", "first", "words", F.col("stays.doc_id").alias("kept_in")))

    before = W.partitionBy("key").orderBy("first", "end")
    runs = gone.select("key", "first", (F.col("first") + F.col("words")).alias("end")).distinct()
    runs = runs.withColumn("new", F.coalesce(F.col("first") > F.max("end").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(True)))
    runs = runs.withColumn("run", F.sum(F.col("new").cast("int")).over(before)).groupBy("key", "run").agg(F.min("first").alias("start"), F.max("end").alias("end"))
    cuts = runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    kept = gone.select("key", "kept_in").distinct().groupBy("key").agg(F.sort_array(F.collect_list("kept_in")).alias("kept_in"))
    many = found.groupBy("key").agg(F.max("of").alias("of"))
    out = rows.select("doc_id", "key").join(many, "key", "left").join(cuts.join(kept, "key", "left"), "key", "left")
    return out.select(F.col("doc_id").alias(id_col), "key", F.coalesce("of", F.lit(0)).cast("long").alias("n_paragraphs"), F.coalesce("removed", F.array().cast("array<struct<start:int,end:int>>")).alias("removed"), F.coalesce("kept_in", F.array().cast(f"array<{kind}>")).alias("kept_in"))


def _without(text: str, runs: list[dict]) -> str:
    """text without runs of words and the white space after them; at the end of the text, before them."""
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = words_of(data, np.array([0, len(data)]))
    keep, raw, at = [], data.tobytes(), 0
    for r in runs:
        last = r["end"] >= len(start)
        keep.append(raw[at : (end[r["start"] - 1] if r["start"] and last else start[r["start"]])])
        at = len(raw) if last else start[r["end"]]
    return b"".join([*keep, raw[at:]]).decode()


def apply(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed paragraphs cut out of their texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("_key", F.xxhash64(F.col(id_col), F.col(id_col).isNull(), text))
    out = keyed.join(removed.select(F.col("key").alias("_key"), F.col("removed").alias("_removed")).where("size(_removed) > 0").dropDuplicates(["_key"]), "_key", "left")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if r is None else _without(t, r) for t, r in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    names = docs.columns
    return out.select(*[F.col(f"`{c}`") for c in names], "_removed").mapInArrow(run, docs.schema)
