"""Suffix-array dedup: bytes covered by a 200-byte string that also starts elsewhere go.

The suffixes of all texts are sorted in shards, each by external induced sorting with common
prefixes (induced_sorting). Shards are made so that equal 200-byte strings meet: a string's
anchor is the least hash of its 80-byte grams, and consecutive strings with the same anchor
make a piece, a text of their bytes that goes to the shard of the anchor's hash. Equal strings
have equal anchors, so two suffixes of a shard with a common prefix of 200 bytes are all that
has to be found, and none is missed.

Before texts move, pieces are compared by hash alone: an anchor that occurs once is dropped;
a piece that occurs twice or more repeats in full and is sorted only once, if the same anchor
has other pieces; the last case alone needs sorting. So copies by the thousand are one piece,
and the shards hold the pieces at the edges of repeats.

A shard is the pieces of some anchors, ``shard_bytes`` on average. An anchor whose different
pieces are more than that by themselves (a phrase in as many surroundings) is in no shard: the
strings of its pieces, 121 a piece at most, are counted by a 128-bit digest instead, with
partial sums before the shuffle, so that no task has to hold them together.

Edge cases: a null text is empty; texts under 200 bytes keep all. Repeated rows are repeats of
each other and lose everything from 200 bytes on. Overlapping repeats within a text count. An
empty table gives an empty result. Only the named columns are read, so others may have any
name. What is left may begin or end within a character: it is returned as bytes. Texts of any
length are taken whole, ``CHUNK`` strings at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ShortSpans, cut_lineage, text_groups
from .induced_sorting import CAP, sort_suffixes
from .neardup import meeting, whole_groups

LENGTH = CAP  # bytes of a string
GRAM = 80
PLACE_BITS = 28
SHARD_BYTES = 2 << 20
CHUNK = 16 << 20


def anchors_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first string, number of strings, place of the anchor in the first, anchor hash, piece hash) of all pieces.

    Strings are those of LENGTH bytes within one text; places count from the text's start.
    """
    none = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),) * 2
    n = len(data) - GRAM + 1
    if len(data) < LENGTH:
        return none
    spans = ShortSpans(data)
    place = np.arange(n)
    gram = spans.hash(place, place + GRAM)
    ranked = (gram >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | place.astype(np.uint64)
    wide = LENGTH - GRAM + 1
    blocks = -(-n // wide) + 1
    grid = np.full(blocks * wide, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = ranked
    grid = grid.reshape(blocks, wide)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(data) - LENGTH + 1
    anchor = (np.minimum(behind[:m], ahead[wide - 1 : wide - 1 + m]) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:m]
    valid = np.flatnonzero(np.arange(m) + LENGTH <= at[1:][row])
    if not len(valid):
        return none
    new = np.ones(len(valid), bool)
    new[1:] = (anchor[valid[1:]] != anchor[valid[:-1]]) | (row[valid[1:]] != row[valid[:-1]])
    heads = np.flatnonzero(new)
    first = valid[heads]
    count = np.diff(np.r_[heads, len(valid)])
    return row[first], first - at[row[first]], count, anchor[first] - first, gram[anchor[first]], spans.hash(first, first + count + LENGTH - 1)


def pieces_of(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """anchor, key, first, strings, shift, piece of rows(key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, data, at in text_groups(batch.column(1)):
                for skipped in range(0, max(len(data) - LENGTH, 0) + 1, chunk) if len(at) == 2 else (0,):
                    whole = (data, at) if len(at) > 2 else (part := data[skipped : skipped + chunk + LENGTH - 1], np.array([0, len(part)]))
                    row, first, count, shift, anchor, piece = anchors_of(*whole)
                    if not len(row):
                        continue
                    first += skipped
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), batch.column(0).take(pa.array(start + row)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(shift.astype(np.int32)), pa.array(piece.view(np.int64))], ["anchor", "key", "first", "strings", "shift", "piece"])

    return rows.select("key", "text").mapInArrow(run, "anchor long, key long, first int, strings int, shift int, piece long")


def _ranges(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def repeats_in(texts: list[bytes], folder: str | None = None) -> list[np.ndarray]:
    """For each text, which of its LENGTH-byte strings also start elsewhere in the texts."""
    size = np.array([len(t) for t in texts])
    at = np.cumsum(np.r_[0, size + 1])
    text = np.zeros(at[-1] + 1, np.uint16)  # 0 ends all, 1 each text, bytes are 2 and up
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    text[:-1] = data.astype(np.uint16) + 2
    text[at[1:] - 1] = 1
    hit = np.zeros(len(text), bool)
    above = 0  # common prefix of the first tuple of a part with the larger one before it
    for place, lcp in sort_suffixes(text, 258, folder):
        if len(place):
            hit[place[(lcp >= LENGTH) | (np.r_[above, lcp[:-1]] >= LENGTH)]] = True
            above = int(lcp[-1])
    return [hit[a : a + max(n - LENGTH + 1, 0)] for a, n in zip(at, size)]


def sorted_shards(pieces: DataFrame) -> DataFrame:
    """anchor, piece, shift, strings, ranges (of strings that repeat) from rows(shard, anchor, piece, shift, strings, times, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "shard"):
            shard = table.column("shard").to_numpy()
            heads = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            ranges: list[list[dict]] = []
            for a, b in zip(heads, np.r_[heads[1:], len(shard)]):
                part = table.slice(a, b - a)
                found = repeats_in(part.column("bytes").to_pylist())
                ranges += [_ranges(np.ones_like(f) if n > 1 else f) for f, n in zip(found, part.column("times").to_numpy())]
            out = table.select(["anchor", "piece", "shift", "strings"]).append_column("ranges", pa.array(ranges, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield from out.filter(pa.array([bool(r) for r in ranges])).to_batches()

    return pieces.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "anchor long, piece long, shift int, strings int, ranges array<struct<start:int,end:int>>")


def counted_strings(wanted: DataFrame) -> DataFrame:
    """anchor, piece, shift, strings, ranges (of strings that repeat) of the pieces that rows(text, wanted) ask for, by counting digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, asked in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode("utf-8")
                rows = [(w["anchor"], w["piece"], w["shift"], w["strings"], w["times"], k, blake2b(raw[w["first"] + k : w["first"] + k + LENGTH], digest_size=16).digest()) for w in asked.as_py() for k in range(w["strings"])]
                for k in range(0, len(rows), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + (1 << 16)]), (*TYPES[1:6], pa.int32(), pa.binary()))], [*NAMES[1:6], "at", "digest"])

    strings = cut_lineage(wanted.mapInArrow(run, "anchor long, piece long, shift int, strings int, times long, at int, digest binary"))
    twice = cut_lineage(strings.groupBy("digest").agg(F.sum("times").alias("n")).where("n > 1").select("digest"))
    return strings.join(twice, "digest").groupBy(*PIECE).agg(F.collect_list(F.struct(F.col("at").alias("start"), (F.col("at") + 1).alias("end"))).alias("ranges"))


def _cut_pieces(wanted: DataFrame, shards: int) -> DataFrame:
    """The bytes of the pieces that rows(text, wanted) ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for text, asked in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode("utf-8")
                for w in asked.as_py():
                    part = raw[w["first"] : w["first"] + w["strings"] + LENGTH - 1]
                    rows.append((w["anchor"] % shards, w["anchor"], w["piece"], w["shift"], w["strings"], w["times"], part))
                    size += len(part) + 64
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], NAMES)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], NAMES)

    return wanted.mapInArrow(run, "shard long, anchor long, piece long, shift int, strings int, times long, bytes binary")


NAMES = ["shard", "anchor", "piece", "shift", "strings", "times", "bytes"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
PIECE = ["anchor", "piece", "shift", "strings"]


def repeat_ranges(rows: DataFrame, shard_bytes: int = SHARD_BYTES, chunk: int = CHUNK) -> DataFrame:
    """key, ranges (start, end in bytes, in any order) of the repeated bytes of rows(key, text)."""
    found = cut_lineage(meeting(pieces_of(rows, chunk), "anchor"))
    kinds = found.groupBy(*PIECE).agg(F.count("*").alias("times"), F.min(F.struct("key", "first")).alias("at"))
    kinds = cut_lineage(kinds.join(found.groupBy("anchor").agg((F.min(F.struct("piece", "shift", "strings")) != F.max(F.struct("piece", "shift", "strings"))).alias("several")), "anchor"))
    unsure = kinds.where("several").select(*PIECE, "times", "at.key", "at.first")
    total = unsure.agg(F.sum(F.col("strings") + LENGTH).alias("n")).first()["n"] or 0
    hot = cut_lineage(unsure.groupBy("anchor").agg(F.sum(F.col("strings") + LENGTH).alias("n")).where(F.col("n") > shard_bytes).select("anchor", F.lit(True).alias("hot")))
    some_hot = not hot.isEmpty()
    unsure = cut_lineage(unsure.join(hot, "anchor", "left")) if some_hot else unsure.withColumn("hot", F.lit(None))
    request = F.collect_list(F.struct("first", *PIECE, "times")).alias("asked")
    asked = unsure.where("hot is null").groupBy("key").agg(request)
    cut = _cut_pieces(rows.join(asked, "key").select("text", "asked"), max(1, math.ceil(total / shard_bytes)))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("strings").alias("end")))
    known = sorted_shards(cut)
    if some_hot:
        known = known.unionByName(counted_strings(rows.join(unsure.where("hot").groupBy("key").agg(request), "key").select("text", "asked")))
    known = known.unionByName(kinds.where(~F.col("several")).select(*PIECE, whole.alias("ranges")))
    spans = F.transform("ranges", lambda r: F.struct((F.col("first") + r["start"]).alias("start"), (F.col("first") + r["end"] - 1 + LENGTH).alias("end")))
    return found.join(known, PIECE).select("key", F.explode(spans).alias("span")).groupBy("key").agg(F.collect_list("span").alias("ranges"))


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, chunk: int = CHUNK) -> DataFrame:
    """id, key (of id and text), n_bytes, spans (start, end of removed runs, in bytes) and kept (binary) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(id_col).isNull(), text).alias("key"), text.alias("text"))
    ranges = cut_lineage(repeat_ranges(rows, shard_bytes, chunk))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, spans, kept = [], [], []
            for text, found in zip(batch.column(2), batch.column(3)):
                raw = text.as_py().encode("utf-8")
                runs = merged(found.as_py())
                cuts = [0, *(x for r in runs for x in r), len(raw)]
                size.append(len(raw))
                spans.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], [id_col, "key", "n_bytes", "spans", "kept"])

    return rows.join(ranges, "key", "left").select("doc_id", "key", "text", "ranges").mapInArrow(run, f"{id_col} {kind}, key long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs with the repeated bytes cut out of their texts, and with them the characters that lose a byte."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn("_key", F.xxhash64(F.col(id_col), F.col(id_col).isNull(), text))
    ranges = cut_lineage(repeat_ranges(keyed.select(F.col("_key").alias("key"), text.alias("text")), shard_bytes))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, found in zip(batch.column(place), batch.column(batch.num_columns - 1)):
                if found.is_valid:
                    raw, runs = text.as_py().encode("utf-8"), merged(found.as_py())
                    cuts = [0, *(x for r in runs for x in r), len(raw)]
                    texts.append("".join(raw[a:b].decode("utf-8", "ignore") for a, b in zip(cuts[::2], cuts[1::2])))
                else:
                    texts.append(text.as_py())
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    names = docs.columns
    joined = keyed.join(ranges.withColumnsRenamed({"key": "_key", "ranges": "_ranges"}), "_key", "left").select(*[F.col(f"`{c}`") for c in names], "_ranges")
    return joined.mapInArrow(run, docs.schema)
