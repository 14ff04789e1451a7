"""Packing: bounded-space online best-fit of token sequences into windows.

Every partition is read once and keeps a fixed number of open windows. A piece goes to the
open window whose free space it fills best. Where none has room and no further window may
open, the fullest one is emitted: the head of the piece fills it to the last token, and the
tail starts a window in its place. The windows still open at a partition's end are leftovers;
they are merged in groups of ``merge_partitions`` partitions, each a bounded number of tokens,
so that a group emits at most one window that is not full.

Edge cases: a null or empty text is one document of the end token alone. Texts longer than a
window fill whole windows first. Repeated rows and ids are packed once for each row. An empty
table gives an empty result. Only the named id and text columns are read.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

END_TOKEN = "<|endoftext|>"
END_TOKEN_ID = 50256


@lru_cache(maxsize=2)
def byte_bpe_encoder(ranks_path: str, json_path: str) -> Callable[[str], np.ndarray]:
    """text -> uint32 ids of the byte-level BPE.

    The rank file holds the same vocabulary as the JSON file and encodes about four times as
    fast; the JSON file is used for a text on which the faster library panics, such as a
    million spaces. The end token's
    string in a text is that one token in both.
    """
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, open(ranks_path, "rb"))}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_TOKEN: END_TOKEN_ID})

    def slow(text: str) -> list[int]:
        from tokenizers import Tokenizer

        return Tokenizer.from_file(json_path).encode(text, add_special_tokens=False).ids

    def encode(text: str) -> np.ndarray:
        try:
            ids = fast.encode(text, allowed_special="all") if END_TOKEN in text else fast.encode_ordinary(text)
        except BaseException as e:  # the library panics on some texts, which is no Exception; the other one gives the same ids
            if not isinstance(e, ValueError) and type(e).__name__ != "PanicException":
                raise
            ids = slow(text)
        return np.array(ids, np.uint32)

    return encode


@dataclass
class Window:
    number: int
    used: int = 0
    pieces: list[tuple[int, int, np.ndarray, int]] = field(default_factory=list)


class Packer:
    """The open windows of one partition. emit gets (window number, pieces) of each full window."""

    def __init__(self, size: int, most_open: int, emit: Callable[[Window], None], first: int = 0):
        self.size, self.most_open, self.emit, self.next = size, most_open, emit, first
        self.open: dict[int, Window] = {}
        self.free: list[tuple[int, int]] = []  # (free space, number), ascending

    def _put(self, w: Window, piece: tuple[int, int, np.ndarray, int]) -> None:
        w.pieces.append(piece)
        w.used += len(piece[2])
        if w.used == self.size:
            self.emit(w)
        else:
            self.open[w.number] = w
            insort(self.free, (self.size - w.used, w.number))

    def _new(self) -> Window:
        self.next += 1
        return Window(self.next - 1)

    def _take(self, k: int) -> Window:
        _, number = self.free.pop(k)
        return self.open.pop(number)

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.size:
            self._put(self._new(), (doc, start, ids[: self.size], total))
            start, ids = start + self.size, ids[self.size :]
        if not len(ids):
            return
        k = bisect_left(self.free, (len(ids), -1))
        if k < len(self.free):
            self._put(self._take(k), (doc, start, ids, total))
        elif len(self.open) < self.most_open:
            self._put(self._new(), (doc, start, ids, total))
        else:
            fullest = self._take(0)
            room = self.size - fullest.used
            self._put(fullest, (doc, start, ids[:room], total))
            self._put(self._new(), (doc, start + room, ids[room:], total))

    def leftovers(self) -> Iterator[Window]:
        for number in sorted(self.open):
            yield self.open[number]


def _rows(kind: str) -> str:
    return f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, merge_group long"


class _Output:
    """Gathers piece rows and hands them on in batches of bounded size."""

    def __init__(self, id_type: pa.DataType, limit: int = 8 << 20):
        self.schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("merge_group", pa.int64())])
        self.limit, self.rows, self.bytes = limit, [], 0

    def add(self, w: Window, high: int, group: int | None) -> None:
        offset = 0
        for doc, start, ids, total in w.pieces:
            self.rows.append((doc, start, len(ids), ids.tobytes(), total, high + w.number, offset, group))
            self.bytes += 4 * len(ids) + 64
            offset += len(ids)

    def take(self, all_of_it: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (all_of_it or self.bytes >= self.limit):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), self.schema.types)], schema=self.schema)
            self.rows, self.bytes = [], 0


def pack(docs: DataFrame, encode_from: tuple[str, str], *, window: int = 2048, end_id: int = 1, open_windows: int = 64, merge_partitions: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids (uint32, little-endian), doc_tokens, sequence_id, offset.

    encode_from: the paths of the rank file and the JSON file of the tokenizer. The pieces are
    written once to the shared folder, as both the full windows and the leftovers come from
    the one pass that tokenises; the ids of a retried task are the same, as a partition is a
    fixed range of the input files.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, partition, out = byte_bpe_encoder(*encode_from), TaskContext.get().partitionId(), None
        end, high = np.array([end_id], np.uint32), partition << 32
        packer = None
        for batch in batches:
            if packer is None:
                out = _Output(batch.column(0).type)
                packer = Packer(window, open_windows, lambda w: out.add(w, high, None))
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = np.concatenate([encode(text.as_py() or ""), end])
                packer.add(doc.as_py(), 0, ids, len(ids))
                yield from out.take()
        if packer is not None:
            for w in packer.leftovers():
                out.add(w, high, partition // merge_partitions)
            yield from out.take(True)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        out, high = _Output(table.schema.field("doc_id").type), (1 << 62) | (key[0].as_py() << 32)
        packer = Packer(window, 1, lambda w: out.add(w, high, None))
        for doc, start, ids, total in zip(*(table.column(c) for c in ("doc_id", "start", "ids", "doc_tokens"))):
            packer.add(doc.as_py(), start.as_py(), np.frombuffer(ids.as_py(), np.uint32), total.as_py())
        for w in packer.leftovers():
            out.add(w, high, None)
        return pa.Table.from_batches(list(out.take(True)), schema=out.schema)

    placed = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(place, _rows(kind)))
    merged = placed.where("merge_group is not null").groupBy("merge_group").applyInArrow(merge, _rows(kind))
    return placed.where("merge_group is null").unionByName(merged).drop("merge_group").withColumnRenamed("doc_id", id_col)
