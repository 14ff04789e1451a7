"""What the text operators share: table access, lineage cuts and byte-level text kernels.

The kernels work on one flat byte array per group of texts, so that the per-row cost of
Python is paid per group and not per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step handles; a longer text is a group of its own.
GROUP_BYTES = 2 << 20

#: Odd multipliers of 64-bit mixing (the public splitmix64 finaliser).
MIX_1, MIX_2, GOLDEN = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
BASE = 0x5851F42D4C957F2D
BASE_INV = pow(BASE, -1, 1 << 64)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` that this session writes to.

    One is chosen here only where the session names none and all runs on one machine, as in
    tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and returns it read back; Spark removes it with the last reference where it is told to."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder as a table, compressed and to be read by columns, and returns it read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    """mix() of one Python integer."""
    x &= MASK
    x = ((x ^ (x >> 30)) * MIX_1) & MASK
    x = ((x ^ (x >> 27)) * MIX_2) & MASK
    return x ^ (x >> 31)


#: The Mersenne prime 2**31 - 1 and two bases below it.
PRIME = (1 << 31) - 1
BASES = (0x3C6EF372, 0x1F83D9AB)

_short: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_long: list[np.ndarray] = [np.ones(1, np.uint32)] * 4


def _powers_short(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if len(_short[0]) < n:
        size = max(n, GROUP_BYTES + 4096)
        for k, base in enumerate((BASE, BASE_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _short[k] = np.multiply.accumulate(table)
    return _short[0], _short[1]


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**62."""
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(31))
    x = (x & p) + (x >> np.uint64(31))
    return np.where(x >= p, x - p, x)


def _powers_long(n: int) -> list[np.ndarray]:
    """For each of BASES its powers and those of its inverse modulo PRIME, n of each at least."""
    if len(_long[0]) < n:
        size = max(n, GROUP_BYTES + 4096)
        for k, base in enumerate(x for b in BASES for x in (b, pow(b, -1, PRIME))):
            table, have = np.ones(size, np.uint32), 1
            while have < size:  # each part is the one before it times a power
                part = table[: min(have, size - have)]
                table[have : have + len(part)] = _reduced(part * np.uint64(pow(base, have, PRIME)))
                have += len(part)
            _long[k] = table
    return _long


def text_groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets in them) of runs of rows of about limit bytes.

    Null texts are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < n:
        after = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        after = min(max(after, first + 1), n)
        yield first, after, whole[at[first] : at[after]], at[first : after + 1] - at[first]
        first = after


class ShortSpans:
    """Hashes of spans of at most ``MOST`` items, a polynomial modulo 2**64.

    Longer spans are refused: from 1,024 items on there are texts (Thue and Morse's) that
    every such polynomial takes for equal.
    """

    MOST = 512

    def __init__(self, data: np.ndarray):
        up, self._down = _powers_short(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(start) and int((end - start).max()) > self.MOST:
            raise ValueError(f"a span is longer than {self.MOST}")
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64) * np.uint64(GOLDEN))


class Spans:
    """Hashes of spans of any length: two polynomials modulo a prime, 62 bits together.

    Equal spans have equal hashes. Unequal ones of n items may share theirs, for texts chosen
    without regard to the bases with a chance of about (n / 2**31)**2 at most; where equality
    decides a result, callers compare the bytes (names_of).
    """

    def __init__(self, data: np.ndarray):
        tables = _powers_long(len(data) + 1)
        whole, p = data.astype(np.uint64) + np.uint64(1), np.uint64(PRIME)
        self._sums, self._down = [], [tables[1], tables[3]]
        for up in (tables[0], tables[2]):
            term = whole * up[: len(data)]
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((term & p) + (term >> np.uint64(31)), out=sums[1:])
            self._sums.append(sums)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = (_reduced(_reduced(s[end] - s[start]) * d[start]) for s, d in zip(self._sums, self._down))
        return mix((one << np.uint64(31) | two) + (end - start).astype(np.uint64) * np.uint64(GOLDEN))


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, long_: int = 1 << 12) -> np.ndarray:
    """Whether data[a[i]:a[i] + size[i]] equals data[b[i]:b[i] + size[i]], eight bytes at a time."""
    out = np.ones(len(a), bool)
    if not len(a):
        return out
    raw = np.zeros(data.nbytes + 8, np.uint8)
    raw[:-8] = np.ascontiguousarray(data).view(np.uint8)
    eight = np.ndarray((data.nbytes + 1,), "<u8", raw, strides=(1,))  # the eight bytes from each place on
    a, b, size = (x * data.itemsize for x in (a, b, size))
    for i in np.flatnonzero(size > long_):
        out[i] = np.array_equal(raw[a[i] : a[i] + size[i]], raw[b[i] : b[i] + size[i]])
    live, done = np.flatnonzero(size <= long_), 0
    while len(live := live[size[live] > done]):
        differ = eight[a[live] + done] ^ eight[b[live] + done]
        over = np.maximum(8 * (done + 8 - size[live]), 0).astype(np.uint64)
        same = differ << over == 0
        out[live[~same]] = False
        live, done = live[same], done + 8
    return out


def names_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name of each span, a span of each name): equal names if and only if equal bytes."""
    _, first, name = np.unique(Spans(data).hash(start, end), return_index=True, return_inverse=True)
    size, other = end - start, np.flatnonzero(first[name] != np.arange(len(name)))
    head = first[name[other]]
    same = size[other] == size[head]
    same[same] = same_spans(data, start[other][same], start[head][same], size[other][same])
    if not same.all():  # one hash for unequal spans: those are named by their bytes
        odd = np.flatnonzero(np.isin(name, name[other[~same]]))
        known: dict[bytes, int] = {}
        name[odd] = [len(first) + known.setdefault(data[start[k] : end[k]].tobytes(), len(known)) for k in odd]
        _, first, name = np.unique(name, return_index=True, return_inverse=True)
    return name, first


#: The bytes that end a word (space and the ASCII controls tab to carriage return).
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words ``[^\\x20\\x09-\\x0D]+`` of texts data[at[i]:at[i+1]]."""
    inside = ~SEPARATORS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    row = np.searchsorted(at, start, side="right") - 1
    return start, end, row


def lines_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the \\n-split lines of the texts; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    start = np.concatenate([at[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, breaks, side="right") - 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.empty_like(start)
    last = np.ones(len(start), bool)
    last[:-1] = row[1:] != row[:-1]
    end[:-1] = start[1:] - 1
    end[last] = at[1:][row[last]]
    return start, end, row


def shingles(word_hash: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the windows of n words that lie in one row."""
    if len(word_hash) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    first = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1])
    total = np.zeros(len(first), np.uint64)
    for k in range(n):
        total = mix(total * np.uint64(GOLDEN) + word_hash[first + k])
    return first, total


def per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights, minlength=n)
