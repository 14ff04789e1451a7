"""BigWig files as tables: the public binary format of indexed, compressed signal records."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SUFFIXES = (".bw", ".bigwig", ".bigWig", ".BW")
# Fixed values of the format: magic numbers and section types.
BIGWIG, CHROM_TREE, INDEX_TREE = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BEDGRAPH, VARIABLE, FIXED = 1, 2, 3


def is_bigwig(path: str) -> bool:
    return path.endswith(SUFFIXES)


def _chroms(data: bytes, at: int, e: str) -> dict[int, tuple[str, int]]:
    magic, _, key_size, _, _ = struct.unpack_from(f"{e}IIIIQ", data, at)
    if magic != CHROM_TREE:
        raise ValueError("the chromosome tree is damaged")
    out: dict[int, tuple[str, int]] = {}
    nodes = [at + 32]
    while nodes:
        node = nodes.pop()
        leaf, _, n = struct.unpack_from(f"{e}BBH", data, node)
        node += 4
        for _ in range(n):
            key = data[node : node + key_size].rstrip(b"\0").decode()
            if leaf:
                number, size = struct.unpack_from(f"{e}II", data, node + key_size)
                out[number] = (key, size)
            else:
                nodes.append(struct.unpack_from(f"{e}Q", data, node + key_size)[0])
            node += key_size + 8
    return out


def _blocks(data: bytes, at: int, e: str) -> Iterator[tuple[int, int]]:
    if struct.unpack_from(f"{e}I", data, at)[0] != INDEX_TREE:
        raise ValueError("the index is damaged")
    nodes = [at + 48]
    while nodes:
        node = nodes.pop()
        leaf, _, n = struct.unpack_from(f"{e}BBH", data, node)
        node += 4
        for _ in range(n):
            if leaf:
                yield struct.unpack_from(f"{e}QQ", data, node + 16)
                node += 32
            else:
                nodes.append(struct.unpack_from(f"{e}Q", data, node + 16)[0])
                node += 24


def records(data: bytes) -> Iterator[tuple[str, int, int, float]]:
    """(chrom, start, end, value) of every record of a file's full-resolution data."""
    e = "<" if struct.unpack_from("<I", data)[0] == BIGWIG else ">"
    magic, _, _, chrom_at, _, index_at, _, _, _, _, packed, _ = struct.unpack_from(f"{e}IHHQQQHHQQIQ", data)
    if magic != BIGWIG:
        raise ValueError("not a BigWig file")
    names = _chroms(data, chrom_at, e)
    for at, size in sorted(_blocks(data, index_at, e)):
        block = data[at : at + size]
        block = zlib.decompress(block) if packed else block
        number, start, _, step, span, kind, _, n = struct.unpack_from(f"{e}IIIIIBBH", block)
        chrom, where = names[number][0], 24
        for i in range(n):
            if kind == BEDGRAPH:
                s, t, v = struct.unpack_from(f"{e}IIf", block, where)
                where += 12
            elif kind == VARIABLE:
                s, v = struct.unpack_from(f"{e}If", block, where)
                t, where = s + span, where + 8
            elif kind == FIXED:
                (v,) = struct.unpack_from(f"{e}f", block, where)
                s, where = start + i * step, where + 4
                t = s + span
            else:
                raise ValueError(f"unknown section type {kind}")
            yield chrom, s, t, v


def read_bigwig(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, value; one task a file, read by Spark's own file access."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows: list[tuple] = []
                for r in records(bytes(content)):
                    rows.append(r)
                    if len(rows) == 100_000:
                        yield pd.DataFrame(rows, columns=["chrom", "start", "end", "value"])
                        rows = []
                yield pd.DataFrame(rows, columns=["chrom", "start", "end", "value"]).astype({"start": "int64", "end": "int64", "value": "float64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "chrom string, start long, end long, value double")


def chrom_sizes(data: bytes) -> dict[str, int]:
    e = "<" if struct.unpack_from("<I", data)[0] == BIGWIG else ">"
    return dict(_chroms(data, struct.unpack_from(f"{e}Q", data, 8)[0], e).values())
