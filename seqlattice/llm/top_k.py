"""Exact top-k search: exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows: component x of dimension j is the term j with weight
floor(scale * x). A task turns a block of candidates into postings (term -> rows and weights)
and scatters, for one term after the other, query weight times posting weights into a dense
array of scores, one line a query. Each block's best k of every query are selected there
(partition selection) and merged: across blocks of a task as they come, across tasks by a
window over k rows a task and query.

The queries go to the tasks in chunks of at most ``query_chunk`` rows, the only thing that is
broadcast; each chunk is one scan of the candidates, done and written before the next chunk is
fetched, so that the driver holds one at a time. No pair of rows is ever emitted.

Sums are 64-bit where no sum of a block can leave them; rows with components beyond that are
added up in integers of any size. A result that a long cannot hold is an error.

Edge cases: a vector that is null, or holds a null or non-finite component takes no part. An
empty vector is one of all zeros, and vectors of different lengths meet in the dimensions that
both have. Ties go to the smaller id; a row never answers a query of its own id; repeated rows
answer once for each row, and a repeated query id asks once, with its smallest vector. Null ids
take no part. Fewer than k candidates: all of them. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, weights (array<double> of whole numbers) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = F.transform("v", lambda x: F.when(F.abs(x * scale) < float(1 << 52), F.floor(x * scale).cast("double")).otherwise(x * scale))  # larger ones are whole
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fit).select("id", small.alias("weights"))


def dense(column: pa.Array) -> np.ndarray:
    """A list column as one line a row, short rows filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    n, wide = np.diff(at), int(np.diff(at).max(initial=0))
    out = np.zeros((len(n), wide))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(at[0], at[-1]) - np.repeat(at[:-1], n)] = values[at[0] : at[-1]]
    return out


def accumulate(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Dense scores, one line a query, accumulated one term at a time in the arrays' kind of number."""
    out = np.zeros((len(queries), len(block)), queries.dtype)
    for term in range(min(queries.shape[1], block.shape[1])):
        asked, posted = np.flatnonzero(queries[:, term]), np.flatnonzero(block[:, term])
        if not len(asked) or not len(posted):
            continue
        weights = block[posted, term]
        if len(asked) == len(queries) and len(posted) == len(block):
            out += queries[:, term, None] * weights[None, :]
        else:
            out[np.ix_(asked, posted)] += queries[asked, term, None] * weights[None, :]
    return out


LEAST = -(1 << 63)


def scores(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """accumulate() as long; sums below all longs are LEAST, which no result may be."""
    terms = max(min(queries.shape[1], block.shape[1]), 1)
    narrow = np.sqrt(2.0**62 / terms)
    q, b = (np.abs(x).max(axis=1, initial=0) < narrow for x in (queries, block))
    if q.all() and b.all():
        return accumulate(queries.astype(np.int64), block.astype(np.int64))
    out = np.empty((len(queries), len(block)), np.int64)
    out[np.ix_(q, b)] = accumulate(queries[q].astype(np.int64), block[b].astype(np.int64))
    whole = lambda x: np.frompyfunc(int, 1, 1)(x).astype(object)
    for x, y in ((q, ~b), (~q, np.ones(len(b), bool))):
        if x.any() and y.any():
            exact = accumulate(whole(queries[x]), whole(block[y]))
            if exact.max() >= 1 << 63:
                raise OverflowError("a score is greater than a long")
            out[np.ix_(x, y)] = np.maximum(exact, LEAST).astype(np.int64)
    return out


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k first of one line, by score down and id up."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
        score, ids = score[at], ids[at]
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def search(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", query_chunk: int = 8192, block_rows: int = 2048, query_lines: int = 128) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best of every query.

    is_query: a condition on ``id``.
    """
    rows = quantised(vectors, id_col, vector_col, scale)
    asked = rows.where(is_query).groupBy("id").agg(F.min("weights").alias("weights"))
    n = asked.count()
    if n <= query_chunk:
        out = _search_chunk(asked, rows, k, block_rows, query_lines)[0]
    else:
        chunks, out = -(-2 * n // query_chunk), None  # twice as many as needed, as hashing fills them unevenly
        for part in range(chunks):
            found, shared = _search_chunk(asked.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == part), rows, k, block_rows, query_lines)
            found = cut_lineage(found)
            shared.unpersist()
            out = found if out is None else out.unionByName(found)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best_k = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.when(F.col("score") > LEAST, F.col("score")).otherwise(F.raise_error(F.lit("a score is less than a long")).cast("long"))
    return best_k.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), score.alias("score"))


def _search_chunk(chunk: DataFrame, rows: DataFrame, k: int, block_rows: int, query_lines: int) -> tuple[DataFrame, Broadcast]:
    """The k best of each task for every query of the chunk, and what is broadcast for it."""
    asked = chunk.toArrow()
    ids = asked.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    shared = rows.sparkSession.sparkContext.broadcast((ids[order], dense(asked.column("weights"))[order]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(query_ids)
        for batch in batches:
            for first in range(0, batch.num_rows, block_rows):
                part = batch.slice(first, block_rows)
                block_ids, block = part.column(0).to_numpy(), dense(part.column(1).take(pa.array(np.arange(part.num_rows))))
                for line in range(0, len(queries), query_lines):
                    for at, score in enumerate(scores(queries[line : line + query_lines], block), line):
                        others, other_ids, old = score, block_ids, kept[at]
                        if len(own := np.flatnonzero(block_ids == query_ids[at])):
                            others, other_ids = np.delete(score, own), np.delete(block_ids, own)
                        if len(old[0]) == k:
                            fit = np.flatnonzero(others >= old[0][-1])
                            if not len(fit):
                                continue
                            others, other_ids = others[fit], other_ids[fit]
                        kept[at] = best(np.concatenate([old[0], others]), np.concatenate([old[1], other_ids]), k)
        n = [len(x[0]) for x in kept]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, n)), pa.array(np.concatenate([x[1] for x in kept])), pa.array(np.concatenate([x[0] for x in kept]))], ["query_id", "id", "score"])

    return rows.mapInArrow(find, "query_id long, id long, score long"), shared
