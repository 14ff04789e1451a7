"""Sharding: proportional stratified interleaving.

Within each source the rows are ranked in a seeded random order (of an MD5); a row's fractional rank is
(rank + 1/2) / rows of its source. Sorting all rows by it spreads every source evenly, and
cutting that order into equal counts gives shards that each hold the corpus's mixture to
within one row a source and cut.

No rank is computed in one task: rows fall into buckets of their hash (then of their
fractional rank), the small table of bucket counts gives each bucket's first rank, and only
the rows of one bucket are sorted together. A source that holds a third of all rows has the
same small buckets as any other. The text never leaves its scan; the shuffles carry its size
and checksum.

Edge cases: a null text has size ``extra`` and the checksum of no bytes; a null source is a
source of its own. The hash covers id, text and source, and for rows equal in all of these the
number of the copy, so that null or repeated ids are dealt out like others; its ties go by id,
checksum and size. Fewer rows than shards leave shards empty; an empty table gives an
empty result. Only the named columns are read. Equal texts are not held together: the law is
that shards' row counts differ by one at most, whatever the size of a group of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _offsets(counts: DataFrame, bucket: str, *by: str) -> DataFrame:
    """counts(by..., bucket, n) with the rows before each bucket and, if by is given, the rows in all."""
    order = W.partitionBy(*by).orderBy(bucket)
    out = counts.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return out.withColumn("total", F.sum("n").over(W.partitionBy(*by)))


def interleave(rows: DataFrame, source: Column, order_key: Column, buckets: int) -> DataFrame:
    """rows with ``place`` (0-based, gapless) in the interleaved order and ``of``, the number of rows.

    order_key: a text of 15 hex digits at least, uniformly distributed.
    """
    step = (1 << 60) // buckets + 1
    keyed = rows.withColumn("_source", F.struct(source.isNull().alias("none"), F.coalesce(source.cast("string"), F.lit("")).alias("name"))).withColumn("_key", order_key)
    keyed = keyed.withColumn("_bucket", F.expr(f"cast(conv(substr(_key, 1, 15), 16, 10) as long) div {step}L"))
    first = _offsets(keyed.groupBy("_source", "_bucket").agg(F.count("*").alias("n")), "_bucket", "_source")
    in_bucket = W.partitionBy("_source", "_bucket").orderBy("_key", *TIES)
    ranked = keyed.withColumn("_at", F.row_number().over(in_bucket)).join(first.select("_source", "_bucket", "before", "total"), ["_source", "_bucket"])
    ranked = ranked.withColumn("_share", (F.col("before") + F.col("_at") - F.lit(0.5)) / F.col("total")).withColumn("_bucket", F.floor(F.col("_share") * buckets)).drop("before", "total", "_at")
    then = _offsets(ranked.groupBy("_bucket").agg(F.count("*").alias("n")), "_bucket")
    in_share = W.partitionBy("_bucket").orderBy("_share", "_key", "_source", *TIES)
    placed = ranked.withColumn("_at", F.row_number().over(in_share)).join(then.select("_bucket", "before", "total"), "_bucket")
    return placed.withColumn("place", F.col("before") + F.col("_at") - 1).withColumnRenamed("total", "of").drop("_source", "_key", "_bucket", "_share", "_at", "before")


TIES = ("doc_id", "text_crc32", "size", "copy")


ROWS_SORTED = 200_000


def shard(docs: DataFrame, *, shards: int = 40, seed: int = 20240, extra: int = 16, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, source of every row.

    buckets bounds what one task sorts to about rows / buckets; by default it follows the
    number of rows, so that this is about ``ROWS_SORTED``.
    """
    buckets = buckets or max(1024, docs.count() // ROWS_SORTED)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + extra).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.col(source_col).alias("source"))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "doc_id", "text_crc32", "size", "copy"))
    out = interleave(rows, F.col("source"), key, buckets)
    number = F.expr(f"(place * {shards}L) div of")
    begin = F.expr(f"((place * {shards}L) div of * of + {shards - 1}L) div {shards}L")
    return out.select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), number.cast("int").alias("shard"), (F.col("place") - begin).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source")
