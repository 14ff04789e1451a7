"""The corpus pipeline: quality rules, toxicity, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.llm import jaccard_join, packing, quality_rules, suffix_dedup, toxicity
from seqlattice.llm.common import read_table, shared_folder
from seqlattice.llm.queries import learnable, tokenizer_paths

ID, TEXT = "doc_id", "text"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the model is fitted to this stage's own input."""
    return quality_rules.keep(docs, quality_rules.fit(docs, read_table(spark, sf_dir, "labels")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    return toxicity.keep(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels"), learnable("id")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of equal or similar texts the row of the smallest id stays, one where rows share it."""
    joined = jaccard_join.join(docs)
    first = joined.where(F.col(ID).eqNullSafe(F.col("class_id"))).groupBy("class_key").agg(F.min("text_id").alias("text_id"), F.min(ID).alias(ID))
    stays = first.select(row_key(F.col("text_id")).alias("_key"))
    kept = docs.withColumn("_key", row_key(F.xxhash64(F.coalesce(TEXT, F.lit("")))))
    return kept.join(stays, "_key", "left_semi").dropDuplicates(["_key"]).select(docs.columns)


def row_key(text_id: Column) -> Column:
    return F.xxhash64(ID, F.col(ID).isNull(), text_id)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated bytes are cut out of the texts; a character that loses a byte goes."""
    out = suffix_dedup.clean(docs)
    return out.withColumn("n_chars", F.when(F.col(TEXT).isNull(), F.col("n_chars")).otherwise(F.char_length(TEXT).cast("long")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, with the checksum of their ids."""
    pieces = packing.pack(docs, tokenizer_paths())
    return pieces.select(ID, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("2 quality rules", quality),
    ("5 toxicity", toxic),
    ("3 n-gram Jaccard join", near_duplicates),
    ("10 suffix-array dedup", repeated_passages),
    ("1 packing", packed),
]

#: SQL can't express the ratio, the field, the tokenizer or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written as Parquet to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
