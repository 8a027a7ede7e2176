"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, encoding; each stage over all that the one before kept.

Rows with nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any name go
through every stage; what becomes of them is in the docstrings of the operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, line_dedup, mixing, near_texts, quality_rules
from .common import own_folder, packed, table, unpacked


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified cutoff rejects go, so all of null or empty text."""
    cutoffs = quality_rules.fit_cutoffs(docs, table(spark, sf_dir, "labels"))
    kept = quality_rules.judge(packed(docs, "text", "lang"), cutoffs).where("kept")
    return kept.select(*unpacked(kept, docs, "text", "lang"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another document or place keeps go; a document of which nothing is left goes too. n_chars follows the text."""
    left = line_dedup.drop_lines(packed(docs, "doc_id", "text")).where(r"n_removed = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    return left.select(*unpacked(left, docs, "doc_id", "text", n_chars=F.length("text").cast("long")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, of Jaccard similarity 0.8 over five-word shingles; rows without doc_id stay."""
    return near_texts.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.taken(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of each row, with the digests of the ids and of the bytes that they decode to. Null text: no ids."""
    return byte_bpe.digests(docs, with_ids=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near copies", near_copies), ("mixture", mixture), ("encoded", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet to the shared folder and read again as the next one's docs.

    The folder goes when the driver ends.
    """
    folder = f"{own_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
