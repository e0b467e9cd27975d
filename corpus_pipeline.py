"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import minhash, mixing, packing, quality_rules, substring
from marlstone.llm.common import fresh, read
from marlstone.storage import Scratch, cleared


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.  Null and empty texts fail the base limits and go; repeated rows and rows without doc_id are judged like others."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id, and every document that has none.

    Rows of one doc_id are one document and stay or go together; rows without
    doc_id, and texts without words, stay.
    """
    drop = fresh(docs, "drop")[0]
    dropped = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias(drop)).distinct()
    return docs.join(dropped.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col(drop), "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and passages that stand earlier elsewhere.

    Every row is a document of its own, whatever its doc_id; null texts stay,
    and rows of which only white space is left go.
    """
    return substring.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is a source, texts without words count 0, rows of one doc_id are taken alike."""
    return mixing.repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; null and empty texts are their end id, and each row is a document of its own."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("substring dedup", substring_dedup), ("mixing", mix), ("packing", pack)]

#: Min-max hashing and tokenisation can't be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again; what a stage wrote besides goes with it."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with cleared():
            docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
