"""Token counts as delta-maintained rollups.

A batch of changes holds rows (doc_id, source, lang, text, sign): sign 1 adds a
document's version, -1 takes one back, and a revision is both.  A batch is
counted once, its signed sums by source, language and tokenizer version are
written under its id, and a marker commits it.  Totals are the sums over the
committed batches: they add up in any order, a batch that is committed already
is left alone, and one that broke off before its marker is written anew.

Defined cases: null and empty texts count 0 tokens; null source or lang is a
group of its own; a null sign is 1; groups whose documents are all taken back
leave the totals; repeated rows count as often as they stand there; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import WORD
from marlstone.llm.tokens import VOCABULARY, piece_table

WORDS_VERSION = "words@1"
BPE_VERSION = "word_bpe_49k@1"
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def counter(vocabulary: str):
    """Column 0, texts, becomes their numbers of ids."""

    def run(batches):
        import pyarrow as pa

        table = piece_table(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(table.counts(batch.column(0))), *batch.columns[1:]], names=["bpe", *batch.schema.names[1:]])

    return run


def counted(changes: DataFrame, vocabulary: str = VOCABULARY, keep: str | None = None) -> DataFrame:
    """Counts of each changed row by both tokenizers: bpe, words, and the row's doc_id, source, lang, sign, and one more column to ``keep``."""
    sign = F.col("sign").cast("int") if "sign" in changes.columns else F.lit(1)
    rows = changes.select(
        F.col("text").cast("string"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("words"),
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.coalesce(sign, F.lit(1)).alias("sign"), *([keep] if keep else []),
    )
    extra = f", {keep} {changes.schema[keep].dataType.simpleString()}" if keep else ""
    return rows.mapInArrow(counter(vocabulary), f"bpe long, words long, doc_id long, source string, lang string, sign int{extra}")


def deltas(counts: DataFrame) -> DataFrame:
    """Signed sums by source, language and tokenizer version."""
    both = F.explode(F.array(F.struct(F.lit(BPE_VERSION).alias("v"), F.col("bpe").alias("n")), F.struct(F.lit(WORDS_VERSION).alias("v"), F.col("words").alias("n"))))
    rows = counts.groupBy("source", "lang").agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("bpe")).alias("bpe"), F.sum(F.col("sign") * F.col("words")).alias("words"))
    return rows.withColumn("x", both).select("source", "lang", F.col("x.v").alias("tokenizer_version"), "n_docs", F.col("x.n").alias("n_tokens"))


class TokenRollup:
    """A rollup kept in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        p, fs = self._fs(self.folder)
        if not fs.exists(p):
            return []
        found = []
        for s in fs.listStatus(p):
            marker, _ = self._fs(f"{s.getPath().toString()}/_SUCCESS")
            if s.isDirectory() and fs.exists(marker):
                found.append(s.getPath().getName().removeprefix("batch-"))
        return sorted(found)

    def commit(self, batch_id: str, counts: DataFrame) -> bool:
        """Add a batch of counted() rows; False if it was committed before."""
        if not batch_id or not all(c.isalnum() or c in "._-" for c in batch_id):
            raise ValueError("a batch id holds letters, digits, '.', '_' and '-'")
        if batch_id in self.batches():
            return False
        deltas(counts).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch_id}")
        return True

    def totals(self) -> DataFrame:
        done = [f"{self.folder}/batch-{b}" for b in self.batches()]
        rows = self.spark.read.schema(DELTA).parquet(*done) if done else self.spark.createDataFrame([], DELTA)
        sums = rows.groupBy("source", "lang", "tokenizer_version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")
