"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import classifier, embeddings, html_text, minhash, mixing, packing, quality_rules, substring, token_rollup, warc
from marlstone.llm.common import read
from marlstone.storage import Scratch


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents", deal=False))


def op3_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_line_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(read(spark, sf_dir, "documents"))


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive, some as drafts that say a word more; those are revised, some are taken back and brought again, and batches that come twice count once."""
    scratch = Scratch(spark, "rollup")
    docs = read(spark, sf_dir, "documents")
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(3)), F.lit(0))
    draft = F.concat_ws(" ", "text", F.lit("draft"))
    both = F.array(F.struct(F.lit(False).alias("final"), draft.alias("t")), F.struct(F.lit(True).alias("final"), F.col("text").alias("t")))
    texts = docs.withColumns({"part": part, "version": F.explode(F.when(part == 1, both).otherwise(F.slice(both, 2, 1)))})
    texts = texts.select("doc_id", "source", "lang", F.col("version.t").alias("text"), F.struct("part", F.col("version.final").alias("final")).alias("tag"))
    counts = scratch.keep(token_rollup.counted(texts, keep="tag"), "counts")
    rollup = token_rollup.TokenRollup(spark, scratch.path("totals"))
    signed = lambda rows, sign: rows.withColumn("sign", F.lit(sign))
    drafts, finals, moved = counts.where("not tag.final"), counts.where("tag.part = 1 and tag.final"), counts.where("tag.part = 2")
    first = counts.where("tag.part <> 1").unionAll(drafts)
    revision = signed(drafts, -1).unionAll(finals)
    for batch, rows in (("1", first), ("2", revision), ("1", first), ("3", signed(moved, -1)), ("4", moved), ("2", revision)):
        rollup.commit(batch, rows)
    return rollup.totals()


def op6_cross_polytope_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents")).withColumn("posterior", F.round("posterior", 6))


def op8_sharded_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "archives").base
    manifest = warc.write(read(spark, sf_dir, "pages"), folder)
    return warc.read_back(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_minhash_near_dedup, op2_water_filling_mix, op3_nb_svm_quality, op4_line_hash_dedup, op5_token_rollup,
        op6_cross_polytope_near_dedup, op7_weak_supervision, op8_sharded_warc, op9_html_layout, op10_sum_of_squares_packing,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": minhash.SQL, "op6_cross_polytope_near_dedup": embeddings.SQL,
        "op2_water_filling_mix": mixing.SQL, "op7_weak_supervision": quality_rules.sql(), "op8_sharded_warc": warc.SQL,
    }
