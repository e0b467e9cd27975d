"""Cleaning of whole tables: all passes of a document in one Arrow pass, with no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from marlstone.operators import rewrites as rw
from marlstone.operators.batches import slices

COUNTED = StructType([StructField(k, IntegerType()) for k in rw.COUNTERS])


def cleaner(text_at: int, engine_at: int | None, on: dict[str, bool]) -> Callable:
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, text_at):
            engines = batch.column(engine_at).to_pylist() if engine_at is not None else [""] * batch.num_rows
            done = [rw.clean(x or "", e or "", **on) for x, e in zip(batch.column(text_at).to_pylist(), engines)]
            stats = pa.StructArray.from_arrays([pa.array([c[k] for _, c in done], pa.int32()) for k in rw.COUNTERS], names=list(rw.COUNTERS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in done], pa.string()), stats], names=[*batch.schema.names, "cleaned", "stats"])

    return run


def clean(docs: DataFrame, text: str = "text", engine: str | None = None, **on: bool) -> DataFrame:
    """The columns of ``docs``, cleaned text and counters; null texts are empty.  Passes are switched off by name (rewrites.SWITCHES)."""
    unknown = set(on) - set(rw.SWITCHES)
    if unknown:
        raise ValueError(f"no such pass: {sorted(unknown)}")
    schema = StructType([*docs.schema.fields, StructField("cleaned", StringType()), StructField("stats", COUNTED)])
    at = docs.columns.index
    return docs.mapInArrow(cleaner(at(text), at(engine) if engine else None, on), schema)


def per_document(docs: DataFrame, one: Callable[[str], tuple[str, int]], text: str = "text") -> DataFrame:
    """(doc_id, text, n) of one pass alone."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            done = [one(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["doc_id", "text", "n"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, text string, n long")


def line_pass(name: str) -> Callable[[str], tuple[str, int]]:
    """A pass of ``rewrites`` on whole texts, with how much it did."""
    step: Any = getattr(rw, name)

    def one(text: str) -> tuple[str, int]:
        count = rw.Counter()
        lines = text.split("\n")
        lines = step(lines, rw.chapter_titles(lines), count) if name == "promote_titles" else step(lines, count)
        return "\n".join(lines), sum(count.values())

    return one


def total_fixes(stats: str = "stats"):
    return sum((F.col(f"{stats}.{k}") for k in rw.COUNTERS), F.lit(0))


def brief(stats: str = "stats"):
    """What cleaning did, in a few words; repaired characters count apart."""
    chars = F.col(f"{stats}.chars_normalized")
    fixes = total_fixes(stats) - chars
    bits = F.array_compact(F.array(F.when(fixes > 0, F.concat(F.format_number(fixes, 0), F.lit(" fixes"))), F.when(chars > 0, F.concat(F.format_number(chars, 0), F.lit(" chars normalized")))))
    return F.when(F.size(bits) == 0, "No cleanup changes").otherwise(F.concat(F.lit("Cleaned ("), F.array_join(bits, ", "), F.lit(")")))


#: Counters and their wording, in the order of the summary.
WORDING = (
    ("prepress_removed", "prepress slug(s) removed"), ("shadow_words_fixed", "doubled word(s) repaired"), ("removed_noise_lines", "header/page-number line(s) removed"),
    ("toc_lines_removed", "TOC/index line(s) removed"), ("boilerplate_lines_removed", "boilerplate line(s) removed"), ("headings_promoted", "heading(s) promoted"),
    ("code_blocks_fenced", "code block(s) fenced"), ("fences_merged", "split fence(s) merged"), ("bullets_normalized", "bullet(s) normalized"),
    ("lines_joined", "wrapped line(s) joined"), ("chars_normalized", "character(s) normalized"), ("blank_runs_collapsed", "blank run(s) collapsed"),
)


def summary(stats: str = "stats"):
    parts = F.array_compact(F.array(*[F.when(F.col(f"{stats}.{k}") > 0, F.concat_ws(" ", F.col(f"{stats}.{k}").cast("string"), F.lit(w))) for k, w in WORDING]))
    return F.when(F.size(parts) == 0, "No cleanup changes.").otherwise(F.concat(F.lit("Cleanup: "), F.array_join(parts, ", "), F.lit(".")))
