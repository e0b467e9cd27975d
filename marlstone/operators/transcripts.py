"""Transcript segments into paragraphs, and their Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as t

# --- fixed values -------------------------------------------------------------------
GAP_S, PARAGRAPH_CHARS = 2.0, 700


def gap_paragraphs(segments: DataFrame, gap_s: float = GAP_S) -> DataFrame:
    """Paragraphs cut at pauses alone: (media_id, paragraph, start, text)."""
    order = Window.partitionBy("media_id").orderBy("seq")
    rows = segments.withColumn("text", t.strip(F.col("text"))).where("text <> ''")
    rows = rows.withColumn("paragraph", F.sum(F.when(F.col("start") - F.lag("end").over(order) <= gap_s, 0).otherwise(1)).over(order))
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return rows.groupBy("media_id", "paragraph").agg(F.min("start").alias("start"), F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def paragraphs(segments: DataFrame, gap_s: float = GAP_S, chars: int = PARAGRAPH_CHARS, key: str = "long") -> DataFrame:
    """Paragraphs cut at pauses, and once they are long: (media_id, paragraph, start, text).

    How long one is depends on where it began, so a pause's rows are walked in
    order; pauses cut a recording into pieces that are walked apart.
    """
    order = Window.partitionBy("media_id").orderBy("seq")
    rows = segments.withColumn("text", t.strip(F.col("text"))).where("text <> ''")
    rows = rows.withColumn("piece", F.sum(F.when(F.col("start") - F.lag("end").over(order) <= gap_s, 0).otherwise(1)).over(order).cast("long"))
    rows = rows.select("media_id", "piece", "seq", "start", F.length("text").alias("n"), "text").repartition("media_id", "piece").sortWithinPartitions("media_id", "piece", "seq")
    marked = rows.mapInArrow(walk(chars), f"media_id {key}, piece long, part long, seq long, start double, text string")
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    out = marked.groupBy("media_id", "piece", "part").agg(F.min("start").alias("start"), F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))
    numbered = F.row_number().over(Window.partitionBy("media_id").orderBy("piece", "part"))
    return out.withColumn("paragraph", numbered).select("media_id", "paragraph", "start", "text")


def walk(chars: int):
    def run(batches):
        import pyarrow as pa

        now, part, size = None, 0, 0
        for batch in batches:
            parts = []
            for media, piece, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist()):
                if (media, piece) != now:
                    now, part, size = (media, piece), 0, 0
                elif size > chars:
                    part, size = part + 1, 0
                size += n + 1
                parts.append(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.int64()), pa.array(batch.column(2).to_pylist(), pa.int64()), batch.column(3), batch.column(5)], names=["media_id", "piece", "part", "seq", "start", "text"])

    return run


def markdown(rows: DataFrame) -> DataFrame:
    """(media_id, markdown) of paragraphs; each stands under its time."""
    line = F.concat(F.lit("**["), t.stamp(F.col("start")), F.lit("]** "), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("paragraph", line.alias("line"))))
    return rows.groupBy("media_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n\n").alias("markdown"))


#: Fixed value: what a transcript without speech says.
NO_SPEECH = "_(No speech detected.)_"


def documents(recordings: DataFrame) -> DataFrame:
    """(path, markdown) of recordings(path, language, probability, engine, segments array<struct<start, end, text>>): a head, and the paragraphs under their times."""
    rows = recordings.select("path", F.posexplode_outer("segments").alias("seq", "s")).where("s is not null")
    rows = rows.select(F.col("path").alias("media_id"), F.col("seq").cast("long").alias("seq"), "s.start", "s.end", "s.text")
    body = markdown(paragraphs(rows, key="string"))
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    language = F.coalesce(F.nullif("language", F.lit("")), F.lit("unknown"))
    sure = F.when(F.col("probability").isNotNull(), F.concat(F.lit(" ("), F.format_number(F.col("probability") * 100, 0), F.lit("% confidence)"))).otherwise("")
    head = F.concat(F.lit("# Transcript: "), name, F.lit("\n\n**Detected language:** "), language, sure, F.lit("\n**Engine:** "), F.coalesce("engine", F.lit("unknown")), F.lit("\n\n---\n\n"))
    out = recordings.join(body.withColumnRenamed("media_id", "path"), "path", "left")
    return out.select("path", F.concat(head, F.coalesce("markdown", F.lit(NO_SPEECH)), F.lit("\n")).alias("markdown"))
