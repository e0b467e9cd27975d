"""What a reader of documents asks for: whole texts, outlines, sections, pages with anchors, incidents in words."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import patterns as p
from marlstone.functions import text as t
from marlstone.operators import quality, routing, sections
from marlstone.operators.sections import notebook_header
from marlstone.storage import Scratch

MAX_CHARS = 150_000


#: Converted documents that are kept.
KEPT = 4


class Kept:
    """Converted documents of one session, each written once to the shared folder under what it was made from; the newest KEPT stay."""

    def __init__(self, spark: SparkSession, newest: int = KEPT):
        self.newest, self.scratch, self.tables = newest, Scratch(spark, "kept"), OrderedDict()

    def get(self, key: tuple[str, float, bool], make: Callable[[], DataFrame]) -> DataFrame:
        """The table of a key (path, time of change, whether it's cleaned), made where it isn't there."""
        if key not in self.tables:
            name = hashlib.sha1(repr(key).encode()).hexdigest()
            self.tables[key] = name, self.scratch.keep(make(), name)
            while len(self.tables) > self.newest:
                _, (old, _) = self.tables.popitem(last=False)
                self.scratch.drop(old)
        self.tables.move_to_end(key)
        return self.tables[key][1]


def whole(docs: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, markdown): texts cut at ``max_chars`` with a note on it, and a warning before what looks like noise."""
    rows = quality.assess(docs)
    note = F.concat(F.lit("\n\n---\n\n_(Truncated at "), F.format_number(F.lit(max_chars), 0), F.lit(" of "), F.format_number("chars", 0), F.lit(" characters. Read the rest by sections.)_"))
    body = F.when(F.col("chars") > max_chars, F.concat(F.substring("text", 1, max_chars), note)).otherwise(F.col("text"))
    warning = F.when(F.col("binary_noise"), "> ⚠ Warning: this looks like binary noise; the source may be damaged.\n\n").otherwise("")
    return rows.select("doc_id", F.concat(warning, body).alias("markdown"))


def outlines(docs: DataFrame, max_tokens: int = p.DEFAULT_TOKENS, fallback: str = "") -> DataFrame:
    """(doc_id, title, est_tokens, score, sections): each section's index, title and size."""
    parts = sections.sections(docs, "outline", max_tokens)
    entry = F.struct(F.col("section_no").alias("index"), F.when(F.col("title") == "", "(document)").otherwise(F.col("title")).alias("title"), "est_tokens")
    listed = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("sections"))
    facts = quality.assess(docs).select("doc_id", t.document_title(F.col("text"), F.lit(fallback)).alias("title"), t.est_tokens(F.col("text")).alias("est_tokens"), "score")
    return facts.join(listed, "doc_id")


def section(docs: DataFrame, wanted: DataFrame, max_tokens: int = p.DEFAULT_TOKENS) -> DataFrame:
    """(doc_id, section_no, markdown, error_code) of wanted(doc_id, section_no); only the wanted documents are cut."""
    parts = sections.sections(docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"), "outline", max_tokens)
    out = wanted.join(parts.select("doc_id", "section_no", "markdown"), ["doc_id", "section_no"], "left")
    return out.withColumn("error_code", F.when(F.col("markdown").isNull(), "MS-132"))


def anchored_pages(pages: DataFrame, tagged: bool = False) -> DataFrame:
    """(doc_id, markdown) of pages(doc_id, page, text, source); pages count from 0, and tags name the source."""
    tag = F.concat(F.lit(" ("), F.col("source"), F.lit(")")) if tagged else F.lit("")
    part = F.concat(F.lit("<!-- page "), (F.col("page") + 1).cast("string"), tag, F.lit(" -->\n\n"), t.strip(F.coalesce("text", F.lit(""))))
    parts = F.array_sort(F.collect_list(F.struct("page", part.alias("part"))))
    return pages.groupBy("doc_id").agg(F.concat(t.strip(F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n")), F.lit("\n")).alias("markdown"))


def notebook_files(docs: DataFrame, max_tokens: int = p.NOTEBOOK_TOKENS) -> DataFrame:
    """(doc_id, file, content) of docs(doc_id, text, title, author, summary): sources for a notebook; the first one has the summary and the list."""
    parts = sections.named(sections.sections(docs, "notebook", max_tokens))
    titles = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", F.when(F.col("title") == "", p.LEAD_TITLE).otherwise(F.col("title")).alias("t")))).alias("titles"))
    facts = docs.select("doc_id", F.col("title").alias("book"), "author", "summary")
    rows = parts.join(titles, "doc_id").join(facts, "doc_id")
    first, alone = F.col("n") == 1, F.col("total") == 1
    part = F.when(alone, "").otherwise(F.concat(F.lit("part "), F.col("n").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.when(F.col("title") != "", F.concat(F.lit(": "), F.col("title"))).otherwise("")))
    contents = F.when(first & ~alone, F.transform("titles", lambda x: x["t"]))
    head = notebook_header(F.col("book"), F.col("author"), part, F.when(first, F.col("summary")), contents)
    return rows.select("doc_id", F.concat(t.source_prefix(F.col("book")), F.lit("-"), F.col("file")).alias("file"), F.concat(head, F.col("markdown")).alias("content"))


def incident_line(title: Column, next_step: Column, code: Column, ref: Column) -> Column:
    return F.concat(title, F.lit(" "), next_step, F.lit(" ("), code, F.lit(", ref "), ref, F.lit(")"))


def incident_reference(code: Column, ref: Column) -> Column:
    return F.concat(F.lit("Error "), code, F.lit(" · Ref "), ref)


def incident_details(rows: DataFrame) -> DataFrame:
    """Adds details to incidents(code, ref, where, detail, context map) by the catalog."""
    rows = rows.join(F.broadcast(routing.catalog(rows.sparkSession)), "code", "left")
    some = lambda c, label: F.when(F.col(c) != "", F.concat(F.lit(f"{label}: "), F.col(c)))
    context = F.transform(F.array_sort(F.map_entries("context")), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    lines = F.concat(F.array(incident_reference(F.col("code"), F.col("ref")), some("title", "What happened"), some("next_step", "Next step"), some("where", "Where")), F.coalesce(context, F.array().cast("array<string>")), F.array(some("detail", "Technical details")))
    return rows.withColumn("details", F.array_join(F.array_compact(lines), "\n"))


#: What the digits of codes stand for.
AREAS = {"1": "Conversion", "2": "Saving", "3": "Local models", "4": "Figures", "5": "Settings", "6": "Surroundings", "9": "Unexpected errors"}


def code_guide(catalog: DataFrame) -> DataFrame:
    """(area, markdown): a table of codes for each area."""
    area = F.element_at(F.create_map(*[F.lit(x) for kv in AREAS.items() for x in kv]), F.substring("code", 4, 1))
    mark = F.when(F.col("severity") == "warning", " *(warning)*").otherwise("")
    row = F.concat(F.lit("| "), F.col("code"), F.lit(" | "), F.col("title"), mark, F.lit(" | "), F.col("next_step"), F.lit(" |"))
    rows = F.array_sort(F.collect_list(F.struct("code", row.alias("row"))))
    return catalog.groupBy(area.alias("area")).agg(F.concat(F.lit("| Code | What happened | What to do |\n|---|---|---|\n"), F.array_join(F.transform(rows, lambda x: x["row"]), "\n")).alias("markdown"))
