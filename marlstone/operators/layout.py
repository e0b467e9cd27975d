"""Glyph tables to Markdown: pages in parallel, what recurs over pages by aggregates, documents put together at the end.

glyphs(doc_id, page, idx, obj, ch, x0, y0, x1, y1, quad, mono, space_before, break_before)
pages(doc_id, page, quad, clip_x0, clip_y0, clip_x1, clip_y1); page counts from 0
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import TYPE_CHECKING, NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as t
from marlstone.operators import geometry as g
from marlstone.storage import Scratch

if TYPE_CHECKING:
    import pyarrow as pa

# --- fixed values ------------------------------------------------------------------------
FURNITURE_PAGES, FOLIO_SHARE, MONO_SHARE, MAX_LEVEL = 3, 0.2, 0.35, 4
FOLIO = r"(?i)^[\[(\-–—|\s]*(?:page\s+)?(\d{1,4}|[ivxlcdm]{1,7})[\])\-–—|\s]*$"
WORDS = "array<struct<text:string,x0:double,x1:double>>"
SEGMENT = f"struct<text:string,x0:double,y0:double,x1:double,y1:double,h:double,cw:double,mono:boolean,words:{WORDS},figure:string,edge:boolean,outermost:boolean>"
SEGMENTS = f"doc_id long, page int, segments array<{SEGMENT}>"
BLOCKS = "doc_id long, page int, kind string, text string, h double"
DOCUMENTS = "doc_id long, markdown string, title string, author string"
#: Rows of glyphs that are worked on at a time; a page is never cut.
GLYPHS = 50_000
#: Pages of a batch whose segments are read at a time.
PAGES = 500


def lists(values: list, sizes: list[int]):
    """An Arrow list column from the items of all rows, one after another."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


def whole_pages(batches) -> Iterator:
    """Glyph rows sorted by their first two columns as tables of whole pages, of about GLYPHS rows, or one larger page."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= GLYPHS:
            doc, page = batch.column(0), batch.column(1)
            same = (doc.to_numpy(zero_copy_only=False) == held[-1].column(0)[-1].as_py()) & (page.to_numpy(zero_copy_only=False) == held[-1].column(1)[-1].as_py())
            cut = batch.num_rows if same.all() else int(same.argmin())
            held.append(batch.slice(0, cut))
            if cut == batch.num_rows:
                continue
            yield pa.Table.from_batches(held).combine_chunks()
            held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def grouped(batches, n_keys: int) -> Iterator[tuple]:
    """(key, rows) of rows sorted by their first ``n_keys`` columns, over batches; one group is held at a time."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, group in groupby(rows, key=lambda row: row[:n_keys]):
        yield key, [row[n_keys:] for row in group]


def batch_of(rows: list[tuple], ddl: str):
    """An Arrow batch of flat rows; workers have no session to read the schema with."""
    import pyarrow as pa

    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


class Sheets(NamedTuple):
    """Pages with their glyphs, which come in order of their page's number; the other columns have an entry a page."""

    doc_id: pa.Array
    page: pa.Array
    quad: np.ndarray
    clip: np.ndarray
    glyphs: g.Glyphs
    number: np.ndarray


def segment_batch(sheets: Sheets):
    """One row a page that has any glyphs, its segments and their words nested."""
    import pyarrow as pa

    segs, number = g.all_segments(sheets.glyphs, sheets.number, sheets.quad, sheets.clip)
    edge, outermost = g.all_edges(segs, number, sheets.clip, sheets.quad)
    words = lists(pa.StructArray.from_arrays([pa.array(segs.word, pa.string()), pa.array(segs.span[:, 0]), pa.array(segs.span[:, 1])], ["text", "x0", "x1"]), np.bincount(segs.owner, minlength=len(segs)).tolist())
    columns = {"text": pa.array(segs.text, pa.string()), **{n: pa.array(segs.box[:, k]) for k, n in enumerate(("x0", "y0", "x1", "y1"))}, "h": pa.array(segs.h), "cw": pa.array(segs.cw), "mono": pa.array(segs.mono), "words": words, "figure": pa.array(segs.figure, pa.string()), "edge": pa.array(edge), "outermost": pa.array(outermost)}
    segments = lists(pa.StructArray.from_arrays(list(columns.values()), list(columns)), np.bincount(number, minlength=len(sheets.page)).tolist())
    rows = pa.RecordBatch.from_arrays([sheets.doc_id.cast(pa.int64()), sheets.page.cast(pa.int32()), segments], names=["doc_id", "page", "segments"])
    drawn = np.bincount(sheets.number, minlength=len(sheets.page)) > 0
    return rows if drawn.all() else rows.filter(pa.array(drawn))


def read_pages(column) -> Iterator[g.Page]:
    """Pages from the list array of their segments."""
    offsets, segments = np.asarray(column.offsets), column.values
    segments = segments.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = (offsets - offsets[0]).tolist()
    field = lambda k: segments.field(segments.type.get_field_index(k))
    number = lambda k: field(k).to_numpy(zero_copy_only=False)
    words, text, figure = field("words"), field("text").to_pylist(), field("figure").to_pylist()
    box, h, cw, mono = np.stack([number(k) for k in ("x0", "y0", "x1", "y1")], axis=1), number("h"), number("cw"), number("mono").astype(bool)
    inner, starts = words.flatten(), np.asarray(words.offsets)
    per, starts = np.diff(starts), starts - starts[0]
    word, span = inner.field(0).to_pylist(), np.stack([inner.field(k).to_numpy(zero_copy_only=False) for k in (1, 2)], axis=1)
    for a, b in zip(offsets, offsets[1:]):
        of = slice(starts[a], starts[b])
        yield g.Page(text[a:b], box[a:b], h[a:b], cw[a:b], mono[a:b], figure[a:b], word[of], span[of], np.repeat(np.arange(b - a), per[a:b]))


def page_segments(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, segments): line segments of every page that has any glyphs, with marks for those that may be furniture.

    Glyphs are dealt and sorted once; from here on a page is one row.
    """
    rows = glyphs.join(pages.withColumnRenamed("quad", "page_quad"), ["doc_id", "page"])
    rows = rows.select("doc_id", "page", "idx", "page_quad", "clip_x0", "clip_y0", "clip_x1", "clip_y1", "ch", "x0", "y0", "x1", "y1", "quad", "mono", "space_before", "break_before", "obj")

    def run(batches):
        import pyarrow as pa

        for table in whole_pages(batches):
            column = lambda k: table[k].to_numpy()  # noqa: E731,B023
            new = np.append(True, (column("doc_id")[1:] != column("doc_id")[:-1]) | (column("page")[1:] != column("page")[:-1]))
            boxes = lambda *names: np.stack([column(k).astype(float) for k in names], axis=1)  # noqa: E731,B023
            glyph = g.Glyphs(table["ch"].to_pylist(), boxes("x0", "y0", "x1", "y1"), *(column(k) for k in ("quad", "mono", "space_before", "break_before", "idx", "obj")))
            keys = [table[k].combine_chunks().filter(pa.array(new)) for k in ("doc_id", "page")]
            yield segment_batch(Sheets(*keys, column("page_quad")[new], boxes("clip_x0", "clip_y0", "clip_x1", "clip_y1")[new], glyph, np.cumsum(new) - 1))

    return rows.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "idx").mapInArrow(run, SEGMENTS)


def drawn_segments(source: DataFrame, draw: Callable[[Iterator], Iterator[Sheets]]) -> DataFrame:
    """page_segments() of pages that an engine draws: ``draw`` takes Arrow batches of the source and gives Sheets.

    Glyphs stay in the worker that drew them, so a page is one row throughout and is never dealt out.
    """
    return source.mapInArrow(lambda batches: map(segment_batch, draw(batches)), SEGMENTS)


def learnt_offsets(folios: DataFrame, total: DataFrame) -> DataFrame:
    """(doc_id, a_off, r_off): the difference of page and printed number that most pages have, in figures and in roman numerals; the one seen first of equals."""
    per = folios.groupBy("doc_id", "arabic", "off").agg(F.count("*").alias("n"), F.min(F.struct("page", "seg")).alias("first"))
    rank = Window.partitionBy("doc_id", "arabic").orderBy(F.desc("n"), "first")
    top = per.withColumn("rn", F.row_number().over(rank)).where("rn = 1").join(total, "doc_id")
    top = top.where(F.col("n") >= F.when(F.col("arabic"), F.greatest(F.lit(2.0), FOLIO_SHARE * F.col("total"))).otherwise(2.0))
    return top.groupBy("doc_id").agg(F.max(F.when(F.col("arabic"), F.col("off"))).alias("a_off"), F.max(F.when(~F.col("arabic"), F.col("off"))).alias("r_off"))


def furniture(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, seg) of running headers and page numbers."""
    text = F.col("text")
    token = F.lower(F.regexp_extract(text, FOLIO, 1))
    edge = segments.select("doc_id", "page", F.posexplode("segments").alias("seg", "s")).where("s.edge").select("doc_id", "page", "seg", "s.text", "s.outermost")
    edge = edge.select("*", t.furniture_key(text).alias("key"), F.nullif(token, F.lit("")).alias("token"))
    arabic = F.col("token").rlike(r"^\d+$")
    edge = edge.withColumn("value", F.when(arabic, F.col("token").cast("int")).otherwise(t.roman_value(F.col("token")))).withColumn("arabic", arabic)
    recurring = edge.groupBy("doc_id", "key").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= FURNITURE_PAGES).where(F.regexp_count("key", F.lit("[A-Za-z]")) >= 2).select("doc_id", "key", F.lit(True).alias("recurs"))
    folios = edge.where("outermost and value is not null").withColumn("off", F.col("page") + 1 - F.col("value"))
    total = pages.groupBy("doc_id").agg((F.max("page") + 1).alias("total"))
    rows = edge.join(recurring, ["doc_id", "key"], "left").join(learnt_offsets(folios, total), "doc_id", "left")
    trimmed = t.strip(text)
    number = F.coalesce(F.nullif(F.regexp_extract(trimmed, r"^(\d{1,4})\b", 1), F.lit("")), F.nullif(F.regexp_extract(trimmed, r"\b(\d{1,4})$", 1), F.lit(""))).cast("int")
    here = F.col("page") + 1
    folio = F.when(F.col("arabic"), F.col("value") == here - F.col("a_off")).otherwise(F.col("value") == here - F.col("r_off"))
    beside = F.col("outermost") & (t.count_words(text) <= 5) & (number == here - F.col("a_off"))
    drop = F.when(F.col("recurs"), True).when(F.col("token").isNotNull(), folio).otherwise(beside)
    return rows.where(F.coalesce(drop, F.lit(False))).select("doc_id", "page", "seg")


def figure_segments(figures: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, segments) of figures(doc_id, page, k, x0, y0, x1, y1), upright like their page's text."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    turn = lambda a, b, c, d: F.when(F.col("quad") == 1, b).when(F.col("quad") == 2, c).when(F.col("quad") == 3, d).otherwise(a)
    rows = figures.join(pages.select("doc_id", "page", "quad"), ["doc_id", "page"])
    key = F.concat((F.col("page") + 1).cast("string"), F.lit("."), F.col("k").cast("string"))
    no = F.lit(False)
    segment = F.struct(
        F.lit("").alias("text"), turn(x0, y0, -x1, -y1).alias("x0"), turn(y0, -x1, -y1, x0).alias("y0"), turn(x1, y1, -x0, -y0).alias("x1"), turn(y1, -x0, -y0, x1).alias("y1"),
        F.lit(0.0).alias("h"), F.lit(0.0).alias("cw"), no.alias("mono"), F.array().cast(WORDS).alias("words"), key.alias("figure"), no.alias("edge"), no.alias("outermost"),
    ).cast(SEGMENT)
    ordered = F.array_sort(F.collect_list(F.struct("k", segment.alias("s"))))
    return rows.groupBy("doc_id", "page").agg(F.transform(ordered, lambda x: x["s"]).alias("drawn"))


def outline_headings(outline: DataFrame) -> DataFrame:
    """(doc_id, page, seq, depth, title) from bookmarks(doc_id, seq, level, title, page).

    Repeats, subtrees of repeats and front matter go; the shallowest level with
    two real entries is 1.  Title pages stay with depth 0.
    """
    rows = outline.withColumn("title", t.repair_title(t.squash(F.col("title")))).where("title <> '' and page is not null")
    schema = "doc_id long, page int, seq int, depth int, title string"

    def run(batches):
        for (doc,), entries in grouped(batches, 1):
            seen, dup = set(), []
            for _, _, title, page in entries:
                dup.append((g.norm(title), page) in seen)
                seen.add((g.norm(title), page))
            out = []
            for k, (seq, level, title, page) in enumerate(entries):
                end = next((j for j in range(k + 1, len(entries)) if entries[j][1] <= level), len(entries))
                if not dup[k] and not (end > k + 1 and all(dup[k + 1 : end])):
                    out.append((seq, level, title, page))
            real = [(level, title) for _, level, title, _ in out if not g.is_front_title(title)]
            levels = sorted({level for _, level, _, _ in out})
            base = next((x for x in levels if sum(level == x for level, _ in real) >= 2), levels[0] if levels else 0)
            depth = lambda level, title: 0 if g.is_front_title(title) else min(MAX_LEVEL, 1 + max(0, level - base))  # noqa: E731,B023
            yield batch_of([(doc, page, seq, depth(level, title), title) for seq, level, title, page in out if not g.is_front_title(title) or g.norm(title) in g.TITLE_PAGES], schema)

    rows = rows.select("doc_id", "seq", "level", "title", "page").repartition("doc_id").sortWithinPartitions("doc_id", "seq")
    return rows.mapInArrow(run, schema)


def without_furniture(segments: DataFrame, drop: DataFrame) -> DataFrame:
    """Pages without the segments (doc_id, page, seg) of ``drop``."""
    drop = drop.groupBy("doc_id", "page").agg(F.collect_set("seg").alias("drop"))
    kept = F.filter("segments", lambda _, k: ~F.array_contains(F.coalesce("drop", F.array().cast("array<int>")), k))
    return segments.join(drop, ["doc_id", "page"], "left").select("doc_id", "page", kept.alias("segments"))


def page_blocks(segments: DataFrame, headings: DataFrame | None = None, pages: DataFrame | None = None, recognized: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, blocks): blocks of every page in reading order; fixed-pitch text is fenced unless it is a document's body.

    ``pages`` adds those without text; ``recognized`` (doc_id, page, text) holds
    pages whose text was recognized from an image, and stands for what they draw.
    """
    size = lambda x: F.length(x["text"])
    total = lambda test: F.aggregate(F.filter("segments", lambda x: (x["figure"] == "") & test(x)), F.lit(0), lambda acc, x: acc + size(x))
    share = segments.groupBy("doc_id").agg((F.sum(total(lambda x: x["mono"])) < MONO_SHARE * F.sum(total(lambda x: F.lit(True)))).alias("fence"), F.sum(total(lambda x: F.lit(True))).alias("n"))
    share = share.select("doc_id", (F.col("fence") | (F.col("n") == 0)).alias("fence"))
    rows = segments if pages is None else pages.select("doc_id", "page").join(segments, ["doc_id", "page"], "left")
    rows = rows.join(share, "doc_id", "left")
    heads = "array<struct<seq:int,depth:int,title:string>>"
    if headings is None:
        rows = rows.withColumn("heads", F.lit(None).cast(heads))
    else:
        found = headings.where("depth > 0").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "depth", "title"))).alias("heads"))
        rows = rows.join(found, ["doc_id", "page"], "left")
    rows = rows.withColumn("recognized", F.lit(None).cast("string")) if recognized is None else rows.join(recognized.select("doc_id", "page", F.col("text").alias("recognized")), ["doc_id", "page"], "left")
    rows = rows.select("doc_id", "page", F.coalesce("fence", F.lit(True)).alias("fence"), "heads", "recognized", F.coalesce("segments", F.array().cast(f"array<{SEGMENT}>")).alias("segments"))

    def run(batches):
        import pyarrow as pa

        for batch in (b.slice(k, PAGES) for b in batches for k in range(0, b.num_rows, PAGES)):
            out: list[list[g.Block]] = []
            for fence, heads_, text, page in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), read_pages(batch.column(5))):
                blocks = g.page_blocks(page, fence) if text is None else [g.Block("para", text.strip())] * bool(text.strip())
                out.append(g.place_headings(blocks, [(h["depth"], h["title"]) for h in heads_ or ()]) if heads_ else blocks)
            flat = [b for blocks in out for b in blocks]
            values = pa.StructArray.from_arrays([pa.array([b.kind for b in flat], pa.string()), pa.array([b.text for b in flat], pa.string()), pa.array([float(b.h) for b in flat], pa.float64())], ["kind", "text", "h"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(values, list(map(len, out)))], names=["doc_id", "page", "blocks"])

    return rows.mapInArrow(run, "doc_id long, page int, blocks array<struct<kind:string,text:string,h:double>>")


def documents(blocks: DataFrame, anchors: bool = False, headings: DataFrame | None = None, metadata: DataFrame | None = None, recognized: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown, title, author): paragraphs rejoined over columns and, without anchors, over pages.

    Title and author come from metadata(doc_id, title, author), a bookmarked
    title page, the copyright page or an unmarked title page.
    """
    rows = blocks.withColumn("ocr", F.lit(False)) if recognized is None else blocks.join(recognized.select("doc_id", "page", F.lit(True).alias("ocr")).distinct(), ["doc_id", "page"], "left")
    if metadata is None:
        rows = rows.withColumns({"meta_title": F.lit(None).cast("string"), "meta_author": F.lit(None).cast("string")})
    else:
        rows = rows.join(metadata.select("doc_id", F.col("title").alias("meta_title"), F.col("author").alias("meta_author")).dropDuplicates(["doc_id"]), "doc_id", "left")
    if headings is None:
        rows = rows.withColumn("marked", F.lit(False))
    else:
        rows = rows.join(headings.where("depth = 0").select("doc_id", "page", F.lit(True).alias("marked")).distinct(), ["doc_id", "page"], "left")
    rows = rows.select("doc_id", "page", F.coalesce("ocr", F.lit(False)).alias("ocr"), "meta_title", "meta_author", F.coalesce("marked", F.lit(False)).alias("marked"), "blocks")

    def run(batches):
        for (doc,), found in grouped(batches, 1):
            numbers = [r[0] for r in found]
            pages = [[g.Block(b["kind"], b["text"], b["h"]) for b in r[5]] for r in found]
            by_number = [[] for _ in range(max(numbers) + 1)] if max(numbers) < 10 * len(numbers) else pages
            for k, p in zip(numbers, pages):
                if by_number is not pages:
                    by_number[k] = p
            title, author = g.title_and_author(by_number, found[0][2], found[0][3], [r[0] for r in found if r[4]])
            whole = [g.merged(p) for p in pages]
            whole = whole if anchors else g.merged_pages(whole)
            any_ocr = any(r[1] for r in found)
            parts = []
            for (page, ocr, *_), blocks_ in zip(found, whole):
                kind = (" (ocr)" if ocr else " (text)") if any_ocr else ""
                parts += [f"<!-- page {page + 1}{kind} -->"] * anchors + [f"<!-- figure {b.text} -->" if b.kind == "fig" else b.text for b in blocks_ if b.text.strip()]
            text = g.SURROGATE.sub("", "\n\n".join(parts))
            yield batch_of([(doc, g.resolve_hyphens(g.repair_ligatures(text)).strip() + "\n", title, author)], DOCUMENTS)

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "page").mapInArrow(run, DOCUMENTS)


def extract(glyphs: DataFrame, pages: DataFrame, figures: DataFrame | None = None, outline: DataFrame | None = None, anchors: bool = False, metadata: DataFrame | None = None, recognized: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown, title, author) of every document of a page table.

    With ``figures``, marks stand where they lie, for figures.insert_links().
    Pages in ``recognized`` (doc_id, page, text) read as that text and take no
    part in what recurs over pages, but keep their numbers.  Segments and
    furniture are written once to the shared folder, as they are read again.
    """
    drawn = glyphs if recognized is None else glyphs.join(recognized.select("doc_id", "page"), ["doc_id", "page"], "left_anti")
    return assembled(page_segments(drawn, pages), pages, figures, outline, anchors, metadata, recognized)


def assembled(segments: DataFrame, pages: DataFrame, figures: DataFrame | None = None, outline: DataFrame | None = None, anchors: bool = False, metadata: DataFrame | None = None, recognized: DataFrame | None = None) -> DataFrame:
    """extract() from (doc_id, page, segments), which hold none of the recognized pages."""
    scratch = Scratch(segments.sparkSession, "layout")
    segs = scratch.keep(segments, "segments")
    body = without_furniture(segs, scratch.keep(furniture(segs, pages), "furniture"))
    if figures is not None:
        shown = figures if recognized is None else figures.join(recognized.select("doc_id", "page"), ["doc_id", "page"], "left_anti")
        empty = F.array().cast(f"array<{SEGMENT}>")
        body = body.join(figure_segments(shown, pages), ["doc_id", "page"], "full").select("doc_id", "page", F.concat(F.coalesce("segments", empty), F.coalesce("drawn", empty)).alias("segments"))
    heads = outline_headings(outline) if outline is not None else None
    return documents(page_blocks(body, heads, pages, recognized), anchors, heads, metadata, recognized)


def page_summary(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, kind, n) of the blocks of pages."""
    return blocks.select("doc_id", "page", F.explode("blocks").alias("b")).groupBy("doc_id", "page", F.col("b.kind").alias("kind")).agg(F.count("*").alias("n"))
