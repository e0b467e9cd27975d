"""Figures: which images count, which are copies, and where their links go."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.batches import slices

# --- fixed values -------------------------------------------------------------------
MIN_PIXELS, MIN_POINTS, CLIP_SLACK = 120, 18.0, 1.0
SCAN_COVER, SCAN_PAGES, MAX_FIGURES = 0.85, 0.5, 2000
MARKER = r"^\s*<!-- figure (\d+)\.(\d+) -->\s*$"
ANCHOR = r"^\s*<!-- page (\d+)(?: \([^)]*\))? -->\s*$"
_MARKER, _ANCHOR = re.compile(MARKER), re.compile(ANCHOR)


def page_images(images: DataFrame) -> DataFrame:
    """Images that count, with k, their number on the page; images(doc_id, page, seq, px_w, px_h, x0, y0, x1, y1, clip_x0, clip_y0, clip_x1, clip_y1)."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = cx.between(F.col("clip_x0") - CLIP_SLACK, F.col("clip_x1") + CLIP_SLACK) & cy.between(F.col("clip_y0") - CLIP_SLACK, F.col("clip_y1") + CLIP_SLACK)
    big = (F.least("px_w", "px_h") >= MIN_PIXELS) & (F.col("x1") - F.col("x0") >= MIN_POINTS) & (F.col("y1") - F.col("y0") >= MIN_POINTS)
    return images.where(big & inside).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("seq")))


def covers_page() -> Column:
    """An image over most of its page."""
    w = F.greatest(F.lit(0.0), F.least("x1", "clip_x1") - F.greatest("x0", "clip_x0"))
    h = F.greatest(F.lit(0.0), F.least("y1", "clip_y1") - F.greatest("y0", "clip_y0"))
    area = F.greatest(F.lit(1.0), (F.col("clip_x1") - F.col("clip_x0")) * (F.col("clip_y1") - F.col("clip_y0")))
    return w * h >= SCAN_COVER * area


def scans(images: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, is_scan): half of the pages are covered by an image; pages(doc_id, total)."""
    covered = images.where(covers_page()).groupBy("doc_id").agg(F.count_distinct("page").alias("n"))
    return pages.join(covered, "doc_id", "left").select("doc_id", (F.coalesce("n", F.lit(0)) >= SCAN_PAGES * F.col("total")).alias("is_scan"))


def distinct_figures(figures: DataFrame) -> DataFrame:
    """The first of each document's equal images (by sha1), in order of page and number, MAX_FIGURES at most as pages fill."""
    first = figures.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "sha1").orderBy("page", "k"))).where("rn = 1").drop("rn")
    before = F.count("*").over(Window.partitionBy("doc_id").orderBy("page").rangeBetween(Window.unboundedPreceding, -1))
    return first.withColumn("before", before).where(F.col("before") < MAX_FIGURES).drop("before")


def strip_markers(markdown: Column) -> Column:
    """Markdown without figure markers; a blank line after one goes with it."""
    return F.regexp_replace(markdown, r"(?m)^[ \t]*<!-- figure \d+\.\d+ -->[ \t]*\n(?:[ \t]*\n)?", "")


def link(folder: str = "images") -> Column:
    """The link of a figure(page, k, path, caption); k is null where it has no marker."""
    label = F.when(F.col("k").isNull(), F.concat(F.lit("Figure (page "), F.col("page").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("Figure "), F.col("page").cast("string"), F.lit("."), F.col("k").cast("string")))
    alt = F.translate(F.coalesce(F.nullif(F.col("caption"), F.lit("")), label), "[]", "()")
    target = F.replace(F.replace(F.url_encode(F.concat(F.lit(f"{folder}/"), F.col("path"))), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    return F.concat(F.lit("!["), alt, F.lit("]("), target, F.lit(")"))


def linked(text: str, figures: list[tuple[int, int | None, str, str]]) -> str:
    """A text with the links of figures (page, k, path, link), which stand in the order of pages.

    A marker's first use takes its figure; later ones, and those without one, go
    with a blank line after them.  What has no marker stands after its page's
    anchor, else in a list at the end.
    """
    at_marker = {(page, k): (path, link) for page, k, path, link in reversed(figures) if k is not None}
    out: list[str] = []
    anchors: dict[int, list[int]] = {}
    placed: set[str] = set()
    dropped = False
    for line in text.split("\n"):
        if dropped and not line.strip():
            dropped = False
            continue
        dropped = False
        if m := _MARKER.match(line):
            found = at_marker.pop((int(m[1]), int(m[2])), None)
            if found is None:
                dropped = True
                continue
            placed.add(found[0])
            line = found[1]
        elif m := _ANCHOR.match(line):
            anchors.setdefault(int(m[1]), []).append(len(out))
        out.append(line)
    rest = [f for f in figures if f[2] not in placed]
    loose = [link for page, _, _, link in rest if page not in anchors]
    for place, page in sorted(((i, page) for page, places in anchors.items() for i in places), reverse=True):
        out[place + 1 : place + 1] = [x for p, _, _, link in rest if p == page for x in ("", link)]
    return "\n".join([*out, *(["", "## Extracted figures", "", *(f"- {x}" for x in loose)] if loose else [])])


def link_batches(batches):
    """(doc_id, text) of batches (doc_id, text, figures)."""
    import pyarrow as pa

    for batch in slices(batches, 1):
        found = ([(f["page"], f["k"], f["path"], f["link"]) for f in x or ()] for x in batch.column(2).to_pylist())
        texts = [None if text is None else linked(text, f) for text, f in zip(batch.column(1).to_pylist(), found)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def insert_links(docs: DataFrame, figures: DataFrame, folder: str = "images") -> DataFrame:
    """(doc_id, text) with links: at a figure's marker, else after its page's anchor, else at the end.

    A document's figures, MAX_FIGURES at most, meet its text in one join; the text is gone through once.
    """
    own = figures.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "k", "path", link(folder).alias("link")))).alias("figures"))

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(own, "doc_id", "left")
    return rows.mapInArrow(link_batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")
