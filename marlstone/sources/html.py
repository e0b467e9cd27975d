"""A plain reading of HTML pages as Markdown: headings, paragraphs, lists, code, tables, emphasis, links, images."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.batches import slices

HIDDEN = frozenset("head script style noscript template nav footer aside form iframe svg".split())
PARAGRAPHS = frozenset("p div section article main header figure figcaption blockquote dl dt dd table ul ol".split())
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


class Reader(HTMLParser):
    """Blocks of Markdown; a new block closes what a page left open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.now: list[str] = []
        self.prefix = ""
        self.hidden: list[str] = []
        self.lists: list[int | None] = []
        self.open: list[str] = []  # emphasis of this block
        self.links: list[str] = []
        self.pre = False
        self.rows: list[list[str]] | None = None

    def flush(self) -> None:
        while self.open:
            self.close_mark(self.open[-1])
        text = "".join(self.now)
        text = text.strip("\n") if self.pre else re.sub(r"[ \t\r\f\v]*\n[ \t\r\f\v]*", "\n", re.sub(r"[ \t\r\f\v]+", " ", text)).strip()
        if text:
            self.blocks.append(self.prefix + text)
        self.now, self.prefix = [], ""

    def close_mark(self, tag: str) -> None:
        """End an emphasis; one around nothing goes."""
        self.open.remove(tag)
        k = len(self.now)
        while k and not self.now[k - 1].strip():
            k -= 1
        if k and self.now[k - 1] == MARKS[tag]:
            del self.now[k - 1]
        else:
            self.now.append(MARKS[tag])

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.append(tag)
            return
        if tag in HIDDEN or "ad" in (attrs.get("class") or "").split():
            self.flush()
            self.hidden.append(tag)
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.prefix = "#" * int(tag[1]) + " "
        elif tag in ("td", "th") and self.rows is not None:
            self.now = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag == "li":
            self.flush()
            count = self.lists[-1] if self.lists else None
            self.prefix = "  " * (len(self.lists) - 1) + ("- " if count is None else f"{count}. ")
            if count is not None:
                self.lists[-1] = count + 1
        elif tag == "pre":
            self.flush()
            self.pre = True
        elif tag == "br":
            self.now.append("\n")
        elif tag == "hr":
            self.flush()
            self.blocks.append("---")
        elif tag == "img":
            self.now.append(f"![{attrs.get('alt') or ''}]({attrs.get('src') or ''})")
        elif tag == "a":
            self.links.append(attrs.get("href") or "")
            self.now.append("[")
        elif tag in MARKS and not self.pre and tag not in self.open:
            self.open.append(tag)
            self.now.append(MARKS[tag])
        elif tag in PARAGRAPHS:
            if self.rows is None:
                self.flush()
            if tag in ("ul", "ol"):
                self.lists.append(1 if tag == "ol" else None)
            elif tag == "table" and self.rows is None:
                self.rows = []

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        if tag in ("td", "th") and self.rows is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(re.sub(r"\s+", " ", "".join(self.now)).strip().replace("|", "\\|"))
            self.now, self.open = [], []
        elif tag == "table" and self.rows is not None:
            self.blocks += table(self.rows)
            self.rows, self.now = None, []
        elif tag == "a" and self.links:
            self.now.append(f"]({self.links.pop()})")
        elif tag in MARKS and tag in self.open:
            self.close_mark(tag)
        elif tag == "pre":
            body = "".join(self.now).strip("\n")
            self.blocks.append(f"```\n{body}\n```")
            self.now, self.pre = [], False
        elif tag in PARAGRAPHS or tag == "li" or re.fullmatch("h[1-6]", tag):
            if self.rows is None:
                self.flush()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.now.append(data)

    def markdown(self) -> str:
        self.close()
        if self.rows is not None:
            self.handle_endtag("table")
        self.flush()
        out = ""
        for a, b in zip(["", *self.blocks], self.blocks):
            item = re.compile(r"\s*(?:-|\d+\.) ")
            out += ("" if not out else "\n" if item.match(a) and item.match(b) else "\n\n") + b
        return out + "\n" if out else ""


def table(rows: list[list[str]]) -> list[str]:
    rows = [r for r in rows if r]
    if not rows:
        return []
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
    return ["\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])]


def to_markdown(html: str | None) -> str:
    if not html:
        return ""
    reader = Reader()
    reader.feed(html)
    return reader.markdown()


def markdown_batches(batches):
    """(page_id, url, markdown) of batches (page_id, url, html)."""
    import pyarrow as pa

    for batch in slices(batches, 2):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([to_markdown(x.as_py()) for x in batch.column(2)], pa.string())], names=["page_id", "url", "markdown"])


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """(page_id, url, markdown) of every page; a null html is empty."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(markdown_batches, "page_id long, url string, markdown string")
