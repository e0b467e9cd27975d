"""Layout-aware rendering of HTML to text.

A tokenizer and a tree builder (a stack of open elements with implied start and
end tags) drive a renderer.  Everything visible comes out: blocks on lines of
their own, paragraphs and the like between blank lines, list items with
markers and indents, table cells in aligned columns, preformatted text as it
stands.  Heads, scripts, styles, comments, hidden and undisplayed elements and
the closed part of details don't.  Of svg, text elements and foreign objects come
out; of math, everything but annotations.

Work is linear in the page's length for pages of bounded depth; memory holds the
open elements, the text, and the cells of open tables.

Defined cases: a null or empty html gives an empty text; broken markup is
closed at the end; a table cell keeps to its columns over the rows that it spans,
within its row group, and wide characters take two columns; style sheets in the
page count where a selector is an element, classes, an id, or these together, and
outside at-rules, so that what other rules hide comes out; rows with equal or null page_id are pages of their own.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from html import unescape
from itertools import accumulate
from typing import NamedTuple
from unicodedata import category, east_asian_width

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
UNSEEN = frozenset("head script style template noscript noembed noframes iframe object canvas audio video datalist title meta link base param source track".split())
#: Blocks with a blank line around them, and blocks with a line of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre listing xmp table figure hr fieldset".split())
PLAIN = frozenset("html body address article aside center details dialog div dd dt figcaption footer form header hgroup legend li main nav optgroup option search section summary".split())
BLOCKS = SPACED | PLAIN
LISTS = frozenset("ul ol menu dir".split())
#: Elements whose start closes an open paragraph.
CLOSES_P = BLOCKS - {"html", "body", "option", "optgroup", "legend"}
#: For these, a start tag closes the named ones if they're open within the scope.
CLOSED_BY = {
    "li": (("li",), LISTS), "dt": (("dt", "dd"), {"dl"}), "dd": (("dt", "dd"), {"dl"}), "option": (("option",), {"select", "datalist"}), "optgroup": (("option", "optgroup"), {"select"}),
    "tr": (("td", "th", "tr", "caption", "colgroup"), {"table"}), "td": (("td", "th"), {"table", "tr"}), "th": (("td", "th"), {"table", "tr"}),
    "tbody": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), {"table"}), "thead": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), {"table"}),
    "tfoot": (("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"), {"table"}), "caption": (("caption",), {"table"}),
}
#: Spans beyond these count as these, as HTML has it.
MAX_COLUMNS, MAX_ROWS = 1000, 65534
ROW_GROUPS = frozenset("tbody thead tfoot".split())
#: Roots of foreign content; there, ``/>`` closes an element.
FOREIGN = ("svg", "math")
#: Elements of it that aren't rendered where they stand, those whose texts stand apart, and those with HTML inside.
FOREIGN_UNSEEN = frozenset("defs desc symbol metadata clippath mask pattern marker annotation annotation-xml".split())
APART = frozenset("text mtr mtd".split())
INTEGRATION = frozenset("foreignobject mi mo mn ms mtext".split())
#: HTML whose start tag ends foreign content.
LEAVES_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: An end tag outside doesn't close anything beyond these.
SCOPES = frozenset("table td th caption html template".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_LETTER = re.compile("[a-zA-Z]")
_BARE_END = re.compile(r"""=\s*[^\s"'>][^\s>]*/$""")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_RAW_END = {k: re.compile(rf"</{k}(?=[\s/>])[^>]*>", re.IGNORECASE) for k in RAW}
_SPAN = re.compile(r"\s*\+?(\d{1,9})")
_BLANK = re.compile(r"[ \t\n\r\f]+")
_DISPLAY = re.compile(r"display\s*:\s*([\w-]+)", re.IGNORECASE)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in _ATTR.findall(source):
        out.setdefault(k.lower(), unescape(v[1:-1] if v[:1] in "\"'" and v else v))
    return out


_HTML_COMMENT = re.compile(r"<!--.*?(?:-->|$)", re.DOTALL)
_SHEET = re.compile(r"<style\b([^>]*)>(.*?)(?:</style|$)", re.DOTALL | re.IGNORECASE)
_AT_RULE = re.compile(r"/\*.*?\*/|@[^{};]*(?:;|\{(?:[^{}]|\{[^{}]*\})*\})", re.DOTALL)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SELECTOR = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)")


class Sheets:
    """What a page's style sheets say of display and visibility, by the name, class or id that a rule needs."""

    def __init__(self, html: str):
        self.rules: dict[str, list[tuple]] = {}
        if "<style" not in html and "<STYLE" not in html:
            return
        for n, (tag, source) in enumerate(_SHEET.findall(_HTML_COMMENT.sub("", html))):
            if attributes(tag).get("media", "all").strip().lower() not in ("", "all", "screen"):
                continue
            for k, (selectors, body) in enumerate(_RULE.findall(_AT_RULE.sub(" ", source))):
                said = [m[-1].lower() if (m := p.findall(body)) else None for p in (_DISPLAY, _VISIBILITY)]
                if any(said):
                    for selector in selectors.split(","):
                        self.add(selector.strip(), (n, k), said)

    def add(self, selector: str, order: tuple, said: list[str | None]) -> None:
        m = _SELECTOR.fullmatch(selector)
        if not m or not selector:
            return
        name = (m[1] or "*").lower()
        marks = re.findall(r"[.#][\w-]+", m[2])
        ids = sum(x[0] == "#" for x in marks)
        weight = (ids, len(marks) - ids, name != "*", *order)
        self.rules.setdefault(marks[0] if marks else name, []).append((weight, name, frozenset(marks), said))

    def look(self, name: str, attrs: dict[str, str]) -> tuple[str | None, str | None]:
        """Display and visibility of an element; the weightiest rule decides each."""
        marks = {f".{c}" for c in attrs.get("class", "").split()} | ({f"#{attrs['id'].strip()}"} if attrs.get("id") else set())
        found = [r for key in (name, "*", *marks) for r in self.rules.get(key, ()) if r[1] in ("*", name) and r[2] <= marks]
        display = visibility = None
        for _, _, _, said in sorted(found, key=lambda r: r[0]):
            display, visibility = said[0] or display, said[1] or visibility
        return display, visibility


class Flow:
    """Lines of text; a table cell has one of its own."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0  # blank lines wanted before the next line
        self.indents: list[str] = []
        self.marker: str | None = None
        self.space = False  # a collapsed space is due

    def write(self, text: str) -> None:
        if not text:
            return
        if text[0] == " ":
            self.space = True
            text = text[1:]
            if not text:
                return
        if self.space and self.now:
            self.now.append(" ")
        self.space = text[-1] == " "
        self.now.append(text[:-1] if self.space else text)

    def end_line(self, always: bool = False) -> None:
        if self.now or always:
            body = "".join(self.now)
            if self.gap and self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            indent = "".join(self.indents)
            if self.marker is not None:
                indent = indent[: len(indent) - len(self.marker)] + self.marker
                self.marker = None
            self.lines.append((indent + body).rstrip(" "))
            self.now = []
        self.space = False

    def block(self, blank: bool) -> None:
        self.end_line()
        if blank:
            self.gap = 1

    def raw(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self.now.append(first)
        for x in rest:
            self.end_line(always=True)
            if x:
                self.now.append(x)

    def text(self) -> str:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones and format characters none."""
    if text.isascii():
        return len(text)
    return sum(2 if east_asian_width(c) in "WF" else 0 if category(c) in ("Mn", "Me", "Cf") else 1 for c in text)


class Cell(NamedTuple):
    lines: list[str]
    columns: int
    rows: int  # 0: to the end of its row group


class Table:
    """Rows of cells of an open table."""

    def __init__(self):
        self.rows: list[list[Cell]] = []
        self.groups: list[int] = []  # rows at which a row group begins
        self.captions: list[str] = []

    def grid(self) -> list[list[tuple[int, int, Cell]]]:
        """Each row's cells with their first column and the row after their last: a cell takes the first columns that no cell from above reaches into."""
        out, free = [], {}  # free: column -> row at which it's free again
        ends = [*sorted({g for g in self.groups if 0 < g < len(self.rows)}), len(self.rows)]
        for i, row in enumerate(self.rows):
            end, at, placed = ends[bisect_right(ends, i)], 0, []
            for cell in row:
                while free.get(at, 0) > i:
                    at += 1
                to = min(end, i + cell.rows) if cell.rows else end
                if to > i + 1:
                    free.update(dict.fromkeys(range(at, at + cell.columns), to))
                placed.append((at, to, cell))
                at += cell.columns
            out.append(placed)
        return out

    def lines(self) -> list[str]:
        """Cells in columns, each as wide as its widest line; a cell over several columns doesn't widen them.

        A row is as high as its highest cell of one row; a higher cell over
        several rows adds to the last of them.  Cells without text take no room.
        """
        cells = [(i, at, to, cell) for i, row in enumerate(self.grid()) for at, to, cell in row if any(cell.lines)]
        widths: dict[int, int] = {}
        height = [0] * len(self.rows)
        for i, at, to, cell in cells:
            widths.setdefault(at, 0)
            if cell.columns == 1:
                widths[at] = max(widths[at], *map(width, cell.lines))
            if to == i + 1:
                height[i] = max(height[i], len(cell.lines))
        for i, _, to, cell in sorted(cells, key=lambda x: x[2]):
            if to > i + 1:
                height[to - 1] += max(0, len(cell.lines) - sum(height[i:to]))
        known = sorted(widths)
        start = dict(zip(known, accumulate((widths[c] + 2 for c in known), initial=0)))
        top = list(accumulate(height, initial=0))
        rows: list[list[tuple[int, str]]] = [[] for _ in range(top[-1])]
        for i, at, _, cell in cells:
            for k, x in enumerate(cell.lines, top[i]):
                if x:
                    rows[k].append((start[at], x))
        out = []
        for row in rows:
            parts, size = [], 0
            for at, x in sorted(row):
                pad = max(at - size, 2 if size else 0)
                parts.append(" " * pad + x)
                size += pad + width(x)
            out.append("".join(parts).rstrip(" "))
        return out


class Renderer:
    """The stack of open elements, and what they render to."""

    def __init__(self, html: str = ""):
        self.sheets = Sheets(html)
        self.flow = Flow()
        self.flows: list[Flow] = []
        self.tables: list[Table] = []
        self.stack: list[tuple[str, bool, bool, object]] = []  # name, shown, visible, what to undo
        self.open: Counter = Counter()
        self.counts: list[list] = []  # of open lists: next number or None
        self.pre = 0

    # tree builder ----------------------------------------------------------
    def within(self, names, stop) -> int:
        """Stack index of the innermost open element of ``names`` that no ``stop`` element hides, or -1."""
        if not any(self.open[n] for n in names):
            return -1
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name in names:
                return k
            if name in stop:
                return -1
        return -1

    def close_to(self, k: int) -> None:
        while len(self.stack) > k:
            self.leave()

    def foreign(self) -> int:
        """Stack index of the svg or math element whose content is read, or -1 where that is HTML."""
        return self.within(FOREIGN, INTEGRATION) if self.open["svg"] or self.open["math"] else -1

    def start(self, name: str, source: str) -> None:
        if name in ("html", "body", "head") and self.open[name]:
            return
        if self.open["head"] and name not in ("meta", "link", "base", "title", "style", "script", "noscript", "template", "head"):
            self.close_to(self.within(("head",), ()))
        if name in CLOSES_P:
            k = self.within(("p",), SCOPES)
            if k >= 0:
                self.close_to(k)
        if name in CLOSED_BY:
            names, stop = CLOSED_BY[name]
            while (k := self.within(names, stop)) >= 0:
                self.close_to(k)
        if name in ("td", "th") and self.within(("tr",), {"table"}) < 0 and self.open["table"]:
            self.enter("tr", {})
        self.enter(name, attributes(source) if source else {})
        if name in VOID:
            self.leave()

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
            return
        if name in ("html", "body") or name in VOID:
            return
        k = self.within((name,), SCOPES - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {name})
        if k >= 0:
            self.close_to(k)

    # renderer --------------------------------------------------------------
    def enter(self, name: str, attrs: dict[str, str]) -> None:
        _, shown, visible, _ = self.stack[-1] if self.stack else ("", True, True, None)
        style = attrs.get("style", "")
        display, visibility = self.sheets.look(name, attrs) if self.sheets.rules else (None, None)
        if style:
            display = m[-1].lower() if (m := _DISPLAY.findall(style)) else display
            visibility = m[-1].lower() if (m := _VISIBILITY.findall(style)) else visibility
        if shown:
            if name in UNSEEN or "hidden" in attrs or display == "none" or name == "dialog" and "open" not in attrs:
                shown = False
            elif (name in FOREIGN_UNSEEN or attrs.get("display") == "none") and self.foreign() >= 0:
                shown = False
            elif name != "summary" and self.stack and self.stack[-1][0] == "details" and self.stack[-1][3] == "closed":
                shown = False
        if visibility:
            visible = visibility == "visible"
        undo: object = None
        flow = self.flow
        if shown:
            if name in BLOCKS:
                flow.block(name in SPACED and not (name in LISTS and self.counts))
            if name in APART and self.foreign() >= 0:
                flow.write(" ")
            if name == "br":
                flow.end_line(always=True)
            elif name == "details":
                undo = "open" if "open" in attrs else "closed"
            elif name in LISTS:
                number = attrs.get("start", "1")
                self.counts.append([int(number) if re.fullmatch(r"-?\d{1,9}", number) else 1] if name == "ol" else [None])
                undo = "list"
            elif name == "li":
                count = self.counts[-1] if self.counts else [None]
                if re.fullmatch(r"-?\d{1,9}", attrs.get("value", "")) and count[0] is not None:
                    count[0] = int(attrs["value"])
                mark = "- " if count[0] is None else f"{count[0]}. "
                if count[0] is not None:
                    count[0] += 1
                flow.marker = mark
                flow.indents.append(" " * len(mark))
                undo = "indent"
            elif name in ("blockquote", "dd"):
                flow.indents.append("    ")
                undo = "indent"
            elif name in ("pre", "listing", "xmp", "textarea"):
                self.pre += 1
                undo = "pre"
            elif name == "table":
                self.tables.append(Table())
                undo = "table"
            elif name == "tr" and self.tables:
                self.tables[-1].rows.append([])
            elif name in ROW_GROUPS and self.tables:
                self.tables[-1].groups.append(len(self.tables[-1].rows))
            elif name in ("td", "th", "caption") and self.tables:
                self.flows.append(flow)
                self.flow = Flow()
                columns, rows = (_SPAN.match(attrs.get(k, "")) for k in ("colspan", "rowspan"))
                undo = ("cell", name, min(max(1, int(columns[1])), MAX_COLUMNS) if columns else 1, min(int(rows[1]), MAX_ROWS) if rows else 1)
            elif name == "input" and attrs.get("type", "").lower() in ("submit", "button", "reset") and visible:
                flow.write(attrs.get("value", ""))
        self.stack.append((name, shown, visible, undo))
        self.open[name] += 1

    def leave(self) -> None:
        name, shown, _, undo = self.stack.pop()
        self.open[name] -= 1
        if not shown:
            return
        if name in APART and self.foreign() >= 0:
            self.flow.write(" ")
        if undo == "list":
            self.counts.pop()
        elif undo == "pre":
            self.pre -= 1
        elif undo == "table":
            self.flow.block(True)
            table = self.tables.pop()
            for line in [*table.captions, *table.lines()]:
                self.flow.now.append(line)
                self.flow.end_line(always=True)
        elif name in ROW_GROUPS and self.tables:
            self.tables[-1].groups.append(len(self.tables[-1].rows))
        elif isinstance(undo, tuple):
            lines = self.flow.text().split("\n")
            self.flow = self.flows.pop()
            if undo[1] == "caption":
                self.tables[-1].captions.extend(x for x in lines if x)
            else:
                if not self.tables[-1].rows:
                    self.tables[-1].rows.append([])
                self.tables[-1].rows[-1].append(Cell(lines, undo[2], undo[3]))
        if name in BLOCKS:
            self.flow.block(name in SPACED and not (name in LISTS and self.counts))
        if undo == "indent":
            self.flow.indents.pop()
            self.flow.marker = None

    def text(self, data: str) -> None:
        if self.stack:
            name, shown, visible, undo = self.stack[-1]
            if not shown or not visible or undo == "closed":
                return
        if self.open["svg"] and not self.open["text"] and not self.open["foreignobject"]:
            return
        if "&" in data:
            data = unescape(data)
        if self.pre:
            self.flow.raw(data)
        else:
            self.flow.write(_BLANK.sub(" ", data))

    def feed(self, html: str) -> str:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self.text(html[at:])
                break
            if lt > at:
                self.text(html[at:lt])
            at = lt
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                at = n if end < 0 else end + 3
                continue
            nxt = html[at + 1 : at + 2]
            if html.startswith("<![CDATA[", at) and (self.foreign() >= 0 or self.stack and self.stack[-1][0] in INTEGRATION and (self.open["svg"] or self.open["math"])):
                end = html.find("]]>", at + 9)
                self.text(html[at + 9 : n if end < 0 else end].replace("&", "&amp;"))
                at = n if end < 0 else end + 3
                continue
            if nxt in ("!", "?") or nxt == "/" and not _LETTER.match(html, at + 2):
                end = html.find(">", at + 2)
                at = n if end < 0 else end + 1
                continue
            m = _TAG.match(html, at) or _LOOSE.match(html, at)
            if not m:
                if _LETTER.match(nxt) or nxt == "/":  # a tag that never ends
                    break
                self.text("<")
                at += 1
                continue
            at, name = m.end(), m[2].lower()
            if m[1]:
                self.end(name)
                continue
            root = self.foreign()
            if root >= 0 and name in LEAVES_FOREIGN:
                self.close_to(root)
                root = -1
            self.start(name, m[3])
            if (root >= 0 or name in FOREIGN) and m[3].endswith("/") and not _BARE_END.search(m[3]):
                if name not in VOID:
                    self.leave()
                continue
            if name in RAW:
                end = _RAW_END[name].search(html, at)
                inner = html[at : end.start() if end else n]
                if name in ("textarea", "xmp"):
                    self.text(inner if name == "textarea" else inner.replace("&", "&amp;"))
                at = end.end() if end else n
                self.end(name)
        self.close_to(0)
        return self.flow.text()


def render(html: str | None) -> str:
    return Renderer(html).feed(html) if html else ""


def renderer(batches):
    import pyarrow as pa

    for batch in batches:
        out = [render(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["page_id", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text and n_chars of every row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("html").cast("string"))
    return rows.mapInArrow(renderer, "page_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
