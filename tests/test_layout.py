"""Pages drawn glyph by glyph, and what is read from them."""

import random
from typing import NamedTuple

import numpy as np
import pytest

from marlstone.operators import geometry as g
from marlstone.operators import layout

CLIP = (0.0, 0.0, 600.0, 800.0)


class Glyph(NamedTuple):
    ch: str
    x0: float
    y0: float
    x1: float
    y1: float
    quad: int
    mono: bool
    space: bool
    brk: bool
    idx: int
    obj: int


def columns(rows):
    c = list(zip(*rows)) if rows else [()] * 11
    return g.Glyphs(list(c[0]), np.array(c[1:5], dtype=float).T.reshape(-1, 4), *(np.array(x) for x in (c[5], np.array(c[6], dtype=bool), np.array(c[7], dtype=bool), np.array(c[8], dtype=bool), c[9], c[10])))


def segments(rows, quad=0, clip=CLIP):
    return g.segments(columns(rows), quad, clip)


def words(page, k):
    return [w for w, o in zip(page.word, page.owner) if o == k]


def draw(text, x, y, size=10.0, mono=False, first=0, obj=1):
    x, y, w, out, space = float(x), float(y), 0.55 * size, [], False
    for k, ch in enumerate(text):
        if ch == " ":
            space = True
            continue
        out.append(Glyph(ch, x + k * w, y, x + k * w + 0.9 * w, y + size, 0, mono, space, False, first + k, obj))
        space = False
    return out


def page(*runs):
    out = []
    for n, r in enumerate(runs):
        text, x, y, *more = r
        out += draw(text, x, y, *more, first=1000 * n, obj=n)
    return out


def read(glyphs):
    segs, _ = segments(glyphs)
    return [b.text for b in g.page_blocks(segs, True)]


def test_segments_and_copies():
    glyphs = page(("Hello world", 50, 700), ("Right", 300, 700))
    segs, _ = segments(glyphs)
    assert segs.text == ["Hello world", "Right"] and words(segs, 0) == ["Hello", "world"]
    shadow = [x._replace(x0=x.x0 + 0.5, x1=x.x1 + 0.5, idx=x.idx + 5000, obj=99) for x in glyphs]
    segs, count = segments(glyphs + shadow)
    assert len(segs) == 2 and count["copies"] == len(glyphs)
    _, count = segments([x._replace(y0=900.0, y1=910.0) for x in glyphs])
    assert count["clipped"] == len(glyphs)
    turned = [x._replace(x0=-x.y1 + 800, y0=x.x0, x1=-x.y0 + 800, y1=x.x1, quad=1) for x in glyphs]
    assert segments(turned, 1, (0.0, 0.0, 800.0, 600.0))[0].text == ["Hello world", "Right"]


def test_two_columns_read_one_after_the_other():
    left = [(f"left column text number {k} goes", 50, 700 - 13 * k) for k in range(6)]
    right = [(f"right column text number {k} goes", 330, 693.4 - 13 * k) for k in range(6)]
    text = "\n".join(read(page(*[r for pair in zip(left, right) for r in pair])))
    assert text.index("left column text number 5") < text.index("right column text number 0")


def test_table_rows_and_code():
    rows = [("Name", 50, 700), ("1.5", 200, 700), ("2.5", 300, 700), ("Other", 50, 685), ("3.5", 200, 685), ("4.5", 300, 685), ("Third", 50, 670), ("5.5", 200, 670), ("6.5", 300, 670)]
    assert read(page(*rows)) == ["| Name  | 1.5 | 2.5 |\n| ----- | --- | --- |\n| Other | 3.5 | 4.5 |\n| Third | 5.5 | 6.5 |"]
    toc = [x for k in range(4) for x in ((f"Chapter on rivers {k}", 50, 700 - 13 * k), (str(10 * k + 3), 400, 700 - 13 * k))]
    assert read(page(*toc)) == [f"Chapter on rivers {k} {10 * k + 3}" for k in range(4)]
    assert read(page(("def f(x):", 50, 700, 10.0, True), ("return x", 72, 687, 10.0, True))) == ["```\ndef f(x):\n    return x\n```"]


def test_paragraphs():
    lines = [("The river runs down from the hills and into the wide", 50, 700), ("valley where the town stands. It is broad there and qui-", 50, 687), ("et.", 50, 674), ("A new one", 80, 661)]
    assert read(page(*lines)) == ["The river runs down from the hills and into the wide valley where the town stands. It is broad there and qui\x02et.", "A new one"]
    assert g.resolve_hyphens("qui\x02et well\x02known a well-known 24\x02hour x\x02 \x02y") == "quiet well-known a well-known 24-hour x- y"
    assert g.rejoined("a sentence that is broken off by the end of the", "page goes on") == "a sentence that is broken off by the end of the page goes on"
    assert g.rejoined("It ended there, as all things do in the end.", "page") is None


def test_headings_and_titles():
    blocks = [g.Block("para", "Chapter 1"), g.Block("para", "The River"), g.Block("para", "text")]
    assert [b.text for b in g.place_headings(blocks, [(1, "Chapter 1: The River")])] == ["# Chapter 1: The River", "text"]
    assert [b.text for b in g.place_headings(blocks[2:], [(2, "Other")])] == ["## Other", "text"]
    assert g.title_of([g.Block("para", "A Book", 30.0), g.Block("para", "of rivers", 28.0), g.Block("para", "by someone", 10.0)]) == "A Book of rivers"
    assert g.visible_box((10, 10, 90, 90), (0, 0, 100, 100)) == (10, 10, 90, 90) and g.visible_box((10, 10, 20, 20), (0, 0, 100, 100)) == (0, 0, 100, 100)


@pytest.mark.parametrize(("text", "want"), [("di\x81erent e\x81ect", "different effect"), ("undi\x96erentiated", "undifferentiated"), ("a\xa0b", "a b"), ("o\xadce", "office"), ("plain", "plain"), ("x\x05y", "xy"), ("\x1featre and theatre", "Theatre and theatre")])
def test_ligatures(text, want):
    assert g.repair_ligatures(text) == want


def test_whole_documents(spark):
    glyphs, pages, figs = [], [], []
    for doc in (1, 2):
        for n in range(5):
            runs = [("A History of Rivers", 50, 780), (f"The water of page {n} runs on and on until it meets the", 50, 600), ("sea, and there it ends." if n else "sea here", 50, 587), (str(n + 3), 290, 10)]
            glyphs += [(doc, n, x.idx, x.obj, x.ch, *x[1:5], x.quad, x.mono, x.space, x.brk) for x in page(*runs)]
            pages.append((doc, n, 0, *CLIP))
    figs.append((1, 2, 1, 100.0, 100.0, 300.0, 300.0))
    G = spark.createDataFrame(glyphs, "doc_id long, page int, idx int, obj int, ch string, x0 double, y0 double, x1 double, y1 double, quad int, mono boolean, space_before boolean, break_before boolean")
    P = spark.createDataFrame(pages, "doc_id long, page int, quad int, clip_x0 double, clip_y0 double, clip_x1 double, clip_y1 double")
    X = spark.createDataFrame(figs, "doc_id long, page int, k int, x0 double, y0 double, x1 double, y1 double")
    O = spark.createDataFrame([(1, 0, 1, "Cover", 0), (1, 1, 1, "One", 1), (1, 2, 2, "Sub", 2), (1, 3, 1, "Two", 3), (1, 4, 1, "Two", 3)], "doc_id long, seq int, level int, title string, page int")
    got = {r.doc_id: r.markdown for r in layout.extract(G, P, X, O).collect()}
    assert "History" not in got[1] and "\n3\n" not in got[1] and not got[1].rstrip().endswith("7")
    body = [f"The water of page {n} runs on and on until it meets the sea, and there it ends." for n in range(1, 5)]
    first = "The water of page 0 runs on and on until it meets the sea here"
    assert got[2] == "\n\n".join([first, *body]) + "\n"
    assert got[1] == "\n\n".join([first, "# One", body[0], "## Sub", body[1], "<!-- figure 3.1 -->", "# Two", body[2], body[3]]) + "\n"
    anchored = {r.doc_id: r.markdown for r in layout.extract(G, P, anchors=True).collect()}
    assert anchored[2].startswith("<!-- page 1 -->\n\nThe water of page 0")
    assert [r.markdown for r in layout.extract(G.limit(0), P).collect()] == ["\n"] * 2 and layout.extract(G.limit(0), P.limit(0)).count() == 0


def test_labels_and_values_stay_in_rows():
    rows = [x for k in range(4) for x in ((f"Label {k}", 50, 700 - 16 * k), (f"what the label number {k} stands for in words", 160, 700 - 16 * k))]
    assert read(page(*rows)) == [f"Label {k} what the label number {k} stands for in words" for k in range(4)] or "\n".join(read(page(*rows))).index("Label 1") > "\n".join(read(page(*rows))).index("number 0")


def test_headline_over_columns_comes_first():
    runs = [("A headline that runs over both columns below", 50, 760, 20.0)]
    runs += [(f"left text line {k} of the page that is long enough", 50, 700 - 13 * k) for k in range(5)] + [(f"right text line {k} of the page", 380, 700 - 13 * k) for k in range(5)]
    text = "\n".join(read(page(*runs)))
    assert text.index("headline") < text.index("left text line 0") < text.index("left text line 4") < text.index("right text line 0")


def test_lists_and_bullets_keep_their_marks():
    items = [("•", 50, 700), ("first point that is made", 65, 700), ("•", 50, 686), ("second point", 65, 686), ("1.", 50, 672), ("numbered", 75, 672)]
    assert read(page(*items)) == ["• first point that is made", "• second point", "1. numbered"]


def test_raised_marks_and_drop_of_height():
    base = draw("water", 50, 700)
    note = [Glyph("2", 50 + 5 * 5.5, 705.5, 50 + 5 * 5.5 + 3, 711.0, 0, False, False, False, 900, 1)]
    more = draw("flows", 50 + 5 * 5.5 + 8, 700, first=1000)
    assert segments(base + note + more)[0].text == ["water2 flows"]


def test_ligature_parts_share_a_box():
    f = draw("e", 50, 700) + [Glyph(c, 56.0, 700.0, 64.0, 710.0, 0, False, False, False, 10 + k, 5) for k, c in enumerate("ffi")] + draw("cient", 64.5, 700, first=20)
    segs, count = segments(f)
    assert segs.text == ["efficient"] and not count["copies"]


def test_code_in_sentences_and_lists_isnt_fenced():
    lines = [("The function called", 50, 700, 10.0, False), ("run_all", 50, 687, 10.0, True), ("starts it all.", 50, 674, 10.0, False)]
    assert not any("```" in x for x in read(page(*lines)))
    assert not any("```" in x for x in read(page(("1. first_name", 50, 700, 10.0, True), ("2. last_name", 50, 687, 10.0, True))))
    segs, _ = segments(page(("def f(x):", 50, 700, 10.0, True), ("return x", 72, 687, 10.0, True)))
    assert not any(b.kind == "code" for b in g.page_blocks(segs, False))


def with_figures(segs, *boxes):
    rows = [(segs.text[k], segs.box[k].tolist(), segs.h[k], segs.cw[k], segs.mono[k], [(w, *s) for w, s, o in zip(segs.word, segs.span.tolist(), segs.owner) if o == k]) for k in range(len(segs))]
    return g.page_of(rows + [("", list(map(float, b)), 0.0, 0.0, False, []) for b in boxes], [""] * len(segs) + [f"1.{k + 1}" for k in range(len(boxes))])


def test_figures_in_place_and_behind_text():
    segs, _ = segments(page(("text above the figure here", 50, 700), ("text below the figure here", 50, 300)))
    assert [b.text for b in g.page_blocks(with_figures(segs, (50, 400, 250, 600)), True)] == ["text above the figure here", "1.1", "text below the figure here"]
    assert [b.text for b in g.page_blocks(with_figures(segs, (40, 250, 400, 750)), True)][0] == "1.1"
    assert g.page_blocks(with_figures(segments([])[0], (1, 1, 9, 9)), True) == [g.Block("fig", "1.1")] and g.page_blocks(segments([])[0], True) == []


def test_continued_paragraphs_of_pages_and_columns():
    assert g.rejoined("A sentence that ends with a dangling word like this one, the", "Museum stands beside it.") == "A sentence that ends with a dangling word like this one, the Museum stands beside it."
    assert g.rejoined("A sentence that ends with a dangling word like this one, the", "Figure 3 shows it.") is None and g.rejoined("too short, and", "next") is None
    assert g.rejoined("the word is bro-", "ken here") == "the word is bro\x02ken here" and g.rejoined("# Heading that is rather long and open", "goes on") is None
    pages = [[g.Block("para", "a page that stops in the middle of what it has to"), g.Block("fig", "1.1")], [g.Block("fig", "2.1"), g.Block("para", "say, and then ends.")], []]
    assert g.merged_pages(pages) == [[g.Block("para", "a page that stops in the middle of what it has to say, and then ends."), g.Block("fig", "1.1")], [g.Block("fig", "2.1")], []]


TITLES = [
    ([["Names: x", "Title: made by hand : the long guide / Ann Example ; Bob Other. Description: first"]], None, None, [], ("Made by Hand", "Ann Example")),
    ([["River Design", "Third Edition", "Copyright © 2020 Press"]], "9781234567890.pdf", "", [], ("River Design, Third Edition", "")),
    ([["River Design", "Copyright (c) 2020 Press"]], "Untitled", "Jo Doe", [], ("River Design", "Jo Doe")),
    ([["x"], ["The Book of", "Rivers"]], "", None, [1], ("The Book of Rivers", "")),
    ([[], ["The Book of Rivers", "by Someone"], ["text"]], None, None, [], ("The Book of Rivers by Someone", "")),
    ([["Contents", "1 One 5"]], None, None, [], ("", "")),
    ([["x"]], "A Fine Title", "The Author", [0], ("A Fine Title", "The Author")),
]


@pytest.mark.parametrize(("pages", "title", "author", "marked", "want"), TITLES)
def test_title_and_author(pages, title, author, marked, want):
    assert g.title_and_author([[g.Block("para", x, 12.0) for x in p] for p in pages], title, author, marked) == want


def test_inline_text_is_cleaned():
    assert g.clean_inline("Di\x81erent\x02ly  \ud800made\n\x05") == "Differently made" and g.sane_meta("report.pdf") == "" and g.sane_meta(" A  Title ") == "A Title" and g.sane_meta(None) == ""


def test_recognized_pages_and_metadata(spark):
    glyphs, pages = [], []
    for n in range(4):
        if n != 1:
            runs = [("Notes on Water", 50, 780), (f"Page {n} says what it says, and then it stops.", 50, 600), (str(n + 1), 290, 10)]
            glyphs += [(1, n, x.idx, x.obj, x.ch, *x[1:5], x.quad, x.mono, x.space, x.brk) for x in page(*runs)]
        pages.append((1, n, 0, *CLIP))
    G = spark.createDataFrame(glyphs, "doc_id long, page int, idx int, obj int, ch string, x0 double, y0 double, x1 double, y1 double, quad int, mono boolean, space_before boolean, break_before boolean")
    P = spark.createDataFrame(pages, "doc_id long, page int, quad int, clip_x0 double, clip_y0 double, clip_x1 double, clip_y1 double")
    R = spark.createDataFrame([(1, 1, " Seen on a scan.\n")], "doc_id long, page int, text string")
    M = spark.createDataFrame([(1, "Water", "A. Author")], "doc_id long, title string, author string")
    got = layout.extract(G, P, anchors=True, metadata=M, recognized=R).first()
    assert (got.title, got.author) == ("Water", "A. Author")
    assert got.markdown == "\n\n".join(["<!-- page 1 (text) -->", "Page 0 says what it says, and then it stops.", "<!-- page 2 (ocr) -->", "Seen on a scan.", "<!-- page 3 (text) -->", "Page 2 says what it says, and then it stops.", "<!-- page 4 (text) -->", "Page 3 says what it says, and then it stops."]) + "\n"
    O = spark.createDataFrame([(1, 0, 1, "Title Page", 0), (1, 1, 1, "Part", 2)], "doc_id long, seq int, level int, title string, page int")
    got = layout.extract(G, P, outline=O).first()
    assert got.title.startswith("Page 0 says") and "# Part" in got.markdown and "Title Page" not in got.markdown


def odd_page(rng):
    """Lines with marks, raised and overlapping glyphs, fixed pitch, wide gaps, copies, and glyphs of another quadrant."""
    rows, y, quad = [], 900.0, rng.choice((0, 0, 0, 1, 2, 3))
    even = rng.random() < 0.4
    for _ in range(rng.randrange(12)):
        x, h, mono = rng.choice((50.0, 72.0, 200.0)), rng.choice((8.0, 10.0, 10.0, 14.0)), rng.random() < 0.2
        for k in range(rng.randrange(1, 40)):
            small = not even and rng.random() < 0.03
            w = 5.5 if even else rng.choice((5.5, 5.5, 5.0, 0.0))
            rows.append((rng.choice("abcdefil.•1)-" if even else "abcdefil.•1)- \t\x01"), x, y + small * h / 3, x + w, y + (small / 3 + 1 - small / 2) * h, quad if rng.random() < 0.98 else (quad + 1) % 4, mono, rng.random() < 0.15, k == 0 and rng.random() < 0.3, len(rows), rng.choice((1, 1, 2))))
            if not even and rng.random() < 0.05:
                old = rng.choice(rows)
                rows.append((old[0], old[1] + 0.5, old[2], old[3] + 0.5, *old[4:9], len(rows), 2))
            x += 6 + rng.choice((0.0, 0.0, 0.0, 0.3, 3.0, 9.5, 20.0)) - (not even) * rng.choice((0.0, 0.0, 0.0, 7.0))
        y -= 14.0 if even else rng.choice((14.0, 9.0, 5.0, 0.0))
    columns_ = list(zip(*rows)) or [()] * 11
    arrays = [np.array(columns_[k], dtype=t) for k, t in zip(range(5, 11), (int, bool, bool, bool, int, int))]
    return g.Glyphs(list(columns_[0]), np.array([r[1:5] for r in rows], dtype=float).reshape(-1, 4), *arrays), quad, rng.choice(((0.0, 0.0, 500.0, 1000.0), (60.0, 830.0, 300.0, 1000.0)))


def test_many_pages_at_once_are_as_one_by_one():
    rng = random.Random(3)
    for _ in range(20):
        pages = [odd_page(rng) for _ in range(20)]
        glyphs = g.Glyphs([c for p, _, _ in pages for c in p.ch], *(np.concatenate([p[k] for p, _, _ in pages]) for k in range(1, 8)))
        quad, clip = np.array([q for _, q, _ in pages]), np.array([c for _, _, c in pages])
        segs, number = g.all_segments(glyphs, np.repeat(np.arange(20), [len(p.ch) for p, _, _ in pages]), quad, clip)
        marks = g.all_edges(segs, number, clip, quad)
        for k, page in enumerate(pages):
            at, want = np.flatnonzero(number == k), g.segments(*page)[0]
            assert all(np.array_equal(a, b) for a, b in zip(segs.take(at), want))
            assert all(np.array_equal(a[at], b) for a, b in zip(marks, g.edges(want, page[2], page[1])))
