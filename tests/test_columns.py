"""Column forms against the line forms, helpers against plain Python, and the SQL of every query."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marlstone import queries as q
from marlstone.functions import text as t
from marlstone.operators import deletions, diagnostics, figures, guards, quality, routing, sections, transcripts
from marlstone.operators import lines as ln
from marlstone.operators import rewrites as rw
from marlstone.plans.noisy import noisy

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def noise(spark, sf_dir):
    return noisy(q.table(spark, sf_dir, "documents").select("doc_id", "text")).cache()


@pytest.mark.parametrize(("name", "step"), [("page_noise", "strip_page_noise"), ("toc_tables", "strip_toc_tables"), ("plain_toc", "strip_plain_toc"), ("repeated_blocks", "strip_repeated")])
def test_window_forms_agree(noise, name, step):
    found = {r.doc_id: r.text for r in ln.assemble(deletions.kept(deletions.PASSES[name](ln.explode(noise)))).collect()}
    for r in noise.collect():
        assert found[r.doc_id] == "\n".join(getattr(rw, step)(r.text.split("\n"), rw.Counter()))


def test_line_predicates_agree(noise):
    line = F.col("line")
    pairs = {"strong": (t.is_strong_code, rw.is_strong_code), "weak": (t.is_weak_code, rw.is_weak_code), "structural": (t.is_structural, rw.is_structural), "item": (t.is_item, rw.is_item), "signal": (t.is_toc_signal, rw.is_toc_signal), "fragment": (t.is_fragment, rw.is_fragment), "footer": (t.footer_text, rw.footer_text)}
    rows = ln.explode(noise).select("line").distinct().select("line", *[c(line).alias(k) for k, (c, _) in pairs.items()]).collect()
    for r in rows:
        for k, (_, f) in pairs.items():
            assert r[k] == f(r.line), (k, r.line)


def test_languages_and_shadows_agree(noise):
    rows = noise.select("text", t.guess_language(F.col("text")).alias("g"), quality.counters(F.col("text"))["doubled_words"].alias("d")).collect()
    assert all(r.g == rw.guess_language(r.text) for r in rows)
    assert any(r.d for r in rows)


def one(spark, values, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").orderBy("i").select(*columns).collect()]


def test_helpers(spark):
    s = F.col("s")
    assert one(spark, ["Hello, World!", "***", "x" * 70], t.slugify(s)) == [("hello-world",), ("section",), ("x" * 60,)]
    assert one(spark, ["xiv", "IV", "iiii", "", "mcmxc", "mild"], t.roman_value(s)) == [(14,), (4,), (None,), (None,), (1990,), (None,)]
    assert one(spark, ["the art of a war", "a McDonald tale"], t.title_case(s)) == [("The Art of a War",), ("A McDonald Tale",)]
    assert one(spark, ["The River Book: A Tale, 2nd edition", "An Atlas 3rd Edition", "Programmer's Guide"], t.source_prefix(s)) == [("river-book",), ("atlas",), ("programmers-guide",)]
    assert one(spark, ["", "\n# T x \nb", "x\n# T"], t.document_title(s, F.lit("f"))) == [("f",), ("T x",), ("f",)]
    assert one(spark, ["don�t", "a�b", "�x"], t.repair_title(s)) == [("don’t",), ("a—b",), ("x",)]
    assert one(spark, ["# A\n", "# A\n\n<!-- p -->\n", "# A\nb", "x"], t.is_divider(s)) == [(True,), (True,), (False,), (False,)]
    assert one(spark, ["a|b " + "c" * 100], t.log_cell(s, 10)) == [("a\\|b cccc…",)]
    assert [r[0] for r in spark.createDataFrame([(5.9,), (3661.0,), (-3.0,), (600.0,)], "x double").select(t.stamp(F.col("x"))).collect()] == ["00:05", "01:01:01", "00:00", "10:00"]


def test_binary_noise_and_empty(spark):
    salad = "".join(chr(k % 256) for k in range(4000))
    rows = quality.assess(spark.createDataFrame([(0, ""), (1, None), (2, salad + " q" * 60), (3, "plain words here. " * 60)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r.score for r in rows[:2]] == [0, 0] and rows[0].issues == ["empty output"]
    assert rows[2].binary_noise and rows[2].score <= 20 and not rows[3].binary_noise and rows[3].score == 100


def test_routing(spark):
    rows = [("a.PDF", True, False, True, True, False, True, False, False, 0.2, 100, "ocr+text"), ("a.pdf", True, False, True, True, False, True, False, False, 0.1, 100, "pdflayout"), ("a.png", True, False, True, False, False, False, False, False, 0.0, 0, "ocr"), ("a.mp3", True, False, False, False, False, False, True, False, 0.0, 0, "whisper"), ("a", False, False, True, True, True, True, True, True, 0.0, 0, "missing"), ("a.pdf", True, False, False, False, True, True, False, False, 0.0, 0, "mineru"), ("a.docx", True, False, True, True, True, True, True, True, 0.0, 0, "markitdown")]
    df = spark.createDataFrame(rows, "path string, exists boolean, is_dir boolean, ocr boolean, pdf_ocr boolean, mineru boolean, layout boolean, audio boolean, anchors boolean, scanned_ratio double, body_chars int, want string")
    assert all(r.route == r.want for r in routing.route(df).collect())
    errors = ["could not open 'password.pdf': PermissionError", "file is encrypted", "x", None]
    assert one(spark, errors, routing.classify(F.col("s"))) == [("MS-102",), ("MS-101",), ("MS-199",), (None,)]
    assert one(spark, ["None", "| None |", "ok", "  "], routing.has_text(F.col("s"))) == [(False,), (False,), (True,), (False,)]
    assert one(spark, ["http://a/b.PDF?x=1", "https://a", "ftp://a/b"], routing.url_suffix(F.col("s")), routing.url_guard(F.col("s"), F.lit(1))) == [(".pdf", None), (".html", None), (".html", "MS-131")]


def test_guards(spark):
    long = "This book tells of rivers and of those who cross them. " * 20
    replies = ["<think>no</think>Summary: " + long[:100], "I'm sorry, as an AI I cannot read this document at all", "short", long, '{"summary": "' + long[:90] + '", "insufficient_content": false}', '{"summary": "x", "insufficient_content": true}']
    got = [r[0] for r in one(spark, replies, guards.clean_summary(guards.unwrap_summary(F.col("s"))))]
    assert got[0] == long[:100].strip() and got[1] is None and got[2] is None and got[3].endswith("them.") and 40 < len(got[3]) <= 600 and got[4] == long[:90].strip() and got[5] is None
    text = "a\n\n" * 9000 + "```\n" + "c\n\n" * 9000 + "```\nend"
    assert "\n".join(guards.chunks(text)) == text
    assert guards.summary_source("# A\nx\n## Introduction\ny\n# B", "T").startswith("Title: T\n\nSections: A; Introduction; B\n\nExcerpt:\n## Introduction")


def test_transcripts(spark):
    rows = [(1, 0, 0.0, 1.0, "one"), (1, 1, 1.5, 2.0, " "), (1, 2, 2.5, 3.0, "two"), (1, 3, 6.0, 7.0, "x" * 800), (1, 4, 7.0, 8.0, "after"), (2, 0, 3661.0, 3662.0, "late")]
    df = spark.createDataFrame(rows, "media_id long, seq long, start double, end double, text string")
    got = {r.media_id: r.markdown for r in transcripts.markdown(transcripts.paragraphs(df)).collect()}
    assert got == {1: f"**[00:00]** one two\n\n**[00:06]** {'x' * 800}\n\n**[00:07]** after", 2: "**[01:01:01]** late"}


def test_incident_window_is_not_refreshed(spark):
    rows = [(i, f"2024-01-01 00:00:{s:02d}", "E", "w", "d") for i, s in enumerate((0, 20, 40, 50, 59))]
    df = spark.createDataFrame(rows, "seq long, t string, code string, where string, detail string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(r.seq for r in diagnostics.deduped(df, 30).collect()) == [0, 2]


def test_figure_links(spark):
    docs = spark.createDataFrame([(1, "a\n<!-- figure 1.1 -->\nb\n<!-- figure 1.2 -->\n\nc\n<!-- page 2 -->\nd\n<!-- figure 1.1 -->\ne")], "doc_id long, text string")
    figs = spark.createDataFrame([(1, 1, 1, "x y.png", None), (1, 2, 5, "z.png", "a [b]"), (1, 9, 1, "q.png", None)], "doc_id long, page int, k int, path string, caption string")
    assert figures.insert_links(docs, figs).first().text == "a\n![Figure 1.1](images/x%20y.png)\nb\nc\n<!-- page 2 -->\n\n![a (b)](images/z.png)\nd\ne\n\n## Extracted figures\n\n- ![Figure 9.1](images/q.png)"
    assert one(spark, ["a\n<!-- figure 1.1 -->\n\nb"], figures.strip_markers(F.col("s"))) == [("a\nb",)]


def test_front_matter(spark):
    head = spark.range(1).select(sections.front_matter({"title": F.lit('a "b": c'), "author": F.lit(""), "n": F.lit(3), "none": F.lit(None).cast("string"), "x": F.lit("p\nq")})).first()[0]
    assert head == '---\ntitle: "a \\"b\\": c"\nn: 3\nx: p q\n---\n\n'


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for x in TABLES:
        con.execute(f"CREATE VIEW {x} AS SELECT * FROM '{sf_dir}/{x}.parquet'")
    df = q.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    cur = con.execute(q.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in cur.fetchall()), key=repr)
    assert sorted(names) == cols
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


#: Queries without SQL that run a pass: blocks put in (remainder of doc_id by modulus), and what must have become of them.
REPAIRED = {
    "shadow_repair": (13, 0, "The Drawing Lab of the rivers\nJob\nbookkeeper 1100 FFEEDD\n"),
    "prepress_strip": (13, 0, "\nThe DDrraawwiinngg LLaabb of the rivers\nJJJJoooobbbb\nbookkeeper 1100 FFEEDD\nreal words stay (Text) here"),
    "heading_promotion": (8, 3, "# Chapter 1: The Upper River\nbody one\n# Chapter 2: The Lower River\nbody two\n# Part II: Beyond the Open Sea\nend"),
    "fence_repair": (12, 2, "public class Reader extends Base {"),
    "code_fencing": (12, 0, "```python\nimport os\nvalue = os.getcwd()\n\nprint(value)\n```\nAnd then the prose goes on as before.\n```python\ndef reader(path):\n    return open(path)\n```"),
    "bullet_repair": (11, 0, "- first thing\n  - second thing\n- alpha item\n\n- beta item\n\nafter the list."),
    "wrap_join": (9, 1, "this line is long enough to have been broken by the page width and so goes on here without a stop at the end of what was one paragraph of parents-in-law\n\nshort\nlines\n"),
}


@pytest.mark.parametrize("name", sorted(REPAIRED))
def test_passes_repair_their_blocks(spark, sf_dir, name):
    m, k, want = REPAIRED[name]
    got = {r.doc_id: r for r in q.QUERIES[name](spark, sf_dir).collect()}
    plain_texts = {r.doc_id: r.text for r in q.table(spark, sf_dir, "documents").collect()}
    assert got.keys() == plain_texts.keys()
    for i, r in got.items():
        assert want in r.text if i % m == k else True, (i, r.text[-600:])
        assert r.text.startswith(plain_texts[i][:40]) or r.n  # what isn't counted isn't touched


def words_of(text):
    return "".join(text.split())


def test_parts_hold_their_documents(spark, sf_dir):
    text = {r.doc_id: r.text for r in q.docs(spark, sf_dir, "chapters", "images", "fence").collect()}
    for name, budget in (("hard_split", 100), ("packed_parts", 500)):
        rows = q.QUERIES[name](spark, sf_dir).orderBy("doc_id", "section_no").collect()
        whole = {}
        for r in rows:
            whole.setdefault(r.doc_id, []).append(r)
        for i, parts in whole.items():
            assert [r.section_no for r in parts] == list(range(len(parts)))
            assert words_of("".join(r.markdown for r in parts)) == words_of(text[i])
            # beyond the budget only what can't be cut: one line, or a fenced block
            assert all(r.est_tokens <= budget or "```" in r.markdown or max(map(len, r.markdown.split("\n"))) > 2 * budget for r in parts)
        assert whole.keys() == text.keys()


def test_pages_read_in_order(spark, sf_dir):
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append(r.text)
    got = {r.doc_id: r.markdown for r in q.QUERIES["page_reading_order"](spark, sf_dir).collect()}
    assert got.keys() == turns.keys()
    for i, texts in turns.items():
        if len(texts) >= 3:  # running heads are known from three pages on
            seen, drawn = words_of(got[i]), words_of("".join(x[: 40 * 50] for x in texts))
            assert "Collected" not in seen and abs(len(seen) - len(drawn)) <= 0.02 * len(drawn) + 4
            assert sorted(seen.replace("-", "").replace("|", "")) == sorted(drawn.replace("-", "").replace("|", "")) or len(drawn) != len(seen)


def test_html_keeps_words(spark, sf_dir):
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "head")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "head")

        def handle_data(self, data):
            self.out += [] if self.off else [data]

    letters = lambda s: "".join(c for c in s if c.isalnum())
    got = {r.page_id: r.markdown for r in q.QUERIES["html_to_markdown"](spark, sf_dir).collect()}
    for r in q.table(spark, sf_dir, "pages").collect():
        w = Words()
        w.feed(r.html)
        w.close()
        page = letters("".join(w.out))
        lines = [letters(x) for x in got[r.page_id].split("\n") if letters(x)]
        assert lines and all(x in page for x in lines)


def test_scores_follow_cleaning(spark, sf_dir):
    cleaned = {r.doc_id: r for r in q.QUERIES["clean_pipeline"](spark, sf_dir).collect()}
    for r in q.docs(spark, sf_dir).collect():
        want, count = rw.clean(r.text)
        assert cleaned[r.doc_id].cleaned == want and cleaned[r.doc_id].total_fixes == sum(count[k] for k in rw.COUNTERS)
        assert not any(x in want for x in ("ﬁ", "(cid:", "�" * 2, "\f", "\n\n\n"))
    for name in ("clean_outline", "clean_score_export"):
        rows = q.QUERIES[name](spark, sf_dir).collect()
        per = {}
        for r in rows:
            per.setdefault(r.doc_id, []).append(r)
        assert per and all(sorted(r.section_no for r in x) == list(range(len(x))) and len({r.score for r in x}) == 1 and 0 <= x[0].score <= 100 for x in per.values())


def test_outlines_sum_up(spark, sf_dir):
    text = {r.doc_id: r.text for r in q.docs(spark, sf_dir, "chapters").collect()}
    for r in q.QUERIES["document_outlines"](spark, sf_dir).collect():
        listed = json.loads(r.sections)
        sizes = [s["est_tokens"] for s in listed]
        assert r.est_tokens == max(1, len(text[r.doc_id]) // 4) and [s["index"] for s in listed] == list(range(len(sizes))) and abs(sum(sizes) - r.est_tokens) <= 2 * len(sizes) + 2


def test_every_query_is_checked():
    named = {*REPAIRED, "hard_split", "packed_parts", "page_reading_order", "html_to_markdown", "clean_pipeline", "clean_outline", "clean_score_export", "document_outlines"}
    assert set(q.QUERIES) == named | set(q.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
