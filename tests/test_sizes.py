"""Queries on inputs longer, or in larger batches, than the given tables have."""

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marlstone import patterns, queries
from marlstone.functions import text as t
from marlstone.operators import batches, figures, layout, rewrites, sections
from marlstone.plans import cleaning
from marlstone.sources import html


def against_sql(spark, folder, name, **tables):
    """A query's rows and its SQL's over tables that are written to the folder."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(folder))
    cursor = con.execute(entry.oracle_sql()[name])
    order = [[c[0] for c in cursor.description].index(c) for c in got.columns]
    return sorted(map(tuple, got.collect()), key=repr), sorted((tuple(row[k] for k in order) for row in cursor.fetchall()), key=repr)


def test_page_numbers_under_long_turns(spark, tmp_path):
    words = "the river runs down to the sea and back " * 60
    turns = [(c, k, "user", words[: 1700 + 20 * k + 331 * (c > 1)]) for c in (1, 2, 3) for k in range(2 + c)]
    got, want = against_sql(spark, tmp_path, "page_furniture", conversations=spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert got == want and {(doc, page) for doc, page, _ in got} == {(doc, page) for doc, page, _, _ in turns}


def held(run, texts, at):
    """Bytes of text in each batch that a pass gives for one large batch."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), *[pa.array(["x"] * len(texts))] * (at - 1), pa.array(texts, pa.string())], names=["doc_id", *[f"c{k}" for k in range(1, at)], "text"])
    out = list(run(iter([batch])))
    assert sum(b.num_rows for b in out) >= len(texts)
    return [b.nbytes for b in out]


def test_slices_lose_nothing():
    texts = ["a" * n if n >= 0 else None for n in (5, -1, 0, 30, 9, 9, 9, 40, -1, 1)]
    whole = pa.RecordBatch.from_arrays([pa.array(["", *texts], pa.string())], names=["text"])
    parts = [p.column(0).to_pylist() for p in batches.slices([whole.slice(1), whole.slice(3, 0), whole.slice(11)], 0, 20)]
    assert sum(parts, []) == texts and all(len(p) == 1 or sum(len(x or "") for x in p) <= 20 for p in parts) and len(parts) == 6


def test_sections_of_a_large_batch_are_found_in_slices():
    assert max(held(sections.splitter("chapters", 200), ["# One\nword\n# Two\n" + "word\n" * 40_000] * 40, 1)) < 3 * batches.SLICE_BYTES


def test_links_of_a_large_batch_are_set_in_slices():
    def run(rows):
        kind = pa.list_(pa.struct([("page", pa.int32()), ("k", pa.int32()), ("path", pa.string()), ("link", pa.string())]))
        yield from figures.link_batches(pa.RecordBatch.from_arrays([*b.columns, pa.array([[{"page": 1, "k": None, "path": "a", "link": "![a](a)"}]] * b.num_rows, kind)], names=[*b.schema.names, "figures"]) for b in rows)

    assert max(held(run, ["word\n" * 40_000] * 40, 1)) < 2 * batches.SLICE_BYTES


def test_a_large_batch_is_cleaned_in_slices():
    texts = ["plain words\n" * 17_000] * 16
    assert max(held(cleaning.cleaner(1, None, {}), texts, 1)) < 4 * batches.SLICE_BYTES
    assert len(held(html.markdown_batches, ["<p>word</p>" * 20_000] * 16, 2)) > 1


def test_drawn_pages_need_no_row_a_glyph(spark, sf_dir):
    for lift in (0, 140):
        want = layout.page_segments(*queries.glyph_tables(spark, sf_dir, lift))
        assert sorted(queries.drawn_pages(spark, sf_dir, lift)[0].collect()) == sorted(want.collect())
    plan = entry.queries()["page_segments"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Join", "Window", "Sort", "split("))


def test_pages_of_a_large_batch_are_drawn_in_slices():
    turns = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array([0] * 400, pa.int32()), pa.array(["a river runs by " * 100] * 400)], names=["doc_id", "page", "text"])
    sizes = [len(s.glyphs.ch) for s in queries.drawer()(iter([turns]))]
    assert max(sizes) < 2 * queries.DRAWN_BYTES and sum(sizes) == 400 * (1200 + len("CollectedConversations1"))


def test_furniture_is_found_once(spark, sf_dir):
    plan = entry.queries()["page_reading_order"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("posexplode", "Window", "split("))


def test_language_signs_are_counted_once(spark, sf_dir):
    plan = entry.queries()["language_guess"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == len(patterns.LANGUAGES) + 2  # and two for the share of lines


def test_language_signs_are_all_found(spark):
    signs = [
        '#include <a>', '# include', '#include"b"', "std::x", "template <T>", "a->b (c)", "cout << x", "func f", "package main", "x := 1", "fmt.Print(", "go  func", "using System.IO;", "namespace A", "Console.Write", "{ get; set; }",
        "async  Task", "public record", "IActionResult", "[HttpGet", "[HttpPost", "package a.b.c;", "import a.b.c ;", "System.out.print", "@Override", "a extends B", "implements C", "const a =", "let  b=", "=> {", "=>(", "console.log(", "function f(",
        "require 'a'", "attr_reader", "attr_writer", "puts x", "do |x|", " end ", "def self.go!", "def x(y)", "elsif", "fun f(", "val x:", "val y =", "data class A", "companion object", "import kotlin.x", "import android.y", "def f(a):", "class A:", "import os", "from a import", "elif x", "self.a",
    ]
    ends = ["", "a;", "a;  ", "{\t", "}\r", " \n;", ";;\n;", "x; y", " ; ", "; \n\n", "\u0085", "a\n\n{\n", "; \n"]
    texts = [*signs, *(f"{a}\n{b}" for a, b in zip(signs, signs[1:])), *ends, *(a + "\n" + b for a in ends for b in ends), None]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    text = F.col("text")
    for r in rows.select("text", *[n.alias(k) for k, n in t.language_hits(text).items()], *[t.hits(text, p).alias(f"all_{k}") for k, p in patterns.LANGUAGES.items()], t.c_share(text).alias("share"), t.guess_language(text).alias("guess")).collect():
        assert all(r[k] == r[f"all_{k}"] for k in patterns.LANGUAGES)
        assert r.text is None or (r.share, r.guess) == (rewrites.c_share(r.text), rewrites.guess_language(r.text))
