from pyspark.sql import functions as F

from marlstone.plans import cleaning
from marlstone.sources import html, readers
from marlstone.streaming import incidents


def test_html():
    page = "<html><head><title>t</title><script>bad()</script></head><body><nav>menu</nav><div class='ad'>buy</div><h1>A &amp; B</h1><p><b>bold<br>next<p>para <a href='u'>link</a><ul><li>x<li>y</ul><table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td>a|b</td></tr></table><pre>c\n  d</pre>"
    got = html.to_markdown(page)
    assert got == "# A & B\n\n**bold\nnext**\n\npara [link](u)\n\n- x\n- y\n\n| h | i |\n| --- | --- |\n| 1 | a\\|b |\n\n```\nc\n  d\n```\n"
    assert html.to_markdown(None) == html.to_markdown("") == ""


def test_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.MD").write_text("one\ntwo")
    (tmp_path / "in" / "deep" / "b.txt").write_text("x")
    rows = {r.name: r for r in readers.files(spark, str(tmp_path / "in"), content=False).collect()}
    assert rows["a.MD"].suffix == "md" and rows["a.MD"].stem == "a" and rows["b.txt"].length == 1
    assert {r.text for r in readers.texts(spark, str(tmp_path / "in" / "*.MD")).collect()} == {"one\ntwo"}
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2\n[3]\n{"a": 4}\n')
    assert sorted(r.a for r in readers.json_lines(spark, "a long", str(tmp_path / "l.jsonl")).collect()) == [1, 4]
    out = spark.createDataFrame([("d/x.md", "é"), ("y.md", None)], "file string, content string")
    readers.write_files(out, str(tmp_path / "out"))
    assert (tmp_path / "out" / "d" / "x.md").read_text() == "é" and (tmp_path / "out" / "y.md").read_text() == ""
    paths = spark.createDataFrame([("/a/b.c.pdf",), ("noext",)], "p string").select(readers.output_path(F.col("p")), readers.output_path(F.col("p"), "/o")).collect()
    assert [tuple(r) for r in paths] == [("/a/b.c.md", "/o/b.c.md"), ("noext.md", "/o/noext.md")]
    names = spark.createDataFrame([("1", "s"), ("2", "s"), ("3", "t")], "path string, stem string")
    assert sorted(r.out_name for r in readers.distinct_names(names).collect()) == ["s", "s-2", "t"]


def test_clean_keeps_columns(spark):
    df = spark.createDataFrame([(1, "ﬁne", "pdflayout", 7), (2, None, None, None)], "doc_id long, text string, engine string, extra int")
    rows = cleaning.clean(df, engine="engine").orderBy("doc_id").collect()
    assert rows[0].cleaned == "fine\n" and rows[0].extra == 7 and rows[0].stats.chars_normalized == 1 and rows[1].cleaned == ""


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{m}:00", "E", "w", "d") for m in (0, 1, 6)] + [("2024-01-01 00:02:00", "F", "w", "d")]
    spark.createDataFrame(rows, "t string, code string, where string, detail string").withColumn("t", F.col("t").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("t timestamp, code string, where string, detail string").parquet(str(tmp_path / "in"))
    for name, df, mode in (("dedupe", incidents.deduped(source), "append"), ("counts", incidents.counts(source), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert spark.table("dedupe").count() == 2
    assert sorted((r.code, r.n) for r in spark.table("counts").collect()) == [("E", 1), ("E", 2), ("F", 1)]
