import json
import zipfile

from pyspark.sql import functions as F

from marlstone.__main__ import Engines, main
from marlstone.plans import reading
from marlstone.settings import Settings


def test_settings(tmp_path):
    f = tmp_path / "s.json"
    assert Settings.load(f) == Settings()
    f.write_text(json.dumps({"ocr_device": "x", "enable_ocr": 0, "ollama_endpoint": " http://a/ ", "split_chapters": True, "ai_target": None, "other": 1}))
    s = Settings.load(f)
    assert (s.ocr_device, s.enable_ocr, s.ollama_endpoint, s.export_style, s.ai_target) == ("auto", False, "http://a", "chapters", "Claude")
    s.save(tmp_path / "d" / "t.json")
    assert Settings.load(tmp_path / "d" / "t.json") == s
    f.write_text("{")
    assert Settings.load(f) == Settings() and (tmp_path / "s.json.bad").read_text() == "{"


def test_reading(spark):
    docs = spark.createDataFrame([(1, "# A\nx\n# B\ny\n"), (2, "plain"), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in reading.outlines(docs, 100, "none").collect()}
    assert rows[1].title == "A" and [s.title for s in rows[1].sections] == ["A", "B"] and rows[2].sections[0].title == "(document)"
    wanted = spark.createDataFrame([(1, 1), (1, 5)], "doc_id long, section_no int")
    assert {(r.section_no, r.markdown, r.error_code) for r in reading.section(docs, wanted).collect()} == {(1, "# B\ny\n", None), (5, None, "MS-132")}
    files = {r.file: r.content for r in reading.notebook_files(docs.where("doc_id = 1").withColumns({"title": F.lit("The Tale: x"), "author": F.lit("Me"), "summary": F.lit("Sum")})).collect()}
    assert files["tale-01-a.md"] == "*The Tale: x* by Me — part 1 of 2: A\n\nSummary: Sum\n\nThis document is split into 2 sources:\n\n1. A\n2. B\n\n---\n\n# A\nx\n"
    assert files["tale-02-b.md"] == "*The Tale: x* by Me — part 2 of 2: B\n\n---\n\n# B\ny\n"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "more").mkdir()
    (tmp_path / "in" / "a.html").write_text("<h1>One</h1><p>text</p><h1>Two</h1><p>more</p>")
    (tmp_path / "more" / "a.md").write_text("another a")
    (tmp_path / "in" / "b.txt").write_text("• item")
    (tmp_path / "in" / "c.xyz").write_bytes(b"\x00")
    (tmp_path / "in" / "e.txt").write_text("  ")
    out = tmp_path / "out"
    assert main(["convert", str(tmp_path / "in"), str(tmp_path / "more"), str(tmp_path / "no*where"), "--out", str(out), "--json", "--quality", "--debug", str(tmp_path / "trace")], spark) == 1
    said = {x["path"].rsplit("/", 1)[-1]: x for x in map(json.loads, capsys.readouterr().out.splitlines()) if x["path"].rsplit("/", 1)[-1] != "a.md"}
    assert {k: x.get("error_code") for k, x in said.items()} == {"a.html": None, "b.txt": None, "c.xyz": "MS-105", "e.txt": "MS-106", "no*where": "MS-103"}
    assert said["a.html"]["quality"]["headings"] == 2 and said["c.xyz"]["next_step"]
    assert (out / "a.md").read_text().endswith("# One\n\ntext\n\n# Two\n\nmore\n") and (out / "a-2.md").read_text().endswith("another a\n") and (out / "b.md").read_text().endswith("- item\n")
    assert "session.end" in (tmp_path / "trace" / "events.jsonl").read_text()
    assert main(["convert", str(tmp_path / "in" / "*.html"), "--out", str(tmp_path / "book"), "--split-chapters", "--no-front-matter"], spark) == 0
    assert {p.name for p in (tmp_path / "book" / "a").iterdir()} == {"01-one.md", "02-two.md", "index.md", "manifest.json"}
    assert (tmp_path / "book" / "a" / "01-one.md").read_text() == "# One\n\ntext\n"
    assert main(["convert", str(tmp_path / "in" / "*.html"), "--out", str(tmp_path / "nb"), "--ai-target", "Gemini Notebook"], spark) == 0
    assert len(list((tmp_path / "nb" / "a").iterdir())) == 2
    capsys.readouterr()
    assert main(["capabilities"]) == main(["codes"]) == 0
    assert main(["convert", "bad://x/y", "--out", str(out)], spark) == 2 and "MS-900" in capsys.readouterr().err


def test_engines_on_the_command_line(spark, tmp_path, capsys):
    for name, data in (("p.pdf", b"pdf"), ("q.pdf", b"bad"), ("i.png", b"png"), ("m.mp3", b"mp3")):
        (tmp_path / name).write_bytes(data)

    def pdf(data):
        if data == b"bad":
            raise ValueError("PDFSyntaxError: No /Root object")
        return "<!-- page 1 -->\n\n# Title\n\n<!-- figure 1.1 -->\n\nThe text of the page."

    engines = Engines(pdf, lambda data: "seen", lambda data: {"language": "en", "probability": 1.0, "engine": "w", "segments": [(0, 1, "heard")]}, lambda prompt, schema: json.dumps({"summary": "A page with a title and one line of text, as short as it is.", "insufficient_content": False}))
    assert main(["convert", str(tmp_path / "*.*"), "--out", str(tmp_path / "out"), "--summarize"], spark, engines) == 1
    assert "MS-107" in capsys.readouterr().out
    text = (tmp_path / "out" / "p.md").read_text()
    assert "summary: \"A page with a title" in text or "summary: A page with a title" in text
    assert text.endswith("# Title\n\nThe text of the page.") or text.endswith("# Title\n\nThe text of the page.\n")
    assert "# OCR: i.png\n\nseen" in (tmp_path / "out" / "i.md").read_text() and "**[00:00]** heard" in (tmp_path / "out" / "m.md").read_text()
    assert main(["convert", str(tmp_path / "p.pdf"), "--out", str(tmp_path / "o2"), "--no-layout"], spark, engines) == 1
    assert main(["convert", str(tmp_path / "p.pdf"), "--out", str(tmp_path / "o3"), "--anchors", "--images", "--no-front-matter"], spark, engines) == 0
    assert (tmp_path / "o3" / "p.md").read_text().startswith("<!-- page 1 -->") and "<!-- figure 1.1 -->" in (tmp_path / "o3" / "p.md").read_text()


def test_diagnostics_command(spark, tmp_path, capsys):
    (tmp_path / "s1" / "snapshots").mkdir(parents=True)
    (tmp_path / "s1" / "snapshots" / "x.md").write_text("text")
    (tmp_path / "s1" / "events.jsonl").write_text('{"t": "2024-01-01T00:00:00", "rel": 1.5, "ev": "ui.stall", "gap_ms": 1200, "last_event": "x"}\n{"torn": ')
    (tmp_path / "errors.jsonl").write_text('{"t": "2024-01-01T00:00:00", "code": "MS-106", "severity": "error", "title": "T", "ref": "r", "where": "w", "detail": "d"}\nnot json\n')
    assert main(["diagnostics", str(tmp_path), "--report", str(tmp_path / "r.zip"), "--no-snapshots"], spark) == 0
    said = capsys.readouterr().out
    assert "1 incident(s) — 1 error." in said and "- 1200 ms at +1.5 s after `x`" in said
    assert set(zipfile.ZipFile(tmp_path / "r.zip").namelist()) == {"digest.md", "errors.jsonl", "s1/events.jsonl"}
