"""What callers bring: readers, servers, models; and the traces and digests of runs."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from marlstone import tracing
from marlstone.operators import adapters, guards, models, quality, transcripts
from marlstone.plans import digest, reading
from marlstone.sources import readers


def test_what_a_callable_raises_stays_with_its_row(spark):
    rows = spark.createDataFrame([("/a/x.png", b"12"), ("y.png", b""), ("z.png", b"bad")], "path string, content binary")

    def recognize(content):
        if content == b"bad":
            raise OSError("torn")
        return " one\ntwo " if content else None

    got = {r.path: (r.markdown, r.error) for r in adapters.recognized_images(rows, recognize).collect()}
    assert got == {"/a/x.png": ("# OCR: x.png\n\none\ntwo\n", None), "y.png": (f"# OCR: y.png\n\n{adapters.NO_TEXT}\n", None), "z.png": (None, "OSError: torn")}
    pages = spark.createDataFrame([(1, 0, b"p"), (1, 1, b"bad")], "doc_id long, page int, image binary")
    assert [(r.page, r.text, r.error) for r in adapters.recognized_pages(pages, recognize).orderBy("page").collect()] == [(0, "one\ntwo", None), (1, "", "OSError: torn")]


@pytest.mark.parametrize(("reply", "want"), [('{"md_content": " ", "markdown": "# a"}', "# a"), ('{"content": "c"}', "c"), ("plain *text* ", "plain *text*"), ('{"other": 1}', None), (None, None), ("[1]", None)])
def test_layout_server(spark, reply, want):
    rows = spark.createDataFrame([("f.pdf", b"x")], "path string, content binary")
    assert [r.markdown for r in adapters.layout_server(rows, lambda name, content: reply).collect()] == [want]


def test_transcripts(spark):
    rows = spark.createDataFrame([("/v/talk.mp3", b"t"), ("quiet.mp3", b"q")], "path string, content binary")

    def transcribe(content):
        return {"language": "en", "probability": 0.987, "engine": "e (small)", "segments": [(0, 2, " Hello "), (2.5, 4, "there."), (70, 71, "Later.")]} if content == b"t" else {"language": None, "probability": None, "engine": "e", "segments": []}

    got = {r.path: r.markdown for r in transcripts.documents(adapters.transcribed(rows, transcribe)).collect()}
    assert got["/v/talk.mp3"] == "# Transcript: talk.mp3\n\n**Detected language:** en (99% confidence)\n**Engine:** e (small)\n\n---\n\n**[00:00]** Hello there.\n\n**[01:10]** Later.\n"
    assert got["quiet.mp3"] == f"# Transcript: quiet.mp3\n\n**Detected language:** unknown\n**Engine:** e\n\n---\n\n{transcripts.NO_SPEECH}\n"


def test_glyphs_are_folded(spark):
    glyph = lambda ch, idx: {"page": 0, "idx": idx, "obj": 1, "ch": ch, "x0": 1.0, "y0": 0.0, "x1": 2.0, "y1": 1.0, "quad": 0, "mono": False}
    rows = spark.createDataFrame([(7, b"")], "doc_id long, content binary")
    got = adapters.read_glyphs(rows, lambda content: [glyph("a", 0), glyph(" ", 1), glyph("\ud83d", 2), glyph("\ude00", 3), glyph("\n", 4), glyph("b", 5)]).orderBy("idx").collect()
    assert [(r.ch, r.space_before, r.break_before) for r in got] == [("a", False, False), ("😀", True, False), ("b", False, True)]


def test_images(spark, tmp_path):
    cases = [(["DCTDecode"], "DeviceRGB", 8, True), (["DCTDecode"], "DeviceCMYK", 32, False), (["DCTDecode"], "ICCBased", 24, True), (["DCTDecode"], "ICCBased", 32, False), (["FlateDecode", "DCTDecode"], "DeviceRGB", 8, False), (None, None, None, False)]
    df = spark.createDataFrame(cases, "f array<string>, s string, b int, want boolean")
    assert all(r.got == r.want for r in df.select("want", adapters.is_passthrough(F.col("f"), F.col("s"), F.col("b")).alias("got")).collect())
    boxes = spark.createDataFrame([([0.0, 0.0, 1.0, 2.0], [[2.0, 0.0, 0.0, 2.0, 10.0, 0.0], [0.0, 1.0, -1.0, 0.0, 0.0, 5.0]]), ([3.0, 1.0, 0.0, 0.0], None)], "b array<double>, m array<array<double>>")
    assert [r[0] for r in boxes.select(adapters.page_box(F.col("b"), F.col("m"))).collect()] == [[-4.0, 15.0, 0.0, 17.0], [0.0, 0.0, 3.0, 1.0]]
    rows = spark.createDataFrame([("p1/a", b"jpeg", True), ("p1/b", b"raw", False), ("../c", b"raw", None)], "path string, content binary, passthrough boolean")
    got = {r.path: (r.file, r.error) for r in adapters.saved_images(rows, str(tmp_path), lambda raw: (".png", zlib.compress(raw))).collect()}
    assert got["p1/a"] == ("p1/a.jpg", None) and got["p1/b"] == ("p1/b.png", None) and got["../c"][0] is None and "leads out" in got["../c"][1]
    assert (tmp_path / "p1/a.jpg").read_bytes() == b"jpeg" and zlib.decompress((tmp_path / "p1/b.png").read_bytes()) == b"raw"


def test_servers():
    replies = {"http://127.0.0.1:1234/v1/models": {"data": []}, "http://127.0.0.1:8080/v1/models": {"data": [{"id": " m "}, {"x": 1}]}, "http://h:1/api/tags": {"ok": True}}
    get = lambda url, timeout: replies.get(url)
    assert models.probe("http://h:1/", get=get) == (None, [])
    assert models.detect(get=get) == ("ok", ["m"], "openai", "http://127.0.0.1:8080")
    assert models.detect("http://127.0.0.1:1234/", get=get) == ("empty", [], "openai", "http://127.0.0.1:1234")
    assert models.detect("http://nobody", get=get) == ("unreachable", [], "", "")
    sent = []

    def post(url, payload, timeout):
        sent.append((url, payload))
        return {"response": "r"} if url.endswith("/api/generate") else {"choices": [{"message": {"content": "c"}}]}

    assert models.generate("http://a/", "m", "p", ["aW1n"], "ollama", {"type": "object"}, post) == "r"
    assert models.generate("http://a", "m", "p", ["aW1n"], "openai", {"type": "object"}, post) == "c"
    assert sent[0] == ("http://a/api/generate", {"model": "m", "prompt": "p", "stream": False, "images": ["aW1n"], "format": {"type": "object"}})
    assert sent[1][0] == "http://a/v1/chat/completions" and sent[1][1]["messages"][0]["content"][1]["image_url"]["url"] == "data:image/png;base64,aW1n" and sent[1][1]["response_format"]["json_schema"]["strict"]
    assert models.reply_text("openai", {"choices": []}) is None and models.reply_text("ollama", {"response": " "}) is None and models.post_json("http://127.0.0.1:9/", {}, 0.2) is None


def test_a_quick_refusal_is_asked_again():
    for delay, asked in ((1.0, 2), (31.0, 1)):
        now, calls = [0.0], []

        def ask(schema):
            calls.append(schema)
            now[0] += delay
            return None if schema else "plain"

        assert models.asked_twice(ask, lambda: now[0]) == ("plain" if asked == 2 else None) and len(calls) == asked


def test_summaries_and_polish(spark):
    docs = spark.createDataFrame([(1, "T", "# T\n\ntext of the book"), (2, "", " "), (3, "U", "other")], "doc_id long, title string, text string")
    good = "A book about rivers and the towns beside them, told by those who live there."
    got = {r.doc_id: (r.summary, r.summary_code) for r in models.summaries(docs, lambda prompt, schema: json.dumps({"summary": good, "insufficient_content": False}) if "T" in prompt.split("Title: ")[1][:1] else "no").collect()}
    assert got == {1: (good, None), 2: (None, None), 3: (None, "MS-304")}
    polished = {r.doc_id: (r.text, r.changed) for r in models.polished(docs, lambda chunk: chunk.replace("text", "TEXT") if "text" in chunk else "x" * 99).collect()}
    assert polished[1] == ("# T\n\nTEXT of the book", 1) and polished[3] == ("other", 0)
    names = spark.createDataFrame([("http://127.0.0.1:1234/v1", "openai"), ("http://x:5", "openai"), ("http://x:5", "ollama")], "e string, d string").select(guards.runtime_name(F.col("e"), F.col("d"))).collect()
    assert [r[0] for r in names] == ["LM Studio", "OpenAI-compatible local AI", "Ollama"]


def test_quality_as_json(spark):
    rows = quality.assess(spark.createDataFrame([("# A\n\nSome words here.",)], "text string")).select(quality.as_json().alias("j"))
    found = json.loads(rows.first().j)
    assert tuple(found) == quality.REPORT and found["headings"] == 1 and found["issues"] == [] and found["word_ratio"] == 1.0


def test_trace_and_digest(spark, tmp_path):
    trace = tracing.Trace(tmp_path / "s1")
    trace.event("session.start", source="test", rel=9)
    with tracing.context(file="a.pdf", conv=1):
        trace.event("convert.start", bytes=20480)
        with trace.span("route", route="pdflayout") as more:
            more["outcome"] = "too_little_text"
            more["body_chars"] = 7
        with pytest.raises(ValueError), trace.span("route", route="ocr"):
            raise ValueError("no engine")
        assert trace.snapshot("raw", "text").name == "001-a.raw.md"
        trace.event("pages.timing", route="pdflayout", pages=3, mean_ms=400, p95_ms=900, slowest=[1])
        trace.event("cleanup.done", lines_in=10, chars_in=600, passes=[{"pass": "strip", "ms": 12.5, "lines_gone": 4, "samples": ["gone | line"]}, {"pass": "join", "ms": 1.0, "lines_gone": 0}])
        trace.event("quality", score=71, est_tokens=1500, headings=2, issues=["no headings"])
        trace.event("convert.end", ms=1234, ok=True, engine="pdflayout", chars=6000)
    trace.event("ui.stall", gap_ms=2500, last_event="quality")
    trace.event("log", logger="pdf", msg="odd font")
    trace.event("log", logger="pdf", msg="odd font")
    tracing.Trace(None).event("nothing")
    assert "packages" in tracing.environment()
    raw = [json.loads(x) for x in (tmp_path / "s1/events.jsonl").read_text().splitlines()]
    assert raw[0]["f_rel"] == 9 and next(e for e in raw if e.get("ok") is False)["error"] == "ValueError: no engine"
    rows = [("s1", k, e["rel"], e["ev"], e.get("conv"), e.get("file"), json.dumps({x: v for x, v in e.items() if x not in ("t", "rel", "lvl", "ev", "conv", "file")})) for k, e in enumerate(raw)]
    events = spark.createDataFrame(rows, "session string, seq long, rel double, ev string, conv long, file string, fields string")
    incidents = spark.createDataFrame([("2024-05-01 10:00:00", 1, "MS-106", "error", "No text.", "r1", "convert", "empty", "Traceback\n  x"), ("2024-05-02 10:00:00", 2, "MS-114", "warning", "Fallback.", "r2", "route", "late", None)], "t string, seq long, code string, severity string, title string, ref string, where string, detail string, tb string").withColumn("t", F.to_timestamp("t"))
    text = digest.markdown(digest.lines(incidents, events, readers.recent_sessions(events.withColumn("t", F.col("seq")), 1)))
    for line in (
        "2 incident(s) — 1 error, 1 warning.", "| MS-106 | 1 | 2024-05-01T10:00:00 | No text. | r1 | convert |", "- 2024-05-02T10:00:00 **MS-114** (ref r2) route — late", "## Debug session s1", "- a.pdf: `ocr` — ValueError: no engine", "- a.pdf: 7 chars",
        "**Stalls: 1** — worst 2500 ms", "- 2× pdf: odd font", "| a.pdf | pdflayout | ok | 1,234 | 20 | 3 | 400 | 6,000 |", "- a.pdf `pdflayout`: 3 pages, mean 400 ms, p95 900 ms, slowest [1]", "- Cleanup time by pass: strip 12 ms, join 1 ms", "| a.pdf | 71 | 1,500 | 2 | no headings |",
        "- ⚠ a.pdf: `strip` took or rewrote 4 lines (40% of the document).", "  - `gone \\| line`",
    ):
        assert line in text.split("\n"), (line, text)
    order = [text.index(x) for x in ("## Error log", "### Most recent incidents", "## Debug session", "### Problems", "### Performance", "### Quality")]
    assert order == sorted(order)
    empty = digest.markdown(digest.lines(incidents.limit(0), events.limit(0)))
    assert "No errors recorded." in empty and "Debug session" not in empty


def test_downloads(spark):
    rows = spark.createDataFrame([("https://a.b/x/page.PDF?q=1",), ("http://a.b/",), ("ftp://a.b/x",), ("https://a.b/gone",), ("https://a.b/none",)], "url string")

    def fetch(url):
        if "gone" in url:
            raise TimeoutError("timed out")
        return None if "none" in url else b"<p>x"

    got = {r.url: (r.suffix, r.content, r.error_code) for r in adapters.downloaded(rows, fetch).collect()}
    assert got["https://a.b/x/page.PDF?q=1"] == (".pdf", b"<p>x", None) and got["http://a.b/"] == (".html", b"<p>x", None)
    assert [got[u][1:] for u in ("ftp://a.b/x", "https://a.b/gone", "https://a.b/none")] == [(None, "MS-131"), (None, "MS-130"), (None, "MS-130")]


def test_paths_and_kept_tables(spark, tmp_path):
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "a.txt").write_text("y")
    assert readers.resolved(spark, str(tmp_path / "a.txt"))[0].endswith("/a.txt") and readers.resolved(spark, str(tmp_path)) == (None, "MS-104") and readers.resolved(spark, str(tmp_path / "c")) == (None, "MS-103")
    found, missing = readers.expanded(spark, [str(tmp_path / "*.txt"), str(tmp_path / "c*"), str(tmp_path / "b.txt")])
    assert [x.rsplit("/", 1)[-1] for x in found] == ["a.txt", "b.txt"] and missing == [str(tmp_path / "c*")]
    kept, made = reading.Kept(spark, 2), []

    def make(n):
        made.append(n)
        return spark.range(n)

    for n in (1, 2, 1, 3, 1, 2):
        assert kept.get(("f", float(n), True), lambda: make(n)).count() == n
    assert made == [1, 2, 3, 2] and len(kept.tables) == 2
