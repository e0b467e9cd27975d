"""Command line: convert files to Markdown folders, digest logs, name the codes, say what is there.

Readers of PDF, images and sound, and models, are engines that the caller of
``main`` brings; the command line alone reads text, Markdown and HTML.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from marlstone.patterns import DEFAULT_TOKENS, TARGETS
from marlstone.tracing import Trace

TEXT, HTML = ("md", "markdown", "txt"), ("html", "htm")
NOTEBOOK_TARGET = "Gemini Notebook"


@dataclass
class Engines:
    """What the caller brings; every callable takes a file's bytes, ``ask`` a prompt and a schema or None."""

    pdf: Callable[[bytes], str | None] | None = None
    image: Callable[[bytes], str | None] | None = None
    media: Callable[[bytes], dict[str, Any] | None] | None = None
    ask: Callable[[str, dict | None], str | None] | None = None
    names: dict[str, str] = field(default_factory=lambda: {"pdf": "pdf", "image": "ocr", "media": "whisper"})


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marlstone", description="Markdown from text, Markdown, HTML, and what engines read.")
    sub = top.add_subparsers(dest="command", required=True)
    conv = sub.add_parser("convert", help="convert files; patterns and folders of any file system that Spark reads")
    add = conv.add_argument
    add("files", nargs="+")
    add("--out", required=True, help="folder for the results")
    add("--split-chapters", action="store_true", help="a folder for each document: a file a chapter, an index and a manifest")
    add("--max-tokens", type=int, default=DEFAULT_TOKENS, help="chapters beyond it are cut")
    add("--ai-target", choices=list(TARGETS), help="parts that fit this target's budget; for the notebook target a source a chapter")
    add("--no-clean", action="store_true", help="leave texts as they are read")
    add("--no-front-matter", action="store_true", help="no head before the text")
    add("--quality", action="store_true", help="say how good each result looks")
    add("--json", action="store_true", help="one JSON object a file")
    add("--anchors", action="store_true", help="keep page anchors")
    add("--images", action="store_true", help="keep figure markers for links")
    add("--no-images", action="store_true", help="drop figure markers")
    add("--no-layout", action="store_true", help="don't read PDF by layout")
    add("--polish", action="store_true", help="let the model repair what is left")
    add("--summarize", action="store_true", help="let the model write a summary into the head")
    add("--no-ocr", action="store_true", help="don't read images")
    add("--no-audio", action="store_true", help="don't transcribe")
    add("--whisper-model", default=None, help="the speech model that front matter names")
    add("--debug", default=None, metavar="FOLDER", help="record a trace of the run")
    add("--date", default="", help="the date that front matter names")
    sub.add_parser("capabilities", help="readers that there are")
    sub.add_parser("codes", help="error codes and what to do")
    diag = sub.add_parser("diagnostics", help="a digest of the error log and of traced sessions")
    diag.add_argument("logs", help="folder with errors*.jsonl and a folder a session")
    diag.add_argument("--sessions", type=int, default=1, help="how many of the newest sessions")
    diag.add_argument("--report", default=None, help="also write the digest and the logs to this zip")
    diag.add_argument("--no-snapshots", action="store_true", help="leave copies of texts out of the zip")
    return top


def read(spark, args, engines: Engines):
    """(doc_id, path, name, stem, out_name, engine, text, error) of every file, whether it could be read or not."""
    from pyspark.sql import functions as F

    from marlstone.operators import adapters, routing, transcripts
    from marlstone.sources import html, readers

    found, missing = readers.expanded(spark, args.files)
    gone = spark.createDataFrame([(p,) for p in missing], "path string").withColumns({"content": F.lit(None).cast("binary"), "kind": F.lit("missing")})
    kinds = {"html": HTML, "text": TEXT}
    if engines.pdf and not args.no_layout:
        kinds["pdf"] = ("pdf",)
    if engines.image and not args.no_ocr:
        kinds["image"] = routing.IMAGES
    if engines.media and not args.no_audio:
        kinds["media"] = routing.MEDIA
    kind = F.lit("none")
    for name, suffixes in kinds.items():
        kind = F.when(routing.suffix(F.col("path")).isin(*suffixes), name).otherwise(kind)
    rows = readers.files(spark, *found).select("path", "content", kind.alias("kind")) if found else gone.limit(0)
    rows = rows.unionByName(gone)
    of = lambda k: rows.where(F.col("kind") == k).select("path", "content")
    ok = F.lit(None).cast("string").alias("error")
    out = of("text").select("path", F.lit("text").alias("engine"), F.col("content").cast("string").alias("text"), ok)
    pages = html.pages_to_markdown(of("html").select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.col("content").cast("string").alias("html")))
    parts = [out, pages.select(F.col("url").alias("path"), F.lit("html").alias("engine"), F.col("markdown").alias("text"), ok)]
    if "pdf" in kinds:
        parts.append(adapters.called(of("pdf"), engines.pdf, ["content"], "text").select("path", F.lit(engines.names["pdf"]).alias("engine"), "text", "error"))
    if "image" in kinds:
        parts.append(adapters.recognized_images(of("image"), engines.image).select("path", F.lit(engines.names["image"]).alias("engine"), F.col("markdown").alias("text"), "error"))
    if "media" in kinds:
        heard = adapters.transcribed(of("media"), engines.media)
        parts.append(transcripts.documents(heard).join(heard.select("path", "error"), "path").select("path", F.lit(engines.names["media"]).alias("engine"), F.when(F.col("error").isNull(), F.col("markdown")).alias("text"), "error"))
    parts.append(of("missing").select("path", F.lit("").alias("engine"), F.lit(None).cast("string").alias("text"), F.lit("FileNotFoundError: File does not exist").alias("error")))
    parts.append(of("none").select("path", F.lit("").alias("engine"), F.lit(None).cast("string").alias("text"), F.lit("UnsupportedFormatException: no converter").alias("error")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    empty = routing.empty_guard(F.col("text"), F.coalesce(F.octet_length("text"), F.lit(0)), F.col("path"), F.lit(not args.no_ocr))
    whole = whole.withColumn("error", F.coalesce("error", F.when(~routing.has_text(F.col("text")), F.coalesce(empty, F.lit("EmptyOutputError: the converter produced no text")))))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    whole = whole.withColumns({"doc_id": F.xxhash64("path"), "name": name, "stem": F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "error_code": routing.classify(F.col("error"))})
    return readers.distinct_names(whole)


def convert(spark, args, engines: Engines, trace: Trace) -> int:
    from pyspark.sql import functions as F

    from marlstone.functions import text as t
    from marlstone.operators import figures, models, quality, routing, sections
    from marlstone.plans import cleaning, reading
    from marlstone.sources import readers
    from marlstone.storage import Scratch

    scratch = Scratch(spark, "convert")
    with trace.span("read", files=len(args.files)):
        every = scratch.keep(read(spark, args, engines), "read")
    docs = every.where("error is null")
    if not args.no_clean:
        docs = cleaning.clean(docs, engine="engine").withColumn("text", F.col("cleaned")).drop("cleaned")
    else:
        docs = docs.withColumn("stats", F.lit(None).cast(cleaning.COUNTED))
    if args.polish and engines.ask:
        ask = engines.ask
        polished = models.polished(docs.select("doc_id", "text"), lambda chunk: ask(chunk, None))
        docs = docs.drop("text").join(polished, "doc_id")
    if not args.anchors:
        docs = docs.withColumn("text", F.regexp_replace("text", r"(?m)^[ \t]*<!-- page \d+(?: \([^)]*\))? -->[ \t]*\n(?:[ \t]*\n)?", ""))
    if args.no_images or not args.images:
        docs = docs.withColumn("text", figures.strip_markers(F.col("text")))
    docs = docs.withColumn("title", t.document_title(F.col("text"), F.col("stem")))
    if args.summarize and engines.ask:
        docs = models.summaries(docs, engines.ask)
    else:
        docs = docs.withColumns({"summary": F.lit(""), "summary_code": F.lit(None).cast("string")})
    docs = scratch.keep(docs.withColumn("summary", F.coalesce("summary", F.lit(""))), "docs")

    notebook = args.ai_target == NOTEBOOK_TARGET
    budget = TARGETS[args.ai_target] if args.ai_target else args.max_tokens
    converter = F.concat_ws(" ", F.col("engine"), F.lit(args.whisper_model)) if args.whisper_model else F.col("engine")
    folder = docs.select("doc_id", "out_name")
    head = sections.front_matter({"title": F.col("title"), "summary": F.col("summary"), "source": F.col("name"), "converted": F.lit(args.date), "converter": converter, "est_tokens": t.est_tokens(F.col("text"))})
    if notebook:
        files = reading.notebook_files(docs.withColumn("author", F.lit("")), budget).join(folder, "doc_id")
    elif args.split_chapters or args.ai_target:
        source = docs.select("doc_id", "text", "summary", "title", "engine", F.col("name").alias("source"), F.lit("").alias("author"), F.lit(args.date).alias("converted"))
        mode = "ai" if args.ai_target else "chapters"
        files = sections.book_files(source, args.date, "marlstone", mode, budget)
        if args.no_front_matter:
            files = files.withColumn("content", F.regexp_replace("content", r"(?s)\A---\n.*?\n---\n\n", ""))
        parts = sections.sections(source, mode, budget)
        index = sections.index_pages(parts, source).select("doc_id", F.lit("index.md").alias("file"), "content")
        manifest = sections.manifests(parts, source).select("doc_id", F.lit("manifest.json").alias("file"), F.col("manifest").alias("content"))
        files = files.unionByName(index).unionByName(manifest).join(folder, "doc_id")
    else:
        files = docs.select("out_name", F.lit(None).cast("string").alias("file"), (F.col("text") if args.no_front_matter else F.concat(head, "text")).alias("content"))
    files = files.select(F.when(F.col("file").isNull(), F.concat("out_name", F.lit(".md"))).otherwise(F.concat_ws("/", "out_name", "file")).alias("file"), "content")
    with trace.span("write"):
        readers.write_files(files, args.out)

    catalog = F.broadcast(routing.catalog(spark).select(F.col("code").alias("error_code"), F.col("title").alias("error_title"), "next_step"))
    report = quality.assess(docs).select("path", quality.summary().alias("quality"), quality.as_json().alias("report"), F.col("binary_noise").alias("noise"), "summary", "summary_code", cleaning.summary().alias("cleanup"))
    said = every.select("path", "engine", "error", "error_code", "out_name").join(report, "path", "left").join(catalog, "error_code", "left")
    failed = 0
    for r in said.orderBy("path").toLocalIterator():
        failed |= r.error is not None
        if args.json:
            row = {"path": r.path, "engine": r.engine, "ok": r.error is None}
            if r.error is not None:
                row |= {"error": r.error, "error_code": r.error_code, "error_title": r.error_title, "next_step": r.next_step}
            else:
                row |= {"out": r.out_name, "cleanup": r.cleanup, **({"quality": json.loads(r.report)} if args.quality else {}), **({"summary": r.summary} if args.summarize else {})}
                row |= {"warning": "binary noise"} if r.noise else {}
                row |= {"warnings": [{"code": r.summary_code}]} if r.summary_code else {}
            print(json.dumps(row, ensure_ascii=False))
        elif r.error is not None:
            print(f"ERROR  [{r.error_code}] {r.path}: {r.error}\n       {r.error_title}\n       Next step: {r.next_step}")
        else:
            print(f"ok     {r.path} [{r.engine}] -> {args.out}/{r.out_name}")
            if args.quality:
                print(f"       {r.quality}")
            if r.noise:
                print(f"warn   {r.path}: this looks like binary noise")
    scratch.close()
    return int(failed)


def diagnostics(spark, args) -> int:
    """Print the digest of a folder of logs; its JSON lines may be torn."""
    from pyspark.sql import functions as F

    from marlstone.plans import digest
    from marlstone.sources import readers

    folder = args.logs.rstrip("/")
    has = lambda pattern: bool(readers.expanded(spark, [f"{folder}/{pattern}"])[0])
    kinds = "t string, code string, severity string, title string, ref string, where string, detail string, tb string"
    errors = readers.json_lines(spark, kinds, f"{folder}/errors*.jsonl") if has("errors*.jsonl") else spark.createDataFrame([], kinds)
    errors = errors.withColumns({"t": F.to_timestamp("t"), "seq": F.monotonically_increasing_id()})
    wanted = "session string, seq long, t string, rel double, ev string, conv long, file string, fields string"
    if has("*/events.jsonl"):
        lines = spark.read.text(f"{folder}/*/events.jsonl").where(F.regexp_like("value", F.lit(r"^\s*\{.*\}\s*$"))).select("value", F.regexp_extract("_metadata.file_path", r"([^/]+)/events\.jsonl$", 1).alias("session"))
        at = lambda k, kind="string": F.get_json_object("value", f"$.{k}").cast(kind).alias(k)
        events = lines.select("session", F.monotonically_increasing_id().alias("seq"), at("t"), at("rel", "double"), at("ev"), at("conv", "long"), at("file"), F.col("value").alias("fields")).where("ev is not null")
    else:
        events = spark.createDataFrame([], wanted)
    text = digest.markdown(digest.lines(errors, events, readers.recent_sessions(events, args.sessions)))
    print(text)
    if args.report:
        import zipfile

        with zipfile.ZipFile(args.report, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("digest.md", text)
            for p in sorted(Path(folder).rglob("*")):
                if p.is_file() and p != Path(args.report) and not (args.no_snapshots and p.parent.name == "snapshots"):
                    z.write(p, p.relative_to(folder))
        print(f"Report written: {args.report}", file=sys.stderr)
    return 0


def capabilities(engines: Engines) -> dict[str, bool]:
    return {"text": True, "html": True, "pdf": engines.pdf is not None, "ocr": engines.image is not None, "audio": engines.media is not None, "model": engines.ask is not None}


def main(argv: list[str] | None = None, spark=None, engines: Engines | None = None) -> int:
    """0 where all went well, 1 where a file failed, 2 for a fault of the program itself (MS-900)."""
    args, engines = parser().parse_args(argv), engines or Engines()
    try:
        if args.command == "capabilities":
            print(json.dumps(capabilities(engines)))
            return 0
        if args.command == "codes":
            from marlstone.operators.routing import CATALOG

            for code, severity, title, step in CATALOG:
                print(f"{code} ({severity}): {title} {step}")
            return 0
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("marlstone").getOrCreate()
        if args.command == "diagnostics":
            return diagnostics(spark, args)
        trace = Trace(args.debug)
        trace.event("session.start", source="cli")
        code = convert(spark, args, engines, trace)
        trace.event("session.end", code=code)
        return code
    except Exception as e:
        print(f"ERROR  [MS-900] {type(e).__name__}: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
