"""The digest of an error log and of traced sessions, as a table of Markdown lines.

Lines carry (session, part, place): the log comes first with a null session, then
each session's problems, performance and quality.  All of it is aggregates,
top-k windows and joins over the log's tables; ``markdown`` puts the lines in
order at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as t
from marlstone.operators import diagnostics as d

LOG, SESSION, PROBLEMS, PERFORMANCE, QUALITY = range(5)
TITLES = {LOG: "## Error log", PROBLEMS: "### Problems", PERFORMANCE: "### Performance", QUALITY: "### Quality"}
NOTHING = {LOG: "No errors recorded.", PROBLEMS: "None recorded.", PERFORMANCE: "Nothing measured.", QUALITY: "Nothing assessed."}


def field(name: str, kind: str = "string") -> Column:
    """A field of a traced event's JSON."""
    value = F.get_json_object("fields", f"$.{name}")
    return value if kind == "string" else value.cast(kind)


def said(*parts: str | Column) -> Column:
    """Text from strings and columns; nulls are empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def number(c: Column) -> Column:
    return F.format_number(F.coalesce(c, F.lit(0)), 0)


def row(*cells: Column) -> Column:
    return said("| ", F.array_join(F.array(*[t.log_cell(F.coalesce(c.cast("string"), F.lit(""))) for c in cells]), " | "), " |")


def listed(rows: DataFrame, part: int, block: int, line: Column, order: list[Column], limit: int | None = None, head: list[Column] | None = None) -> DataFrame:
    """Lines (session, part, block, n, line) of rows in an order within each session, the first ``limit``, under head lines that may count with ``n_rows``."""
    own = Window.partitionBy("session")
    rows = rows.withColumns({"n": F.row_number().over(own.orderBy(*order)).cast("long"), "n_rows": F.count("*").over(own)})
    body = rows if limit is None else rows.where(F.col("n") <= limit)
    out = body.select("session", F.lit(part).alias("part"), F.lit(block).alias("block"), "n", line.alias("line"))
    if not head:
        return out
    heads = F.array(*[F.struct(F.lit(k - len(head)).cast("long").alias("n"), h.alias("line")) for k, h in enumerate(head)])
    top = rows.where("n = 1").select("session", F.lit(part).alias("part"), F.lit(block).alias("block"), F.explode(heads).alias("h")).select("session", "part", "block", "h.n", "h.line")
    return out.unionAll(top)


def table_head(*names: str) -> list[Column]:
    return [F.lit(""), F.lit(f"| {' | '.join(names)} |"), F.lit("|" + "---|" * len(names))]


def log_lines(incidents: DataFrame) -> list[DataFrame]:
    """incidents(t, seq, code, severity, title, ref, where, detail, tb)."""
    nobody = F.lit(None).cast("string").alias("session")
    kinds = d.by_severity(incidents).select(nobody, "severity", "n").groupBy("session").agg(F.sum("n").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "severity"))), lambda x: F.concat((-x["k"]).cast("string"), F.lit(" "), x["severity"])), ", ").alias("kinds"))
    when = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    codes = d.by_code(incidents).select(nobody, "*")
    latest = d.latest(incidents).select(nobody, "*")
    trace = F.when(F.coalesce("tb", F.lit("")) != "", F.concat(F.lit("\n\n  ```\n"), F.regexp_replace(t.trimmed_traceback(F.col("tb")), "(?m)^", "  "), F.lit("\n  ```")))
    return [
        listed(kinds, LOG, 0, said(F.col("total"), " incident(s) — ", F.col("kinds"), "."), [F.lit(1)]),
        listed(codes, LOG, 1, row(F.col("code"), F.col("n"), when(F.col("last_seen")), F.col("title"), F.col("ref"), F.col("where")), [F.desc("n"), F.col("code")], head=table_head("Code", "Count", "Last seen", "What happened", "Last ref", "Where")),
        listed(latest, LOG, 2, said("- ", when(F.col("t")), " **", F.col("code"), "** (ref ", F.col("ref"), ") ", F.col("where"), " — ", t.log_cell(F.coalesce("detail", F.lit("")), 200), trace), [F.desc("t"), F.desc("seq")], head=[F.lit(""), F.lit("### Most recent incidents"), F.lit("")]),
    ]


def problem_lines(events: DataFrame) -> list[DataFrame]:
    """events(session, seq, rel, ev, conv, file, fields)."""
    ev, name = F.col("ev"), F.coalesce("file", F.lit("?"))
    newest, oldest = F.desc("seq"), F.col("seq")
    route = F.coalesce(field("route"), F.lit(""))
    last = events.where(ev == "error")
    errors = last.withColumns({"n_all": F.count("*").over(Window.partitionBy("session")), "back": F.row_number().over(Window.partitionBy("session").orderBy(newest))}).where(F.col("back") <= d.LAST_ERRORS)
    failed = events.where(ev.isin("route", "pdf.analysis") & (field("ok") == "false") & (route != "markitdown"))
    thin = events.where((ev == "route") & (field("outcome") == "too_little_text"))
    stalls = events.where(ev == "ui.stall").withColumn("gap", F.coalesce(field("gap_ms", "long"), F.lit(0)))
    warned = events.where(ev == "log").groupBy("session", field("logger").alias("logger"), t.log_cell(F.coalesce(field("msg"), F.lit("")), 140).alias("msg")).agg(F.count("*").alias("times"), F.min("seq").alias("seq"))
    return [
        listed(errors, PROBLEMS, 0, said("- ", field("code"), " (ref ", field("ref"), ") ", field("where"), ": ", t.log_cell(F.coalesce(field("detail"), F.lit("")), 160)), [oldest], head=[said("**", F.col("n_all"), " error incident(s):**")]),
        listed(failed, PROBLEMS, 1, said("- ", name, ": `", F.coalesce(F.nullif(route, F.lit("")), ev), "` — ", t.log_cell(F.coalesce(field("error"), F.lit("")), 160)), [oldest], head=[F.lit(""), F.lit("**Readers that failed, so that a lesser one took over:**")]),
        listed(thin, PROBLEMS, 2, said("- ", name, ": ", field("body_chars"), " chars"), [oldest], head=[F.lit(""), F.lit("**Layouts with too little text:**")]),
        listed(stalls, PROBLEMS, 3, said("- ", F.col("gap"), " ms at +", F.col("rel"), " s after `", field("last_event"), "`"), [F.desc("gap"), oldest], d.TOP_STALLS, [F.lit(""), said("**Stalls: ", F.col("n_rows"), "** — worst ", F.col("gap"), " ms")]),
        listed(warned, PROBLEMS, 4, said("- ", F.col("times"), "× ", F.col("logger"), ": ", F.col("msg")), [F.desc("times"), oldest], d.TOP_WARNINGS, [F.lit(""), F.lit("**Library warnings:**")]),
    ]


def performance_lines(events: DataFrame) -> list[DataFrame]:
    ev, name, oldest = F.col("ev"), F.coalesce("file", F.lit("?")), F.col("seq")
    last = lambda kind, *columns: events.where(ev == kind).groupBy("session", "conv").agg(*[F.max_by(c, "seq").alias(a) for c, a in columns])
    ends = events.where(ev == "convert.end").withColumn("ms", F.coalesce(field("ms", "double"), F.lit(0.0)))
    rows = ends.join(last("convert.start", (field("bytes", "long"), "bytes")), ["session", "conv"], "left").join(last("pages.timing", (field("pages"), "pages"), (field("mean_ms"), "per_page")), ["session", "conv"], "left")
    result = F.when(field("ok") == "true", "ok").otherwise(F.coalesce(field("code"), F.lit("error")))
    cells = row(name, field("engine"), result, number(F.col("ms")), number(F.floor(F.coalesce("bytes", F.lit(0)) / 1024)), F.col("pages"), F.col("per_page"), number(field("chars", "long")))
    slow = events.where((ev == "pages.timing") & (field("p95_ms", "double") > d.SLOW_P95_MS))
    passes = events.where(ev == "cleanup.done").select("session", F.explode(F.from_json(field("passes"), "array<struct<pass:string,ms:double>>")).alias("p")).groupBy("session", "p.pass").agg(F.sum("p.ms").alias("ms"))
    ranked = passes.withColumn("k", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("ms"), "pass"))).where(F.col("k") <= d.TOP_PASSES)
    top = ranked.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", said(F.col("pass"), " ", number(F.col("ms")), " ms").alias("s")))), lambda x: x["s"]), ", ").alias("passes"))
    previews = events.where((ev == "ui.preview") & (field("ms", "double") >= d.SLOW_PREVIEW_MS))
    worst = previews.groupBy("session").agg(F.count("*").alias("times"), F.max(field("ms", "double")).alias("ms"), F.max_by(name, field("ms", "double")).alias("file"))
    return [
        listed(rows, PERFORMANCE, 0, cells, [F.desc("ms"), oldest], d.SLOW_CONVERSIONS, [said("**Conversions: ", F.col("n_rows"), "** (slowest first)"), *table_head("File", "Engine", "Result", "ms", "KB", "Pages", "ms/page", "Chars")]),
        listed(slow, PERFORMANCE, 1, said("- ", name, " `", field("route"), "`: ", field("pages"), " pages, mean ", field("mean_ms"), " ms, p95 ", field("p95_ms"), " ms, slowest ", field("slowest")), [oldest]),
        listed(top, PERFORMANCE, 2, said("- Cleanup time by pass: ", F.col("passes")), [F.lit(1)]),
        listed(worst, PERFORMANCE, 3, said("- Slow previews (", str(d.SLOW_PREVIEW_MS), " ms or more): ", F.col("times"), ", worst ", number(F.col("ms")), " ms for ", F.col("file")), [F.lit(1)]),
    ]


def quality_lines(events: DataFrame) -> list[DataFrame]:
    ev = F.col("ev")
    newest = Window.partitionBy("session", "file").orderBy(F.desc("seq"))
    rows = events.where((ev == "quality") & F.col("file").isNotNull()).withColumn("back", F.row_number().over(newest)).where("back = 1").withColumn("score", F.coalesce(field("score", "int"), F.lit(100)))
    issues = F.nullif(F.array_join(F.from_json(field("issues"), "array<string>"), "; "), F.lit(""))
    done = events.where(ev == "cleanup.done").select("session", "seq", F.coalesce("file", F.lit("?")).alias("file"), field("lines_in", "long").alias("lines_in"), F.coalesce(field("chars_in", "long"), F.lit(0)).alias("chars_in"), F.from_json(field("passes"), "array<struct<pass:string,lines_gone:long,samples:array<string>>>").alias("passes"))
    heavy = d.heavy_passes(done, ("session", "seq"))
    shown = F.array_join(F.transform(F.slice(F.coalesce("samples", F.array().cast("array<string>")), 1, 6), lambda x: F.concat(F.lit("\n  - `"), t.log_cell(x, 150), F.lit("`"))), "")
    return [
        listed(rows, QUALITY, 0, row(F.col("file"), F.col("score"), number(field("est_tokens", "long")), field("headings"), F.coalesce(issues, F.lit("—"))), [F.col("score"), F.col("file")], head=table_head("File", "Score", "Tokens", "Headings", "Issues")),
        listed(heavy, QUALITY, 1, said("- ⚠ ", F.col("file"), ": `", F.col("pass"), "` took or rewrote ", number(F.col("lines_gone")), " lines (", F.format_number(F.col("share") * 100, 0), "% of the document).", shown), [F.col("seq"), F.col("pass")]),
    ]


def session_lines(events: DataFrame) -> DataFrame:
    """A session's title and length, and whether it ended."""
    rows = d.sessions(events.withColumn("rel", F.col("rel").cast("double")))
    ended = F.when(F.col("crashed"), " (no session.end: it crashed or was killed)").otherwise("")
    return listed(rows, SESSION, 0, said("- Duration: ", number(F.col("duration")), " s, ", F.col("n_events"), " events", ended), [F.lit(1)], head=[said("## Debug session ", F.col("session")), F.lit("")])


def lines(incidents: DataFrame, events: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """(session, part, block, n, line) of the whole digest; ``sessions`` keeps those that it names."""
    if sessions is not None:
        events = events.join(sessions.select("session"), "session", "left_semi")
    found = [*log_lines(incidents), session_lines(events), *problem_lines(events), *performance_lines(events), *quality_lines(events)]
    out = found[0]
    for part in found[1:]:
        out = out.unionAll(part)
    # titles of parts, and what stands for those without a line
    names = F.array(*[F.struct(F.lit(k).alias("part"), F.lit(v).alias("title"), F.lit(NOTHING[k]).alias("nothing")) for k, v in TITLES.items()])
    spark = incidents.sparkSession
    every = events.select("session").distinct().unionAll(spark.range(1).select(F.lit(None).cast("string")))
    every = every.select("session", F.explode(names).alias("x")).select("session", "x.*").where(F.col("session").isNull() == (F.col("part") == LOG))
    known = out.groupBy(F.col("session").alias("s"), F.col("part").alias("p")).agg(F.count("*").alias("held"))
    titled = every.join(known, F.col("session").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")), "left")
    text = F.array(F.lit(""), F.col("title"), F.lit(""), F.when(F.col("held").isNull(), F.col("nothing")))
    heads = titled.select("session", "part", F.lit(-1).alias("block"), F.posexplode(F.array_compact(text)).alias("k", "line")).select("session", "part", "block", F.col("k").cast("long").alias("n"), "line")
    return out.unionAll(heads)


def markdown(found: DataFrame, title: str = "# Diagnostics") -> str:
    """The digest as text, read line by line; sessions in the order of their names, the newest first."""
    order = found.orderBy(F.col("session").desc_nulls_first(), "part", "block", "n").select("line")
    return "\n".join([title, *(r.line for r in order.toLocalIterator())]).rstrip() + "\n"
