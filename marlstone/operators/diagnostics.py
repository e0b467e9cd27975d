"""Incident and trace analytics over logs read as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as t

# --- fixed values: what is reported -------------------------------------------------
SLOW_PAGES, SLOW_CONVERSIONS, TOP_PASSES, LATEST, TOP_STALLS, TOP_WARNINGS, LAST_ERRORS = 5, 15, 6, 10, 8, 10, 15
SLOW_P95_MS, SLOW_PREVIEW_MS, STALL_MS = 500, 250, 1000
HEAVY_SHARE = 0.05
DEDUPE_S = 30
PASS_SAMPLES = 12


def by_severity(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy(F.coalesce("severity", F.lit("error")).alias("severity")).agg(F.count("*").alias("n"))


def by_code(incidents: DataFrame) -> DataFrame:
    """Per code: how often, and the last time's facts; ``seq`` orders incidents of one time."""
    last = lambda c: F.max_by(c, F.struct("t", "seq"))
    return incidents.groupBy(F.coalesce("code", F.lit("?")).alias("code")).agg(F.count("*").alias("n"), F.max("t").alias("last_seen"), last("title").alias("title"), last("ref").alias("ref"), last("where").alias("where"))


def latest(incidents: DataFrame, n: int = LATEST) -> DataFrame:
    return incidents.orderBy(F.desc("t"), F.desc("seq")).limit(n)


def recent(incidents: DataFrame, now, days: int | None = 30) -> DataFrame:
    return incidents if days is None else incidents.where(F.col("t") >= F.lit(now) - F.make_interval(days=F.lit(days)))


def deduped(incidents: DataFrame, window_s: float = DEDUPE_S) -> DataFrame:
    """Incidents without those that come within the window of the last recorded one of their kind.

    A kind is a code, place and detail; null counts as empty in each.  The window
    isn't refreshed by what it holds back, so it is a fold along time.  Kinds are first cut where a gap alone separates them; each cut is
    folded by itself, one row at a time in an Arrow pass over sorted rows.
    """
    kind = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("code", "where", "detail")])
    rows = incidents.select("seq", kind.alias("kind"), F.unix_micros(F.col("t").cast("timestamp")).alias("at"))
    order = Window.partitionBy("kind").orderBy("at", "seq")
    gap = F.col("at") - F.lag("at").over(order)
    rows = rows.withColumn("run", F.sum(F.when(gap < window_s * 1_000_000, 0).otherwise(1)).over(order))
    marked = rows.select("seq", "kind", "run", "at").repartition("kind", "run").sortWithinPartitions("kind", "run", "at", "seq")
    kept = marked.mapInArrow(first_in_window(int(window_s * 1_000_000)), "seq long")
    return incidents.join(kept, "seq", "left_semi")


def first_in_window(width: int):
    def run(batches):
        import pyarrow as pa

        now, since = None, 0
        for batch in batches:
            out = []
            for seq, key, part, at in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, part) != now or at - since >= width:
                    now, since = (key, part), at
                    out.append(seq)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["seq"])

    return run


def timing(pages: DataFrame) -> DataFrame:
    """Per group of pages(conv, page, ms): count, total, mean, the value at place 0.95 n, the largest, the slowest.

    Places are found by sorted windows that spill; no group is held in one row.
    """
    whole = pages.where("ms is not null").groupBy("conv").agg(F.count("ms").alias("pages"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"))
    place = F.least(F.col("pages"), F.floor(F.col("pages") * 95 / 100) + 1)
    upto = Window.partitionBy("conv").orderBy("ms")
    counts = pages.where("ms is not null").groupBy("conv", "ms").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(upto))
    at = counts.join(whole.select("conv", place.alias("place")), "conv").where("upto >= place and upto - n < place").select("conv", F.col("ms").alias("p95_ms"))
    first = Window.partitionBy("conv").orderBy(F.desc("ms"), F.desc("page"))
    slowest = pages.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= SLOW_PAGES).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("ms", "page")), asc=False).alias("slowest"))
    return whole.join(at, "conv").join(slowest, "conv", "left")


def performance(ends: DataFrame, starts: DataFrame, times: DataFrame, n: int = SLOW_CONVERSIONS, order: tuple[str, ...] = ()) -> DataFrame:
    """The slowest conversions with their sizes and page times; ``order`` settles ties of one time and conversion."""
    rows = ends.join(starts.select("conv", "bytes"), "conv", "left").join(times.select("conv", "pages", F.col("mean_ms").alias("ms_per_page")), "conv", "left")
    return rows.orderBy(F.desc("ms"), "conv", *order).limit(n)


def pass_times(cleanups: DataFrame, n: int = TOP_PASSES) -> DataFrame:
    """Time by pass over cleanups(passes array<struct<pass, ms, ...>>)."""
    rows = cleanups.select(F.explode("passes").alias("p")).groupBy(F.col("p.pass").alias("pass")).agg(F.sum("p.ms").alias("ms"))
    return rows.orderBy(F.desc("ms"), "pass").limit(n)


def latest_quality(events: DataFrame) -> DataFrame:
    """The last quality event of each file."""
    last = Window.partitionBy("file").orderBy(F.desc("t"), F.desc("seq"))
    return events.where("file is not null").withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")


def heavy_passes(cleanups: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Passes that took at least a twentieth of a document's lines, of cleanups(file, lines_in, chars_in, passes array<struct<pass, lines_gone, samples>>)."""
    lines = F.greatest(F.lit(1), F.coalesce(F.nullif("lines_in", F.lit(0)), F.floor(F.col("chars_in") / 60)))
    rows = cleanups.select(*keep, "file", lines.alias("lines"), F.explode("passes").alias("p"))
    share = F.col("p.lines_gone") / F.col("lines")
    return rows.where((F.col("p.lines_gone") > 0) & (share >= HEAVY_SHARE)).select(*keep, "file", "p.*", share.alias("share"))


def pass_record(before: DataFrame, after: DataFrame, samples: int = PASS_SAMPLES) -> DataFrame:
    """Per document whose lines differ: chars_delta, lines_delta, lines_gone, and samples of these.

    Lines with text that a pass took or rewrote are a difference of multisets;
    both sides are (doc_id, line), and samples are the first by their text.
    """
    facts = lambda df, n: df.select("doc_id", "line", F.lit(n).alias("n"), ((F.length("line") + 1) * n).alias("chars"))
    both = facts(before, 1).unionAll(facts(after, -1))
    sizes = both.groupBy("doc_id").agg((-F.sum("chars")).alias("chars_delta"), (-F.sum("n")).alias("lines_delta"))
    gone = both.where(F.regexp_like("line", F.lit(r"(?U)\S"))).groupBy("doc_id", "line").agg(F.sum("n").alias("n")).where("n > 0")
    first = gone.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))).where(F.col("rank") <= samples)
    shown = first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("line")), t.sample).alias("samples"))
    per = gone.groupBy("doc_id").agg(F.sum("n").cast("long").alias("lines_gone")).join(shown, "doc_id")
    out = sizes.join(per, "doc_id", "left").where("lines_gone is not null or chars_delta <> 0 or lines_delta <> 0")
    return out.select("doc_id", "chars_delta", "lines_delta", F.coalesce("lines_gone", F.lit(0)).alias("lines_gone"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def stalls(ticks: DataFrame, least_ms: int = STALL_MS) -> DataFrame:
    """Gaps between ticks(session, t) that are long enough to be felt."""
    at = F.unix_millis(F.col("t").cast("timestamp"))
    gap = at - F.lag(at).over(Window.partitionBy("session").orderBy("t"))
    return ticks.withColumn("gap_ms", gap).where(F.col("gap_ms") >= least_ms)


def sessions(events: DataFrame) -> DataFrame:
    """Per session of events(session, rel, ev): length, events, and whether it ended."""
    return events.groupBy("session").agg(F.max("rel").alias("duration"), F.count("*").alias("n_events"), (~F.bool_or(F.col("ev") == "session.end")).alias("crashed"))


def problems(events: DataFrame) -> DataFrame:
    """Events that the digest lists as problems, with their kind."""
    ev, of = F.col("ev"), F.lower(F.coalesce("route", F.lit("")))
    kind = F.when(ev == "error", "error").when(ev.isin("route", "pdf.analysis") & (F.col("ok") == F.lit(False)) & (of != "markitdown"), "route").when((ev == "route") & (F.col("outcome") == "too_little_text"), "thin").when(ev == "ui.stall", "stall").when(ev == "log", "library")
    return events.withColumn("problem", kind).where("problem is not null")


def markdown_table(rows: DataFrame, columns: list[str], order) -> DataFrame:
    """One Markdown table of all rows; for digests of a bounded number of rows."""
    cell = F.concat(F.lit("| "), F.array_join(F.array(*[t.log_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]), " | "), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), cell.alias("row")))), lambda x: x["row"]), "\n")
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    return rows.agg(F.concat(F.lit(head), body).alias("markdown"))
