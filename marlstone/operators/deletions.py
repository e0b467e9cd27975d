"""Window forms of the deleting passes: lines(doc_id, pos, line) in, the same with a boolean ``drop`` out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone import patterns as p
from marlstone.functions import text as t
from marlstone.operators import lines as ln


def page_noise(lines: DataFrame) -> DataFrame:
    """Lone page numbers, where a document has enough of them, and headers that recur beside page numbers."""
    rows = ln.with_code(lines).withColumns({
        "kind": F.when(F.col("in_code"), None).when(t.like(F.col("line"), p.BARE_NUMBER), "n").when(t.like(F.col("line"), p.BARE_ROMAN), "r"),
        "core": F.when(~F.col("in_code"), F.lower(t.footer_text(F.col("line")))),
        "solid": ~t.is_blank(F.col("line")),
    })
    mark = F.when(F.col("solid"), F.coalesce("kind", F.lit("-")))
    rows = rows.withColumns({
        "prev": F.last(mark, ignorenulls=True).over(ln.before()), "next": F.first(mark, ignorenulls=True).over(ln.after()),
        "numbers": F.count_if(F.col("kind") == "n").over(ln.doc()), "romans": F.count_if(F.col("kind") == "r").over(ln.doc()),
        "repeats": F.count("core").over(Window.partitionBy("doc_id", "core")),
    })
    enough = ((F.col("kind") == "n") & (F.col("numbers") >= p.BARE_NUMBERS)) | ((F.col("kind") == "r") & (F.col("romans") >= p.BARE_ROMANS))
    alone = (F.coalesce("prev", F.lit("-")) == "-") & (F.coalesce("next", F.lit("-")) == "-")
    drop = (enough & alone) | (F.col("core").isNotNull() & (F.col("repeats") >= p.HEADER_REPEATS))
    return rows.select("doc_id", "pos", "line", F.coalesce(drop, F.lit(False)).alias("drop"))


def toc_tables(lines: DataFrame) -> DataFrame:
    """Table regions made of page references and empty cells, and title fragments between two of them."""
    rows = ln.with_code(lines).withColumn("row", ~F.col("in_code") & t.is_row(F.col("line")))
    last = F.last(F.when(F.col("row"), F.col("pos")), ignorenulls=True).over(ln.before())
    rows = rows.withColumn("region", F.when(F.col("row"), ln.islands(F.col("row"), F.col("pos") - last - 1 <= p.REGION_GAP)))
    parts = t.cells(F.col("line"))
    body = rows.where("row").select("doc_id", "region", "pos", parts.alias("cells")).withColumn("counts", ~t.is_separator(F.col("cells")))
    number = lambda c: F.sum(F.when(F.col("counts"), c).otherwise(0))
    per = body.groupBy("doc_id", "region").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.count_if("counts").alias("rows"), number(F.size("cells")).alias("total"),
        number(F.size(F.filter("cells", lambda c: c == ""))).alias("empty"), number(F.size(F.filter("cells", t.is_page_reference))).alias("pages"),
    )
    nav = per.where((F.col("rows") >= p.REGION_ROWS) & (F.col("pages") / F.col("total") >= p.REFERENCE_PERCENT / 100) & (F.col("empty") / F.col("total") >= p.EMPTY_PERCENT / 100))
    # a region and, up to the next one, the bridge that ends it
    by_start = Window.partitionBy("doc_id").orderBy("start")
    nav = nav.select("doc_id", "start", "end", F.lead("start").over(by_start).alias("follow"))
    spans = nav.select("doc_id", "start", "end", F.when(F.col("follow") - F.col("end") - 1 <= p.BRIDGE_GAP, F.col("follow")).alias("bridge"))
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "bridge")).alias("spans"))
    rows = rows.join(spans, "doc_id", "left")
    at = F.col("pos")
    inside = F.exists("spans", lambda s: (at >= s["start"]) & (at <= s["end"]))
    bridged = F.exists("spans", lambda s: (at > s["end"]) & (at < s["bridge"])) & t.is_fragment(F.col("line"))
    return rows.select("doc_id", "pos", "line", (~F.col("in_code") & F.coalesce(inside | F.coalesce(bridged, F.lit(False)), F.lit(False))).alias("drop"))


def plain_toc(lines: DataFrame) -> DataFrame:
    """Dense clusters of leader lines and the title fragments among them."""
    rows = ln.with_code(lines).withColumns({"signal": ~F.col("in_code") & t.is_toc_signal(F.col("line")), "solid": (~t.is_blank(F.col("line"))).cast("int")})
    rows = rows.withColumns({"upto": F.sum("solid").over(ln.until()), "signals": F.count_if("signal").over(ln.doc())})
    last = F.last(F.when(F.col("signal"), F.col("upto")), ignorenulls=True).over(ln.before())
    rows = rows.withColumn("last", last)
    rows = rows.withColumn("cluster", ln.islands(F.col("signal"), F.col("upto") - F.col("solid") - F.col("last") <= p.TOC_GAP))
    inside = Window.partitionBy("doc_id", "cluster")
    rows = rows.withColumns({"n": F.count_if("signal").over(inside), "end": F.max(F.when(F.col("signal"), F.col("pos"))).over(inside)})
    dense = (F.col("signals") >= p.TOC_SIGNALS) & (F.col("n") >= p.TOC_CLUSTER) & (F.col("cluster") > 0) & (F.col("pos") <= F.col("end"))
    drop = dense & (F.col("signal") | (~F.col("in_code") & t.is_fragment(F.col("line"))))
    return rows.select("doc_id", "pos", "line", F.coalesce(drop, F.lit(False)).alias("drop"))


def repeated_blocks(lines: DataFrame) -> DataFrame:
    """Lines that recur with the same lines above and below."""
    rows = ln.with_code(lines).withColumn("s", t.strip(F.col("line")))
    own = F.when(~F.col("in_code") & (F.col("s") != ""), F.col("s"))
    rows = rows.withColumns({"own": own, "above": F.coalesce(F.last(own, ignorenulls=True).over(ln.before()), F.lit("")), "below": F.coalesce(F.first(own, ignorenulls=True).over(ln.after()), F.lit(""))})
    rows = rows.withColumn("n", F.count("own").over(Window.partitionBy("doc_id", "above", "own", "below")))
    drop = F.col("own").isNotNull() & (F.col("n") >= p.BOILERPLATE_REPEATS) & (F.length("s") >= p.BOILERPLATE_LENGTH) & F.regexp_like("s", F.lit("[A-Za-z]")) & ~F.regexp_like("s", F.lit("^[#|>]"))
    return rows.select("doc_id", "pos", "line", F.coalesce(drop, F.lit(False)).alias("drop"))


def chapter_titles(lines: DataFrame) -> DataFrame:
    """(doc_id, title, heading): the first chapter line of each title."""
    line = F.col("line")
    rows = lines.where(t.like(line, p.CHAPTER)).select("doc_id", "pos", t.squash(t.group(line, p.CHAPTER, 3)).alias("title"), F.concat_ws(" ", t.group(line, p.CHAPTER, 1), t.group(line, p.CHAPTER, 2)).alias("kind"))
    rows = rows.where(F.length("title") >= p.TITLE_LENGTH).groupBy("doc_id", "title").agg(F.min_by("kind", "pos").alias("kind"))
    return rows.select("doc_id", "title", F.concat_ws(": ", "kind", "title").alias("heading"))


PASSES = {"page_noise": page_noise, "toc_tables": toc_tables, "plain_toc": plain_toc, "repeated_blocks": repeated_blocks}


def kept(marked: DataFrame) -> DataFrame:
    """Lines that stay, numbered anew by their old positions."""
    return marked.where(~F.col("drop")).drop("drop")


def summary(marked: DataFrame) -> DataFrame:
    """Per document: lines before, lines dropped, and a digest of the text that is left."""
    parts = F.array_sort(F.collect_list(F.when(~F.col("drop"), F.struct("pos", "line"))))
    text = F.array_join(F.transform(parts, lambda x: x["line"]), "\n")
    return marked.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("drop").alias("n_dropped"), F.md5(text.cast("binary")).alias("text_md5"))
