"""Substring dedup by hashing lines and passages of them.

``repeats`` lists what goes and ``dedup`` cuts it out.  Two kinds of pieces are
normalised to their words in lower case with single spaces, and hashed to 96
bits:

* whole lines, however short;
* spans of at least SPAN words between cuts, wherever lines end.  A cut is the
  word with the least hash of any WINDOW words in a row, so every WINDOW words
  have one and cuts depend on nothing further away.  A passage repeated
  anywhere therefore has the same cuts but for up to WINDOW words at either edge,
  and its last span may end SPAN - 1 words before the last of them.

Over all rows, the earliest occurrence of a digest by (doc_id, row, place in
the text) stays; later ones are repeats.  Repeated pieces that overlap or touch
make a stretch, in which every word belongs to a repeated digest.  Stretches of
at least MIN_RUN words go, and repeated whole lines always.

A common piece is counted in each task before the shuffle, and the joins that
find its repeats may be split, so none of them gathers in one task.

Defined cases: null and empty texts have no pieces; every row is a document of
its own, so that equal or null doc_ids decide rank only; rows without doc_id
come last in rank, and rows of one rank stand in the order they are read in; a
piece that overlaps its own first occurrence isn't a repeat.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import fresh
from marlstone.llm.hashing import _SPACE, U64, _power_tables, mix, rows_of_words, separated, stream, text_blocks, word_hashes
from marlstone.storage import Scratch

MIN_RUN = 20
LAST = (1 << 63) - 1
SPAN = 8
WINDOW = 13
PIECES = "hi long, lo int, key long, doc_id long, line boolean, at int, to int, start int, end int"

def without_cuts(rows: DataFrame, names: list[str], cuts: str) -> DataFrame:
    """Columns ``names`` of ``rows``, their texts without the spans in the column ``cuts``."""
    kept = F.aggregate(
        cuts,
        F.struct(F.lit("").alias("t"), F.lit(0).alias("at")),
        lambda acc, c: F.struct(F.concat(acc["t"], F.substring("text", acc["at"] + 1, c["start"] - acc["at"])).alias("t"), c["end"].alias("at")),
        lambda acc: F.concat(acc["t"], F.substring("text", acc["at"] + 1, F.length("text"))),
    )
    whole = F.col(cuts).isNull()
    rows = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(kept))
    return rows.where(whole | F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))).select(*[F.col(f"`{c}`") for c in names])


def span_cuts(words: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Indices of the words before which spans begin or end: least hashes of windows, the first words of rows, and the end."""
    cut = np.zeros(len(words) + 1, dtype=bool)
    cut[bounds] = True
    if len(words) >= window:
        least = np.lib.stride_tricks.sliding_window_view(words, window)[:, ::-1].argmin(axis=1)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        inside = np.flatnonzero(row[: len(least)] == row[window - 1 :])
        cut[inside + window - 1 - least[inside]] = True
    return np.flatnonzero(cut)


def block_pieces(raw: np.ndarray, offsets: np.ndarray, span: int = SPAN, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Pieces of a block of rows: row, digests, whether it's a line, words and code points in the row from and to."""
    raw, offsets = separated(raw, offsets)
    words, starts = word_hashes(raw)
    if not len(words):
        return {}
    ends = np.flatnonzero(np.diff(_SPACE[raw].view(np.int8), append=np.int8(1)) == 1) + 1
    bounds = rows_of_words(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    line_end = np.ones(len(words), dtype=bool)
    line_end[:-1] = (breaks[starts[1:]] > breaks[ends[:-1]]) | (row[1:] != row[:-1])
    line_to = np.flatnonzero(line_end) + 1
    cuts = span_cuts(words, bounds, window)
    begin = cuts[:-1]
    begin = begin[begin + span <= bounds[row[begin] + 1]]
    line = np.arange(len(line_to) + len(begin)) < len(line_to)
    at = np.concatenate([[0], line_to[:-1], begin])
    to = np.concatenate([line_to, cuts[np.searchsorted(cuts, begin + span)]])
    up, down = _power_tables(len(words) + 1)
    digests = []
    with np.errstate(over="ignore"):
        for seed in (62, 63):
            sums = np.concatenate([[U64(0)], np.cumsum(mix(words ^ stream(seed, 1)[0]) * up[: len(words)])])
            digests.append(mix(mix((sums[to] - sums[at]) * down[at]) + (2 * (to - at) + line).astype(U64)))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    of = row[at]
    zero = points[offsets[of]]
    return {"row": of, "hi": digests[0], "lo": digests[1], "line": line, "at": at - bounds[of], "to": to - bounds[of], "start": points[starts[at]] - zero, "end": points[ends[to - 1]] - zero}


def piece_finder(span: int, window: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, ids = batch.column(0), batch.column(1)
            for a, _, raw, offsets in text_blocks(batch.column(2)):
                p = block_pieces(raw, offsets, span, window)
                if p:
                    of = pa.array(p["row"] + a)
                    cols = [pa.array(p["hi"].view(np.int64)), pa.array(p["lo"].view(np.int64).astype(np.int32)), keys.take(of), ids.take(of), pa.array(p["line"]), *(pa.array(p[k].astype(np.int32)) for k in ("at", "to", "start", "end"))]
                    yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def _keyed_repeats(rows: DataFrame, scratch: Scratch, min_run: int) -> DataFrame:
    """What goes, by the ``key`` of each of ``rows`` (key, doc_id, text)."""
    pieces = scratch.keep(rows.select("key", F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(piece_finder(SPAN, WINDOW), PIECES), "pieces")
    # Equal digests have equal n_words and kind, so these go with the digest; packed, as every piece is shuffled twice.
    packed = pieces.selectExpr(
        "hi", "shiftleft(cast(lo as long), 32) + (to - at) * 2L + int(line) as tag", "key * 2 + int(doc_id is null) as mark", f"coalesce(doc_id, {LAST}) as rank",
        "shiftleft(cast(at as long), 32) + start as place", "end - start as length",
    )
    # Few digests come twice, so that only their hashes are shuffled for all pieces before the rest goes; tables
    # of their own, not aggregates, meet the pieces in joins that can be split where one of them is very common.
    again = scratch.keep(packed.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1").select("hi"), "again")
    packed = scratch.keep(packed.join(again, "hi"), "repeated")
    firsts = packed.groupBy("hi", "tag").agg(F.min(F.struct("rank", "mark", "place")).alias("f"), F.count("*").alias("n")).where("n > 1").select("hi", "tag", "f")
    firsts = scratch.keep(firsts, "firsts")
    found = packed.join(firsts, ["hi", "tag"]).where("mark <> f.mark or shiftright(place, 32) >= shiftright(f.place, 32) + shiftright(tag & 4294967295, 1)")
    found = found.selectExpr(
        "shiftright(mark, 1) as key", "if(mark & 1 = 1, null, rank) as doc_id", "tag & 1 = 1 as line", "int(shiftright(place, 32)) as at", "int(shiftright(place, 32) + shiftright(tag & 4294967295, 1)) as to",
        "int(place & 4294967295) as start", "int((place & 4294967295) + length) as end", "if(f.mark & 1 = 1, null, f.rank) as first_doc_id", "int(shiftright(f.place, 32)) as first_word",
    )
    by_place = Window.partitionBy("key").orderBy("at", "to")
    reach = F.max("to").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("fresh", F.when(reach >= F.col("at"), 0).otherwise(1)).withColumn("stretch", F.sum("fresh").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("key", "stretch")
    found = found.withColumn("long", F.max("to").over(whole) - F.min("at").over(whole) >= min_run).where("long or line")
    found = found.withColumn("part", F.when(F.col("long"), -1).otherwise(F.col("at")))
    return found.groupBy("key", "stretch", "part").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"), (F.max("to") - F.min("at")).cast("long").alias("n_words"),
        F.min(F.struct("at", "to", "line", "first_doc_id", "first_word")).alias("f"),
    ).select("key", "doc_id", "start", "end", "n_units", "n_words", F.col("f.first_doc_id").alias("first_doc_id"), F.col("f.first_word").alias("first_word"))


def repeats(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """What goes: doc_id, start, end (code points, end excluded), n_units (repeated pieces in it), n_words, and where its first piece stands first (first_doc_id, first_word)."""
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    return _keyed_repeats(rows, Scratch(docs.sparkSession, "substring"), min_run).drop("key")


def dedup(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """The rows of ``docs`` with the repeats cut out of their texts; rows of which nothing but white space is left go."""
    scratch, (key, spans) = Scratch(docs.sparkSession, "substring"), fresh(docs, "key", "spans")
    rows = scratch.keep(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    cuts = _keyed_repeats(rows.select(F.col(key).alias("key"), "doc_id", "text"), scratch, min_run)
    cuts = cuts.groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans))
    return without_cuts(rows.join(cuts.hint("shuffle_hash"), key, "left"), docs.columns, spans)
