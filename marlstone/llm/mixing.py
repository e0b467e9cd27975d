"""Mixing sources to target weights by capped water-filling.

The whole to share is a percentage of all sizes.  Every source's target is its
weight's share of it, but at most the cap (max_epochs times its size); what a
source can't take goes to the others by weight, until none is above its cap.
Sorted by cap over weight, the sources that fill up are a prefix, so one
running sum finds the level.

A source whose target is e times its size takes every document floor(e) times,
and once more those that come first in a seeded order of its documents until
the rest of the target is used up; the last of these is taken if that brings
the sum nearer.  The order is by a digest of the id and needs no sort of a
source: documents fall into buckets by the digest's head, whose sums are added
up, and only the bucket in which the rest ends is put in order, to find the
last digest taken.  Documents with one id have one digest and are taken alike.

DataFrame functions only.  Defined cases: null and empty texts have size 0; a
null source is a source, last in order; null ids are one id; with an empty
table the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import WORD, fresh, running
from marlstone.storage import Scratch

WEIGHTS = (3, 1, 2)
TOTAL_PERCENT = 150
MAX_EPOCHS = 2
SEED = 17
#: Hexadecimal digits of a digest that name its bucket: 4096 buckets a source.
HEAD = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ticket(seed: int) -> Column:
    """The digest that orders a source's documents."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def targets(per: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, total_percent: int = TOTAL_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size and target, from source and source_size; running sums over sources, in ranges, so that there may be many."""
    by_name = F.col("source").asc_nulls_last()
    row = running(per, scratch, "places", [by_name], {"place": F.lit(1)})
    row = row.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int")))
    row = row.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    row = running(row, scratch, "levels", [F.col("level"), by_name], {"capped": F.col("cap"), "done": F.col("weight")})
    # the level at which the rest would be shared if exactly the sources before this one were full
    whole = row.agg(F.sum("source_size") * F.lit(total_percent) / F.lit(100.0)).scalar()
    row = row.withColumn("share", (whole - F.col("capped")) / (row.agg(F.sum("weight")).scalar() - F.col("done")))
    water = row.where("share <= level").agg(F.min(F.struct("level", "share"))["share"]).scalar()
    return row.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * water, F.col("cap"))).alias("target"))


def plan(rows: DataFrame, scratch: Scratch, weights: tuple[int, ...], total_percent: int, max_epochs: int) -> DataFrame:
    """For each source of rows(source, size, ticket): source_size, target, whole (repetitions of every document), cut (last digest that is taken once more)."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(per, scratch, weights, total_percent, max_epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = scratch.keep(goal.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "goal")

    rows = rows.withColumn("bucket", F.substring("ticket", 1, HEAD))
    in_order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(in_order), F.lit(0)))
    edge = sums.alias("x").join(goal.alias("g"), F.col("x.source").eqNullSafe(F.col("g.source"))).where("before < rest and before + held >= rest")
    edge = scratch.keep(edge.select("x.source", "bucket", "before", "rest"), "edge")
    one_by_one = Window.partitionBy("r.source").orderBy("ticket", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.alias("r").join(edge.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.bucket") == F.col("e.bucket")))
    inside = inside.select("r.source", "ticket", "size", "rest", (F.col("before") + F.coalesce(F.sum("size").over(one_by_one), F.lit(0))).alias("at"))
    last = inside.where("at + size / 2.0D <= rest").groupBy("source").agg(F.max("ticket").alias("last"))
    cut = edge.alias("e").join(last.alias("l"), F.col("e.source").eqNullSafe(F.col("l.source")), "left").select("e.source", F.coalesce("last", "bucket").alias("cut"))
    out = goal.alias("g").join(cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left")
    return scratch.keep(out.select("g.source", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut")), "plan")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_percent: int = TOTAL_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target, taken: a row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.keep(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), size_of(F.col("text")).alias("size"), ticket(seed).alias("ticket")), "sizes")
    made = plan(rows, scratch, weights, total_percent, max_epochs)
    out = rows.alias("r").join(made.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    n = F.col("whole") + (F.col("ticket") <= F.col("cut")).cast("long")
    return out.select("doc_id", "size", "r.source", "source_size", "target", (n * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_percent: int = TOTAL_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(F.col("source").cast("string"), size_of(F.col("text")).alias("size"), ticket(seed).alias("ticket"))
    source, whole, cut, times, k = fresh(docs, "source_", "whole", "cut", "times", "k")
    made = plan(scratch.keep(rows, "sizes"), scratch, weights, total_percent, max_epochs).select(F.col("source").alias(source), F.col("whole").alias(whole), F.col("cut").alias(cut))
    rows = docs.join(made, F.col("source").cast("string").eqNullSafe(F.col(source)))
    n = F.col(whole) + (ticket(seed) <= F.col(cut)).cast("long")
    rows = rows.withColumn(times, n).where(F.col(times) > 0).withColumn(k, F.explode(F.sequence(F.lit(1), F.col(times))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB's form of mix() with its default settings.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS ticket
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM d GROUP BY source),
lev AS (
  SELECT *, CAST(source_size * 2 AS DOUBLE) AS cap, CAST(source_size * 2 AS DOUBLE) / weight AS level,
         CAST(sum(source_size) OVER () * 150 AS DOUBLE) / 100 AS whole, sum(weight) OVER () AS weights
  FROM per),
run AS (
  SELECT *, coalesce(sum(cap) OVER w, 0) AS capped, coalesce(sum(weight) OVER w, 0) AS done
  FROM lev WINDOW w AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sh AS (SELECT *, (whole - capped) / (weights - done) AS share FROM run),
goal AS (
  SELECT source, source_size,
         least(cap, coalesce(weight * (SELECT share FROM sh WHERE share <= level ORDER BY level, share LIMIT 1), cap)) AS target
  FROM sh),
g2 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM goal),
g3 AS (SELECT *, target - times * source_size AS rest FROM g2),
o AS (
  SELECT d.doc_id, d.size, d.source, source_size, target, times, rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ticket, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM d JOIN g3 ON d.source IS NOT DISTINCT FROM g3.source)
SELECT doc_id, size, source, source_size, target,
       CAST((times + CASE WHEN rest > 0 AND CAST(place AS DOUBLE) + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM o
"""
