"""Documents as lines: explode once, mark, delete, and put together again.

Every window here is partitioned by the row key and ordered by position, so a
chain of them needs one exchange.  The row key is a column of the caller's
(doc_id); rows are told apart by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marlstone.functions import text as t


def doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def order() -> WindowSpec:
    return doc().orderBy("pos")


def before() -> WindowSpec:
    return order().rowsBetween(Window.unboundedPreceding, -1)


def until() -> WindowSpec:
    return order().rowsBetween(Window.unboundedPreceding, 0)


def after() -> WindowSpec:
    return order().rowsBetween(1, Window.unboundedFollowing)


def explode(docs: DataFrame, text: str = "text") -> DataFrame:
    """lines(doc_id, pos, line)."""
    return docs.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def with_code(lines: DataFrame) -> DataFrame:
    """Adds is_fence, and in_code: markers and lines in open fences."""
    lines = lines.withColumn("is_fence", t.is_fence(F.col("line")))
    open_before = F.coalesce(F.sum(F.col("is_fence").cast("int")).over(before()), F.lit(0)) % 2 == 1
    return lines.withColumn("in_code", F.col("is_fence") | open_before)


def islands(flag: Column, near: Column) -> Column:
    """Number of the island a flagged row is in; ``near`` says whether it goes on from the flagged row before."""
    return F.sum(F.when(flag & ~F.coalesce(near, F.lit(False)), 1).otherwise(0)).over(until())


def assemble(lines: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text) of the lines that are there; documents without lines aren't."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias(text))
