"""Helpers that the operators share: connected components, group streaming, names that clash with none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.storage import Scratch

#: ASCII white space separates words; everything else belongs to them.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str, deal: bool = True) -> DataFrame:
    """A table; one in fewer splits than there are cores is dealt to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if deal and df.rdd.getNumPartitions() < cores else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def running(rows: DataFrame, scratch: Scratch, name: str, order: list, sums: dict) -> DataFrame:
    """``rows`` with, for each name in ``sums``, the sum of its column over all rows that come before.

    Rows are put into ranges of the order once and written so; sums within the
    ranges and over them, whose number is that of shuffle partitions, make up the
    whole, so that no task sorts all rows.
    """
    part, *temp = fresh(rows, "part", *(f"off_{k}" for k in sums))
    ranged = scratch.keep(rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn(part, F.spark_partition_id()), name)
    held = ranged.groupBy(part).agg(*[F.sum(c).alias(k) for k, c in zip(temp, sums.values())])
    zero = lambda c: F.coalesce(c, F.lit(0))
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(part, *[zero(F.sum(k).over(until(Window.orderBy(part)))).alias(k) for k in temp])
    inside = until(Window.partitionBy(part).orderBy(*order))
    out = ranged.withColumns({k: zero(F.sum(c).over(inside)) for k, c in sums.items()}).join(F.broadcast(offsets), part)
    return out.withColumns({k: F.col(k) + F.col(t) for k, t in zip(sums, temp)}).drop(part, *temp)


#: Rounds whose maps are composed in one plan.
FOLDED = 4


def components(edges: DataFrame, scratch: Scratch, name: str, seed: int = 1) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``; root is the smallest id reachable.

    Randomised contraction: in each round every node finds the node that comes
    first among its neighbours and theirs, in an order drawn anew for the round,
    and is contracted to it.  Stars collapse at once, and long chains shrink to
    about a third a round, so the rounds grow with the logarithm of the nodes
    however ids are laid out.  The maps are then composed from the last to the
    first, FOLDED of them at a time, and the smallest id of each group is found at
    the end.  Every round's tables are written to the shared folder, and no plan
    grows with the number of rounds; what is joined are tables and not aggregates,
    so that joins can be split where one node has very many edges.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    edges = scratch.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e0")
    maps = []
    while not edges.isEmpty():
        k = len(maps)
        least = lambda c: F.min(F.struct(F.xxhash64(c, F.lit(seed), F.lit(k)).alias("h"), c))[c]  # noqa: E731,B023
        ends = edges.select(F.explode(F.array(*(F.struct(F.col(x).alias("node"), F.col(y).alias("to")) for x in "ab" for y in "ab"))).alias("e")).select("e.node", "e.to")
        first = scratch.keep(ends.groupBy("node").agg(least("to").alias("root")).withColumnRenamed("node", "to"), f"{name}-p{k}")
        step = scratch.keep(ends.join(first, "to").groupBy("node").agg(least("root").alias("root")), f"{name}-m{k}")
        of = lambda x: step.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))  # noqa: E731,B023
        less = edges.join(of("a"), "a").join(of("b"), "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = scratch.keep(less, f"{name}-e{k + 1}")
        scratch.drop(f"{name}-e{k}", f"{name}-p{k}")
        maps.append(step)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    groups = maps[-1]
    for k in reversed(range(len(maps) - 1)):
        later = groups.select(F.col("node").alias("root"), F.col("root").alias("root2"))
        groups = maps[k].join(later, "root", "left").select("node", F.coalesce("root2", "root").alias("root"))
        if k and k % FOLDED == 0:
            groups = scratch.keep(groups, f"{name}-c{k}")
    smallest = scratch.keep(groups.groupBy("root").agg(F.min("node").alias("least")), f"{name}-least")
    out = scratch.keep(groups.join(smallest, "root").select("node", F.col("least").alias("root")), f"{name}-out")
    scratch.drop(f"{name}-e{len(maps)}", f"{name}-least", *[f"{name}-{x}{i}" for i in range(len(maps)) for x in "mc"])
    return out


class Forest:
    """Union-find over the items of one bounded block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def grouped(batches: Iterator, keys: list[str]) -> Iterator:
    """Arrow tables of one key each, from batches sorted by integer ``keys``; only the present group is held."""
    import pyarrow as pa

    held: list = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(n, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            key = tuple(int(c[a]) for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
