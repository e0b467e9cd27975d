"""Near-duplicate embeddings by cross-polytope hashing.

A vector, padded to a power of two, is turned by three rounds of random signs
and a fast Hadamard transform; the hash is the axis that it then lies nearest
to, with its sign.  A table's code joins FUNCTIONS hashes.  Each vector stands
in its own bucket of every table, and looks into PROBES more: those that follow
in nearness to the turned vector.  Pairs that meet so are candidates.

Equal vectors become one node with a multiplicity, before anything is hashed
twice.  Buckets hold ids and sketches only: SKETCH signs of random projections,
by which a bucket's members are compared in bounded blocks.  Pairs that differ
in no more signs than any pair at the cosine does, but for one in a million,
join their vectors into groups; no pair is written.  A vector then goes to its
group once a block, where it's compared with all of the group exactly, in double
precision.  A block gives numbers of links and a spanning forest, never its
pairs; each pair of nodes meets in one block, so that no link counts twice.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, nor do vectors of different lengths link; rows
with equal vec_id are vectors of their own; rows without vec_id take part, and
are kept if their group has no vec_id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Forest, components, grouped, partitions
from marlstone.storage import Scratch

COSINE = 0.95
TABLES = 8
FUNCTIONS = 3
PROBES = 4
SEED = 3
#: Vectors on one side of a block, and sketches on one side of a block.
BLOCK = 256
BLOCK_SKETCHES = 1024
#: Signs in a sketch.
SKETCH = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def codes(x: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(row, table, 1 + probes) bucket codes of unit vectors; the first of a table is the vector's own.

    A code's high bits are its table.
    """
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    signs = np.random.default_rng((seed, size)).choice([-1.0, 1.0], size=(tables, functions, 3, size))
    out = np.empty((n, tables, 1 + probes), dtype=np.int64)
    rows = np.arange(n)[:, None]
    near = min(size, 3)
    for t in range(tables):
        axes, loss = [], []
        for f in range(functions):
            y = padded
            for k in range(3):
                y = hadamard(y * signs[t, f, k])
            order = np.argpartition(-np.abs(y), near - 1, axis=1)[:, :near]
            order = np.take_along_axis(order, np.argsort(-np.abs(np.take_along_axis(y, order, axis=1)), axis=1, kind="stable"), axis=1)
            top = np.take_along_axis(y, order, axis=1)
            axes.append(2 * order + (top < 0))
            loss.append((np.abs(top[:, :1]) - np.abs(top)) ** 2)
        # every choice of one of the nearest axes for each function, by what it loses
        grid = np.stack(np.meshgrid(*[np.arange(near)] * functions, indexing="ij"), axis=-1).reshape(-1, functions)
        total = sum(loss[f][:, grid[:, f]] for f in range(functions))
        best = np.argsort(total, axis=1, kind="stable")[:, : 1 + probes]
        code = np.full((n, best.shape[1]), t, dtype=np.int64)
        for f in range(functions):
            code = code * (2 * size) + axes[f][rows, grid[best][:, :, f]]
        out[:, t, : code.shape[1]] = code
        out[:, t, code.shape[1] :] = -1
    return out


def sketch(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """(row, SKETCH // 8) bytes: signs of projections of unit vectors."""
    axes = np.random.default_rng((seed, x.shape[1], 1)).normal(size=(x.shape[1], SKETCH))
    return np.packbits(x @ axes > 0, axis=1)


def most_differing(cosine: float) -> int:
    """Signs in which two vectors at the cosine differ at most, but for one pair in a million."""
    p = float(np.arccos(np.clip(cosine, -1, 1))) / np.pi
    return int(np.ceil(SKETCH * p + 5 * np.sqrt(SKETCH * p * (1 - p)) + 1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rows_by_length(column):
    """(places, matrix in double precision) of the usable vectors of an Arrow list column, by their length."""
    import pyarrow as pa

    sizes = np.array([len(v) if v is not None else 0 for v in column.to_pylist()], dtype=np.int64) if column.null_count else np.diff(np.asarray(column.offsets))
    for d in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == d)
        x = np.asarray(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(at), d)
        fine = np.isfinite(x).all(axis=1) & (np.abs(x).max(axis=1) > 0)
        if fine.any():
            yield at[fine], x[fine]


def marker():
    """Digests of usable vectors, null for others."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            digests = [None] * batch.num_rows
            for at, x in rows_by_length(batch.column(1)):
                for i, v in zip(at, x):
                    digests[i] = xxhash.xxh3_128_digest(v.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=["vec_id", "embedding", "rid", "digest"])

    return run


def hasher(tables: int, functions: int, probes: int, seed: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found, signs = [None] * batch.num_rows, [None] * batch.num_rows
            for at, x in rows_by_length(batch.column(1)):
                x = unit(x)
                c, s = codes(x, tables, functions, probes, seed).reshape(len(at), -1), sketch(x, seed)
                for k, i in enumerate(at):
                    found[i], signs[i] = c[k], s[k].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(signs, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["rid", "embedding", "m", "signs", "codes"])

    return run


def forest(linked: np.ndarray) -> np.ndarray:
    """Smallest row index that each row of a symmetric link matrix reaches."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked)))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def near_blocks(most: int):
    """Blocks of one bucket: sketches of side 0 (owners) against side 1 (all); gives a spanning forest of pairs that may be linked."""

    def run(batches):
        import pyarrow as pa

        for table in grouped(batches, ["code", "size", "i", "j"]):
            side, rid = table["side"].to_numpy(), table["rid"].to_numpy()
            l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            bits = np.frombuffer(b"".join(table["signs"].to_pylist()), dtype=np.uint64).reshape(len(rid), -1)
            ids, index = np.unique(rid, return_inverse=True)
            up = Forest(len(ids))
            a, b = [], []
            step = max(1, (1 << 20) // max(1, len(r)))
            for at in range(0, len(l), step):
                x = l[at : at + step]
                differ = np.zeros((len(x), len(r)), dtype=np.int16)
                for k in range(bits.shape[1]):
                    differ += np.bitwise_count(bits[x, k][:, None] ^ bits[r, k][None, :])
                for u, v in zip(*np.nonzero(differ <= most)):
                    u, v = int(index[x[u]]), int(index[r[v]])
                    if up.union(u, v):
                        a.append(ids[u])
                        b.append(ids[v])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def block_links(cosine: float):
    """Blocks of one group, i <= j: all pairs of a block with itself, or of two; gives (a, null, links) counts and (a, b, 0) links of a spanning forest."""

    def run(batches):
        import pyarrow as pa

        for table in grouped(batches, ["grp", "i", "j"]):
            rid, m, side = (table[c].to_numpy() for c in ("rid", "m", "side"))
            alone = int(table["i"][0].as_py()) == int(table["j"][0].as_py())
            x = unit(np.asarray(table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(rid), -1))
            l, r = (np.arange(len(rid)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            hit = (x[l] @ x[r].T) >= cosine
            if alone:
                np.fill_diagonal(hit, False)
            count = np.zeros(len(rid), dtype=np.int64)
            count[l] += hit @ m[r]
            if not alone:
                count[r] += hit.T @ m[l]
            link = np.zeros((len(rid), len(rid)), dtype=bool)
            link[np.ix_(l, r)] = hit
            link |= link.T
            some = np.flatnonzero(count)
            if len(some):
                root = forest(link[np.ix_(some, some)])
                child = np.flatnonzero(root != np.arange(len(some)))
                a = np.concatenate([rid[some], rid[some[child]]])
                b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(rid[some[root[child]]])])
                n = np.concatenate([count[some], np.zeros(len(child), dtype=np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(n)], names=["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of ``vectors``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "polytope")
    n, wide = partitions(spark), 1 + probes
    kind = vectors.schema["embedding"].dataType
    kind = "array<float>" if kind.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind), F.monotonically_increasing_id().alias("rid"))
    rows = scratch.keep(rows.mapInArrow(marker(), f"vec_id long, embedding {kind}, rid long, digest binary"), "rows")

    # one node for each distinct vector, by the digest of its components
    nodes = scratch.keep(rows.where("digest is not null").groupBy("digest").agg(F.min("rid").alias("node"), F.count("*").alias("m")), "nodes")
    first = rows.join(nodes.select(F.col("node").alias("rid"), "m"), "rid").select("rid", "embedding", "m")
    first = scratch.keep(first.mapInArrow(hasher(tables, functions, probes, seed), f"rid long, embedding {kind}, m long, signs binary, codes array<long>"), "codes")

    spread = first.select("rid", F.size("embedding").alias("size"), F.posexplode("codes").alias("at", "code")).where("code >= 0")
    spread = spread.select("rid", "size", "code", (F.col("at") % wide == 0).alias("own"))
    buckets = spread.groupBy("code", "size").agg(F.count("*").alias("n"), F.count_if("own").alias("n_own")).where("n > 1 and n_own > 0")
    parts = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    h = F.xxhash64("rid", F.lit(1))
    met = spread.join(buckets.select("code", "size", parts("n_own", BLOCK_SKETCHES).alias("ni"), parts("n", BLOCK_SKETCHES).alias("nj")), ["code", "size"])
    met = met.join(first.select("rid", "signs"), "rid")
    keys = ["code", "size", "i", "j"]
    owners = met.where("own").select("code", "size", F.pmod(h, "ni").cast("int").alias("i"), F.explode(upto("nj")).alias("j"), F.lit(0).alias("side"), "rid", "signs")
    every = met.select("code", "size", F.explode(upto("ni")).alias("i"), F.pmod(h, "nj").cast("int").alias("j"), F.lit(1).alias("side"), "rid", "signs")
    near = owners.unionAll(every).repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(near_blocks(most_differing(cosine)), "a long, b long")
    groups = components(scratch.keep(near, "near"), scratch, "near").withColumnsRenamed({"node": "rid", "root": "grp"})

    # all pairs of a group; blocks are named by two slices of it, the lesser first
    sizes = groups.groupBy("grp").agg(F.count("*").alias("size")).select("grp", parts("size", BLOCK).alias("nk"))
    held = groups.join(sizes, "grp").join(first.select("rid", "embedding", "m"), "rid").withColumn("k", F.pmod(F.xxhash64("rid", F.lit(2)), "nk").cast("int"))
    dealt = held.withColumn("o", F.explode(upto("nk"))).select("grp", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), (F.col("k") > F.col("o")).cast("int").alias("side"), "rid", "m", "embedding")
    keys = ["grp", "i", "j"]
    found = scratch.keep(dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(block_links(cosine), "a long, b long, n long"), "found")

    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    roots = scratch.keep(components(found.where("b is not null"), scratch, "groups"), "roots")
    named = rows.select("vec_id", "rid", "digest").join(nodes, "digest", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node", "rid"))
    many = roots.select("root").unionAll(nodes.where("m > 1").select("node")).distinct()
    smallest = named.join(many, "root", "left_semi").groupBy("root").agg(F.min("vec_id").alias("least"))
    out = named.join(smallest, "root", "left").join(links, "node", "left")
    scratch.drop("near", "near-out", "groups-out", "codes")
    own = F.coalesce("least", "vec_id")
    n_links = F.coalesce("n_links", F.lit(0)) + F.coalesce("m", F.lit(1)) - 1
    return out.select("vec_id", n_links.cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, own.isNull()).alias("kept"))


#: DuckDB's form of near_duplicates() with its default settings, by all pairs; for small tables of whole vectors.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS reached FROM v UNION SELECT e.b, r.reached FROM r JOIN e ON r.id = e.a),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON vec_id = id LEFT JOIN n ON vec_id = a
"""
