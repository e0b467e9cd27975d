"""Near-duplicate documents by min-max hashing.

Each hash function gives two signature values, the minimum and the maximum of
the hashed shingles, so 64 evaluations give 128 values.  Bands of four values
make candidates; a candidate counts only after its Jaccard similarity has been
confirmed on the full shingle sets.

Steps (no step holds an unbounded group in one task):

1. One pass over the texts makes a sketch per document: set size, a 128-bit
   digest of the set, the band hashes, and four bits of each of the 128 values.
   Equal sets become one node.
2. Each band bucket links its members to two leaders (a star, not all pairs).
   The first leader is the member whose buckets are fullest, which is the one
   that a group of near copies was made from; the second is a random one.  Of
   its leaders that set sizes and the 128 values don't rule out, each node's
   likeliest is confirmed on the full sets.
3. In buckets that still hold several confirmed components, nodes outside the
   largest are compared with all of the bucket by set size and by the 128 values
   alone, in bounded blocks.  Pairs at least as likely to be similar as AGREE
   says join their components into groups; no pair is written.
4. What is left of such a group beside its largest component is compared with
   the group exactly, in bounded blocks of texts.

AGREE leaves room of six standard deviations below a similarity of 0.75, and a
pair at 0.5 seldom passes it, so texts that merely share boilerplate are neither
grouped nor moved.

Defined cases: null or empty texts have no shingles and link with nothing.
Rows with one doc_id count as one document, whose rows each keep their own
n_shingles.  Rows without doc_id link with nothing, have a null component_id
and are kept.  Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Forest, components, grouped, partitions
from marlstone.llm.hashing import U64, document_sets, mix, shingle_sets, split_rows, stream, text_blocks
from marlstone.storage import Scratch

SEED = 7
HASHES = 64
ROWS = 4
WIDTH = 5
PERCENT = 75
#: UTF-8 bytes of text that one side of a block holds; a single longer text is a block of its own.
BLOCK_BYTES = 1 << 18
SALT_ROWS = 64
#: Sketches on one side of a block.
BLOCK_ROWS = 1024


def least_agreement(percent: int, values: int) -> int:
    """How many of ``values`` four-bit values two sets of the similarity share at least, but for one pair in a thousand million."""
    share = percent / 100 + (1 - percent / 100) / 16
    return int(np.floor(values * share - 6 * np.sqrt(values * share * (1 - share))))


def sketcher(width: int, hashes: int, rows: int, seed: int):
    def run(batches):
        import pyarrow as pa

        odd = stream(seed, hashes) | U64(1)
        lift = stream(seed + 1, rows) | U64(1)
        n_bands = 2 * hashes // rows
        for batch in batches:
            ids, counts, hi, lo, bands, nibbles = batch.column(0), [], [], [], [], []
            for _, _, raw, offsets in text_blocks(batch.column(1)):
                words, bounds = split_rows(raw, offsets)
                sets = shingle_sets(words, bounds, width)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                some = np.flatnonzero(sizes)
                part = np.zeros((len(sets), n_bands), dtype=U64)
                two = np.zeros((2, len(sets)), dtype=U64)
                bits = np.zeros((len(sets), 2 * hashes), dtype=U64)
                if len(some):
                    flat = np.concatenate([sets[i] for i in some])
                    at = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                    values = np.empty((2 * hashes, len(some)), dtype=U64)
                    with np.errstate(over="ignore"):
                        for k in range(hashes):
                            x = flat * odd[k]
                            values[2 * k] = np.minimum.reduceat(x, at)
                            values[2 * k + 1] = np.maximum.reduceat(x, at)
                        acc = values.reshape(n_bands, rows, len(some))
                        h = np.arange(n_bands, dtype=U64)[:, None] + np.zeros(len(some), dtype=U64)
                        for r in range(rows):
                            h = mix((h ^ acc[:, r]) * lift[r])
                        bits[some] = (mix(values) & U64(15)).T
                        two[0, some] = np.add.reduceat(mix(flat ^ U64(0x5851F42D4C957F2D)), at)
                        two[1, some] = np.add.reduceat(mix(flat * U64(0x2545F4914F6CDD1D)), at)
                    part[some] = h.T
                counts.append(sizes)
                hi.append(two[0])
                lo.append(two[1])
                bands.append(part)
                nibbles.append(np.bitwise_or.reduce(bits.reshape(len(sets), -1, 16) << (U64(4) * np.arange(16, dtype=U64)), axis=2))
            if not counts:
                continue
            sizes = np.concatenate(counts)
            flat = np.concatenate(bands)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(np.concatenate(hi).view(np.int64)), pa.array(np.concatenate(lo).view(np.int64)), lists(flat), lists(np.concatenate(nibbles))], names=["doc_id", "n_shingles", "hi", "lo", "bands", "bits"])

    return run


def sketches(docs: DataFrame, width: int = WIDTH, hashes: int = HASHES, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    if hashes % 8:
        raise ValueError("hashes must be a multiple of 8")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        sketcher(width, hashes, rows, seed), "doc_id long, n_shingles long, hi long, lo long, bands array<long>, bits array<long>"
    )


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def confirm_stars(width: int, percent: int):
    """Rows sorted by (leader, salt, role): a leader's text, then its members'; gives the confirmed links."""

    def run(batches):
        import pyarrow as pa

        leader, heads = None, []
        for batch in batches:
            a, b = [], []
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), document_sets(batch.column(4), width))
            for lead, salt, role, node, shingles in rows:
                if (lead, salt) != leader:
                    leader, heads = (lead, salt), []
                if role == 0:
                    heads.append(shingles)
                elif any(linked(x, shingles, percent) for x in heads):
                    a.append(lead)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_blocks(percent: int, agree: int):
    """One block pair of a bucket at a time: role 0 rows against role 1 rows by size and sketch; gives a spanning set of links between components."""

    def run(batches):
        import pyarrow as pa

        low = U64(0x1111111111111111)
        for table in grouped(batches, ["h", "i", "j"]):
            role, comp, size = (table[c].to_numpy() for c in ("role", "comp", "n_shingles"))
            bits = np.asarray(table["bits"].combine_chunks().flatten()).view(U64).reshape(len(role), -1)
            l, r = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
            names, index = np.unique(comp, return_inverse=True)
            forest = Forest(len(names))
            a, b = [], []
            step = max(1, (1 << 20) // max(1, len(r)))
            for at in range(0, len(l), step):
                x = l[at : at + step]
                differ = np.zeros((len(x), len(r)), dtype=np.int16)
                for k in range(bits.shape[1]):
                    d = bits[x, k][:, None] ^ bits[r, k][None, :]
                    d |= d >> U64(2)
                    differ += np.bitwise_count((d | d >> U64(1)) & low)
                least, most = np.minimum(size[x][:, None], size[r][None, :]), np.maximum(size[x][:, None], size[r][None, :])
                hit = (16 * bits.shape[1] - differ >= agree) & (100 * least >= percent * most) & (comp[x][:, None] != comp[r][None, :])
                p, q = np.nonzero(hit)
                for u, v in np.unique(np.stack([index[x[p]], index[r[q]]], axis=1), axis=0).tolist():
                    if forest.union(u, v):
                        a.append(names[u])
                        b.append(names[v])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]):
    """For each left set, its intersection size with every right set."""
    owner = np.repeat(np.arange(len(right)), [len(s) for s in right])
    flat = np.concatenate(right)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for s in left:
        lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        n = hi - lo
        total = int(n.sum())
        if not total:
            yield np.zeros(len(right), dtype=np.int64)
            continue
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        yield np.bincount(owner[at], minlength=len(right))


def confirm_blocks(width: int, percent: int):
    """One block pair of a coarse group at a time: role 0 rows against role 1 rows, exactly; gives a spanning set of links between components."""

    def run(batches):
        import pyarrow as pa

        for table in grouped(batches, ["grp", "i", "j"]):
            role = table["role"].to_numpy()
            comp = table["comp"].to_numpy()
            sets = list(document_sets(table["text"], width))
            l, r = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
            if not len(l) or not len(r):
                continue
            names, index = np.unique(comp, return_inverse=True)
            forest = Forest(len(names))
            size = np.array([len(sets[x]) for x in r])
            a, b = [], []
            for x, both in zip(l, overlaps([sets[x] for x in l], [sets[x] for x in r])):
                hit = (both > 0) & (100 * both >= percent * (len(sets[x]) + size - both))
                for y in np.unique(index[r[hit]]):
                    if forest.union(int(index[x]), int(y)):
                        a.append(names[index[x]])
                        b.append(names[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def agreement(x: str, y: str, values: int):
    """Column: how many of the four-bit values of two sketches are equal."""
    differ = F.lit(0)
    for k in range(values // 16):
        d = F.col(x)[k].bitwiseXOR(F.col(y)[k])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x1111111111111111))
        differ = differ + F.bit_count(d)
    return F.lit(values) - differ


def in_blocks(rows: DataFrame, keys: list[str], minor, columns: list[str], salt: int) -> DataFrame:
    """Rows of each group dealt to its ni x nj blocks: ``minor`` rows as role 0 to one i and every j, all rows as role 1 to one j and every i."""
    h = F.xxhash64("id", F.lit(salt))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    one = rows.where(minor).select(*keys, F.pmod(h, "ni").cast("int").alias("i"), F.explode(upto("nj")).alias("j"), F.lit(0).alias("role"), *columns)
    every = rows.select(*keys, F.explode(upto("ni")).alias("i"), F.pmod(h, "nj").cast("int").alias("j"), F.lit(1).alias("role"), *columns)
    return one.unionAll(every).repartition(partitions(rows.sparkSession), *keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, hashes: int = HASHES, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    n, agree = partitions(spark), least_agreement(percent, 2 * hashes)
    sketch = scratch.keep(sketches(docs, width, hashes, rows, seed), "sketch")
    parts = lambda c, most: F.greatest(F.ceil(c / most), F.lit(1)).cast("int")

    # 1. nodes: one per distinct set
    nodes = sketch.where("n_shingles > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    nodes = scratch.keep(nodes, "nodes")
    sets = nodes.select("id", "n_shingles", "bits")

    # 2. stars: each bucket's members to its two leaders
    spread = nodes.select("id", F.explode("bands").alias("h"))
    met = scratch.keep(spread.join(spread.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "h"), "met")
    fame = met.groupBy("id").agg(F.sum("n").alias("fame"))
    leaders = met.join(fame, "id").groupBy("h").agg(F.max(F.struct("fame", (-F.col("id")).alias("x"), "id"))["id"].alias("l1"), F.min(F.struct(F.xxhash64("id", "h").alias("x"), "id"))["id"].alias("l2"))
    stars = met.join(leaders, "h").select("id", F.explode(F.array_distinct(F.array("l1", "l2"))).alias("lead")).where("id <> lead").distinct()
    stars = stars.join(sets, "id").join(sets.select(F.col("id").alias("lead"), F.col("n_shingles").alias("lead_size"), F.col("bits").alias("lead_bits")), "lead")
    stars = stars.where(f"100 * least(n_shingles, lead_size) >= {percent} * greatest(n_shingles, lead_size)").withColumn("agree", agreement("bits", "lead_bits", 2 * hashes)).where(F.col("agree") >= agree)
    best = scratch.keep(stars.groupBy("id").agg(F.max_by("lead", F.struct("agree", -F.col("lead"))).alias("lead")), "best")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    salts = best.groupBy("lead").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    members = texts.join(best, "id").join(salts, "lead").select("lead", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"), "id", "text")
    heads = texts.join(salts.withColumnRenamed("lead", "id"), "id").select(F.col("id").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), "id", "text")
    pairs = heads.unionAll(members).repartition(n, "lead", "salt").sortWithinPartitions("lead", "salt", "role")
    sure = scratch.keep(pairs.mapInArrow(confirm_stars(width, percent), "a long, b long"), "sure")
    first = components(sure, scratch, "first").withColumnsRenamed({"node": "id", "root": "comp"})

    # 3. what the signatures leave open of each bucket
    placed = met.select("h", "id").join(first, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    per = placed.groupBy("h", "comp").agg(F.count("*").alias("n"))
    buckets = per.groupBy("h").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.max_by(F.struct("comp", "n"), F.struct("n", -F.col("comp"))).alias("top")).where("comps > 1")
    buckets = buckets.select("h", F.col("top.comp").alias("top"), parts(F.col("n") - F.col("top.n"), BLOCK_ROWS).alias("ni"), parts(F.col("n"), BLOCK_ROWS).alias("nj"))
    open_ = placed.join(buckets, "h").join(sets, "id")
    near = in_blocks(open_, ["h"], F.col("comp") != F.col("top"), ["comp", "n_shingles", "bits"], 2).mapInArrow(near_blocks(percent, agree), "a long, b long")
    groups = components(scratch.keep(near, "near"), scratch, "coarse").withColumnsRenamed({"node": "comp", "root": "grp"})

    # 4. the rest of each group, exactly
    left = nodes.select("id").join(first, "id", "left").withColumn("comp", F.coalesce("comp", "id")).join(groups, "comp")
    left = scratch.keep(texts.join(left.hint("shuffle_hash"), "id").withColumn("bytes", F.octet_length("text")), "left")
    per = left.groupBy("grp", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    groups = per.groupBy("grp").agg(F.sum("bytes").alias("bytes"), F.max_by(F.struct("comp", "bytes"), F.struct("n", -F.col("comp"))).alias("top"))
    groups = groups.select("grp", F.col("top.comp").alias("top"), parts(F.col("bytes") - F.col("top.bytes"), BLOCK_BYTES).alias("ni"), parts(F.col("bytes"), BLOCK_BYTES).alias("nj"))
    more = in_blocks(left.join(groups, "grp"), ["grp"], F.col("comp") != F.col("top"), ["comp", "text"], 3).mapInArrow(confirm_blocks(width, percent), "a long, b long")
    last = components(scratch.keep(more, "more"), scratch, "last").withColumnsRenamed({"node": "comp", "root": "root"})

    root = nodes.select("hi", "lo", "id").join(first, "id", "left").withColumn("comp", F.coalesce("comp", "id")).join(last, "comp", "left").select("hi", "lo", F.coalesce("root", "comp").alias("root"))
    out = sketch.select("doc_id", "n_shingles", "hi", "lo").join(root, ["hi", "lo"], "left")
    scratch.drop("met", "best", "sure", "near", "left", "more", "coarse-out")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: DuckDB's form of near_duplicates() with its default settings, by all pairs that share a shingle; for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingles
  FROM w),
n AS MATERIALIZED (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles FROM s),
x AS MATERIALIZED (SELECT doc_id, unnest(shingles) AS sh FROM s),
o AS (SELECT sh FROM x GROUP BY sh HAVING count(*) > 1),
y AS MATERIALIZED (SELECT doc_id, sh FROM x SEMI JOIN o USING (sh)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM y a JOIN y b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
h AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n u ON u.doc_id = p.a JOIN n v ON v.doc_id = p.b WHERE 100 * n_both >= 75 * (u.n_shingles + v.n_shingles - n_both)),
e AS MATERIALIZED (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r AS (SELECT doc_id AS id, doc_id AS reached FROM n UNION SELECT e.b, r.reached FROM r JOIN e ON r.id = e.a)
SELECT n.doc_id, n_shingles, min(reached) AS component_id, n.doc_id = min(reached) AS kept FROM n JOIN r ON n.doc_id = r.id GROUP BY n.doc_id, n_shingles
"""
