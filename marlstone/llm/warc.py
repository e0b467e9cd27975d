"""Deterministic sharded WARC writer, and its reader.

Records are ordered by (page_id, digest, url) and dealt into shards at exact
quantiles of their bytes: about SHARD_BYTES of payload each, at most MAX_SHARDS
of them.  The quantiles come from a sorted table of ids, digests and sizes, so
the same table gives the same shards whatever its partitions, and neither one
far id nor many rows without any fill a shard.  A task writes its shards' records
in order, each a gzip member with headers and digests made anew, and begins a
new file when the present one has reached FILE_BYTES compressed.  A file is
written under a temporary name and renamed; its manifest row (name, records,
bytes, digest) reaches the manifest only when its task has ended well, and
readers open just the files that the manifest names.  A task that runs again
writes the same bytes to the same names.

Of records with equal payloads of at least MIN_REVISIT bytes, the one with the
largest page_id is the response and the others are revisits of it.

Defined cases: a null html is an empty payload; a null url gives a record
without target URI; rows with one page_id are records of their own, and of
those with the largest page_id of a payload one, chosen by url, is the
response; rows without page_id come first and are never revisited.  Files are
written through Arrow's file systems, so the folder may be local, HDFS or an
object store.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import partitions, running
from marlstone.storage import Scratch

MIN_REVISIT = 1000
#: A shard holds several files, so that files end where their compressed size says.
SHARD_BYTES = 16 << 20
FILE_BYTES = 4 << 20
#: Shards at most: their bounds are one broadcast value, of some 100 bytes each.
MAX_SHARDS = 1 << 14
#: What a record counts beside its payload.
RECORD_BYTES = 512
DATE = "2020-01-01T00:00:00Z"
MANIFEST = "name string, first_page long, records long, bytes long, sha256 string"
_SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if re.match(r"\w+:", folder) else f"file://{folder}")


def record_id(page_id, digest: str, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_ID, f'{page_id}/{digest}/{url}')}>"


def base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, refers_url: str | None, date: str = DATE) -> bytes:
    """One WARC record; a revisit's block holds the HTTP headers only."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    clean = lambda s: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, url)}", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {clean(url)}"] if url else []), *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"] if revisit else []),
        *([f"WARC-Refers-To-Target-URI: {clean(refers_url)}"] if revisit and refers_url else []),
        f"WARC-Payload-Digest: {base32(digest)}", f"WARC-Block-Digest: {base32(hashlib.sha1(block).hexdigest())}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without time or name, so that equal records give equal bytes."""
    out = io.BytesIO()
    with gzip.GzipFile(filename="", mode="wb", fileobj=out, mtime=0, compresslevel=6) as f:
        f.write(data)
    return out.getvalue()


class ShardWriter:
    """Writes one shard's records to files that roll by compressed size."""

    def __init__(self, folder: str, shard: int, attempt: str, file_bytes: int):
        self.fs, self.root = opened(folder)
        self.shard, self.attempt, self.file_bytes = shard, attempt, file_bytes
        self.k, self.stream, self.done = 0, None, []

    def add(self, page_id, data: bytes) -> None:
        if self.stream is None:
            self.name = f"shard-{self.shard:06d}-{self.k:04d}.warc.gz"
            self.temp = f"{self.root}/.{self.name}.{self.attempt}"
            self.stream = self.fs.open_output_stream(self.temp, compression=None)
            self.first, self.records, self.bytes, self.sha = page_id, 0, 0, hashlib.sha256()
        packed = member(data)
        self.stream.write(packed)
        self.sha.update(packed)
        self.records += 1
        self.bytes += len(packed)
        if self.bytes >= self.file_bytes:
            self.roll()

    def roll(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.fs.move(self.temp, f"{self.root}/{self.name}")
            self.done.append((self.name, self.first, self.records, self.bytes, self.sha.hexdigest()))
            self.stream, self.k = None, self.k + 1


def writer(folder: str, file_bytes: int):
    """Rows sorted by (shard, page_id, digest, url, kind): kind 0 names what the pages of kind 1 after it refer to."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        attempt = f"{context.taskAttemptId()}" if context else "0"
        out, now, note = [], None, None
        for batch in batches:
            for shard, page_id, digest, url, kind, html, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.columns)):
                key = (page_id, digest, url)
                if kind == 0:
                    note = (key, refers_to, refers_url)
                    continue
                refers_to, refers_url = note[1:] if note is not None and note[0] == key else (None, None)
                if now is None or now.shard != shard:
                    if now is not None:
                        now.roll()
                        out += now.done
                    now = ShardWriter(folder, shard, attempt, file_bytes)
                payload = (html or "").encode()
                now.add(page_id, record(page_id, url, payload, digest, refers_to, refers_url))
        if now is not None:
            now.roll()
            out += now.done
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    return run


def shard_bounds(facts: DataFrame, scratch: Scratch, shard_bytes: int) -> DataFrame:
    """One row, one array: the least (page_id, digest, url) of each shard but the first.

    ``facts`` are put in order once, in ranges; sums within ranges and over the
    ranges give each record's exact place in the whole.
    """
    keys = ["page_id", "digest", "url"]
    sized = facts.select(*keys, (F.col("size") + RECORD_BYTES).alias("size"))
    placed = running(sized, scratch, "ranged", keys, {"at": F.col("size")})
    whole = facts.agg(F.sum(F.col("size") + RECORD_BYTES)).scalar()
    n = F.least(F.ceil(whole / F.lit(shard_bytes)), F.lit(MAX_SHARDS))
    shard = F.floor(F.col("at") / F.ceil(whole / n))
    firsts = placed.groupBy(shard.alias("shard")).agg(F.min(F.struct(*keys)).alias("key")).where("shard > 0")
    return firsts.agg(F.sort_array(F.collect_list("key")).alias("bounds"))


def shard_of(key: Column, bounds: Column) -> Column:
    """How many of the sorted bounds a key reaches, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(MAX_SHARDS.bit_length()))])
    reached = lambda lo, k: F.when(lo + k <= F.size(bounds), F.try_element_at(bounds, lo + k) <= key).otherwise(False)
    return F.aggregate(steps, F.lit(0), lambda lo, k: F.when(reached(lo, k), lo + k).otherwise(lo))


def plan(pages: DataFrame, scratch: Scratch, min_revisit: int, shard_bytes: int) -> DataFrame:
    """The rows of writer()."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    facts = scratch.keep(rows.select("page_id", "url", "digest", "size"), "facts")
    groups = facts.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n")).where("n > 1 and top.page_id is not null")
    groups = groups.select(F.col("digest").alias("d"), F.col("top.page_id").alias("top_id"), F.col("top.url").alias("top_url"))
    bounds = shard_bounds(facts, scratch, shard_bytes).select(F.to_json("bounds")).first()[0]
    bounds = F.from_json(F.lit(bounds), "array<struct<page_id:bigint,digest:string,url:string>>")  # a constant

    own = F.col("page_id").eqNullSafe(F.col("top_id")) & F.col("url").eqNullSafe(F.col("top_url"))
    shard = shard_of(F.struct("page_id", "digest", "url"), bounds).alias("shard")
    columns = [shard, "page_id", "digest", "url"]
    # revisits stand before their pages, so that payloads are dealt out once and joined with nothing
    notes = facts.join(groups, facts.digest == groups.d).where(~own)
    notes = notes.select(*columns, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("html"), F.col("top_id").alias("refers_to"), F.col("top_url").alias("refers_url"))
    full = rows.select(*columns, F.lit(1).alias("kind"), "html", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    return notes.distinct().unionAll(full)


def write(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives to ``folder``; gives the manifest, which is kept there too."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    rows = plan(pages, scratch, min_revisit, shard_bytes)
    rows = rows.repartitionById(partitions(spark), "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "url", "kind")
    rows.mapInArrow(writer(folder, file_bytes), MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    scratch.close()
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records(stream) -> tuple:
    """(headers, block) of each record of a stream of gzip members; one member is held at a time."""
    data, inflate, text = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                break
        text.append(inflate.decompress(data))
        data = b""
        if inflate.eof:
            data = inflate.unused_data
            whole = b"".join(text)
            head, _, rest = whole.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            yield headers, rest[: int(headers["content-length"])]
            inflate, text = zlib.decompressobj(31), []


def reader(folder: str):
    def run(batches):
        import pyarrow as pa

        fs, root = opened(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for headers, block in records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                        stated = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
                        digest = stated if headers["warc-type"] == "revisit" else hashlib.sha1(payload).hexdigest()
                        number = lambda k: int(headers[k]) if k in headers else None  # noqa: E731,B023
                        rows.append((number("x-page-id"), size, digest, headers["warc-type"], number("x-refers-to-page-id"), headers.get("warc-target-uri"), digest == stated))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "digest_ok"])

    return run


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the files that the manifest names."""
    names = manifest.select("name").repartition(partitions(manifest.sparkSession), "name")
    return names.mapInArrow(reader(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, digest_ok boolean")


#: DuckDB's form of what is read back.
SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND n >= 1000
"""
