"""Engines that the caller brings: anything that reads images, pages, sound or PDF comes in as a callable.

A callable runs on the executors, once a row, in one Arrow pass; what it raises
becomes the row's error and never fails the task.  Bytes are handed over one row
at a time.  A task that runs again calls again, so callables should be
repeatable.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from marlstone.functions import text as t
from marlstone.operators import routing

# --- fixed values: texts for empty results, and the keys of a layout server's reply ----------
NO_TEXT = "_(No text detected in image.)_"
REPLY_KEYS = ("md_content", "markdown", "md", "content")


def called(rows: DataFrame, call: Callable[..., Any], arguments: Sequence[str], name: str = "result", error: str = "error", binary: bool = False) -> DataFrame:
    """Adds the text, or bytes, that ``call`` gives for the named columns of each row, and why it gave nothing; the argument columns go."""
    kept = [c for c in rows.columns if c not in arguments]
    rows = rows.select(*kept, *arguments)
    schema = StructType([*[rows.schema[c] for c in kept], StructField(name, BinaryType() if binary else StringType()), StructField(error, StringType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            results: list[Any] = []
            errors: list[str | None] = []
            given = [batch.column(len(kept) + k) for k in range(len(arguments))]
            for i in range(batch.num_rows):
                try:
                    results.append(call(*(c[i].as_py() for c in given)))
                    errors.append(None)
                except Exception as e:  # the row's failure, not the task's
                    results.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(results, pa.binary() if binary else pa.string()), pa.array(errors, pa.string())], names=[*kept, name, error])

    return rows.mapInArrow(run, schema)


def downloaded(urls: DataFrame, fetch: Callable[[str], bytes]) -> DataFrame:
    """(url, suffix, content, error_code) of urls(url): MS-131 for what may not be fetched or is too large, MS-130 where fetching failed."""
    rows = urls.select("url", routing.url_suffix(F.col("url")).alias("suffix"), routing.url_guard(F.col("url"), F.lit(0)).alias("barred"))
    got = called(rows.where("barred is null").withColumn("address", F.col("url")), fetch, ["address"], "content", binary=True)
    got = got.withColumn("error_code", F.when(F.col("error").isNotNull() | F.col("content").isNull(), "MS-130").when(F.octet_length("content") > routing.URL_BYTES, "MS-131"))
    got = got.select("url", "suffix", F.when(F.col("error_code").isNull(), F.col("content")).alias("content"), "error_code")
    return got.unionByName(rows.where("barred is not null").select("url", "suffix", F.lit(None).cast("binary").alias("content"), F.col("barred").alias("error_code")))


def recognized_images(images: DataFrame, recognize: Callable[[bytes], str | None]) -> DataFrame:
    """Markdown of images(path, content): a heading with the file's name and the text in it; null with an error where recognition failed."""
    out = called(images, recognize, ["content"], "body")
    body = t.strip(F.coalesce("body", F.lit("")))
    text = F.concat(F.lit("# OCR: "), F.regexp_extract("path", r"([^/\\]+)$", 1), F.lit("\n\n"), F.when(body == "", NO_TEXT).otherwise(body), F.lit("\n"))
    return out.withColumn("markdown", F.when(F.col("error").isNull(), text)).drop("body")


def recognized_pages(pages: DataFrame, recognize: Callable[[bytes], str | None]) -> DataFrame:
    """(doc_id, page, text, error) of drawn pages(doc_id, page, image), as layout.extract() takes them."""
    out = called(pages.select("doc_id", "page", "image"), recognize, ["image"], "text")
    return out.select("doc_id", "page", t.strip(F.coalesce("text", F.lit(""))).alias("text"), "error")


def reply_markdown(reply: Column) -> Column:
    """Markdown in a layout server's reply: the first of its keys with text; a reply that is no JSON is the text itself."""
    parsed = F.try_parse_json(reply)
    keys = [F.nullif(F.get_json_object(reply, f"$.{k}"), F.lit("")) for k in REPLY_KEYS]
    found = F.coalesce(*[F.when(t.strip(k) != "", k) for k in keys])
    return F.when(parsed.isNull(), F.nullif(t.strip(reply), F.lit(""))).when(F.startswith(F.ltrim(reply), F.lit("{")), found)


def layout_server(files: DataFrame, post: Callable[[str, bytes], str | None]) -> DataFrame:
    """Adds markdown to files(path, content) from a server that ``post`` sends them to; null where it failed or gave nothing."""
    out = called(files.withColumn("name", F.regexp_extract("path", r"([^/\\]+)$", 1)), post, ["name", "content"], "reply")
    return out.withColumn("markdown", reply_markdown(F.col("reply"))).drop("reply")


def transcribed(files: DataFrame, transcribe: Callable[[bytes], dict[str, Any] | None]) -> DataFrame:
    """(path, language, probability, engine, segments, error) of files(path, content).

    ``transcribe`` gives {language, probability, engine, segments: [(start, end, text)]}.
    """
    import json

    def one(content: bytes) -> str | None:
        found = transcribe(content)
        return None if found is None else json.dumps({**found, "segments": [{"start": a, "end": b, "text": x} for a, b, x in found["segments"]]})

    out = called(files.select("path", "content"), one, ["content"], "reply")
    kind = "language string, probability double, engine string, segments array<struct<start:double,end:double,text:string>>"
    return out.withColumn("x", F.from_json("reply", kind)).select("path", "x.*", "error")


def read_glyphs(files: DataFrame, read: Callable[[bytes], list[dict[str, Any]]]) -> DataFrame:
    """The glyph table of files(doc_id, content); ``read`` gives a dict a glyph, with the columns that layout names.

    Characters beyond the first plane may come as two halves; these are one glyph.
    """
    names = ("page", "idx", "obj", "ch", "x0", "y0", "x1", "y1", "quad", "mono", "space_before", "break_before")
    schema = "doc_id long, page int, idx int, obj int, ch string, x0 double, y0 double, x1 double, y1 double, quad int, mono boolean, space_before boolean, break_before boolean"

    def run(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), *[pa.float64()] * 4, pa.int32(), *[pa.bool_()] * 3]
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = folded(read(content.as_py()))
                columns = [[doc] * len(rows), *([r.get(k) for r in rows] for k in names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, types)], names=["doc_id", *names])

    return files.select(F.col("doc_id").cast("long"), "content").mapInArrow(run, schema)


def folded(rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Glyphs with halves of a character put together; generated blanks and breaks become marks on what follows."""
    out: list[dict[str, Any]] = []
    space = line = False
    for r in rows:
        ch = r["ch"]
        if ch in (" ", "\t", "\n", "\r"):
            space, line = space or ch in " \t", line or ch in "\n\r"
            continue
        last = out[-1] if out else None
        if last is not None and "\udc00" <= ch <= "\udfff" and "\ud800" <= last["ch"][-1] <= "\udbff":
            last["ch"] = (last["ch"] + ch).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            continue
        out.append({**r, "space_before": bool(r.get("space_before")) or space, "break_before": bool(r.get("break_before")) or line})
        space = line = False
    return [{**r, "ch": r["ch"].encode("utf-8", "replace").decode()} for r in out]


# --- stored images -----------------------------------------------------------------------------
PLAIN_SPACES, PROFILE_SPACE, PROFILE_BITS = ("DeviceGray", "DeviceRGB", "CalGray", "CalRGB"), "ICCBased", (8, 24)


def is_passthrough(filters: Column, space: Column, bits: Column) -> Column:
    """Whether a stored image can be written as it is: a plain JPEG whose colours every viewer shows rightly."""
    jpeg = F.coalesce(filters == F.array(F.lit("DCTDecode")), F.lit(False))
    return jpeg & F.coalesce(space.isin(*PLAIN_SPACES) | (space == PROFILE_SPACE) & bits.isin(*PROFILE_BITS), F.lit(False))


def page_box(box: Column, forms: Column) -> Column:
    """A box (x0, y0, x1, y1) in page space, through the matrices (a, b, c, d, e, f) of the forms around it, the innermost first."""

    def turned(m: Column, r: Column) -> Column:
        x = lambda i, j: m[0] * r[i] + m[2] * r[j] + m[4]
        y = lambda i, j: m[1] * r[i] + m[3] * r[j] + m[5]
        xs, ys = [[f(i, j) for i in (0, 2) for j in (1, 3)] for f in (x, y)]
        return F.array(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))

    start = F.transform(box, lambda v: v.cast("double"))
    out = F.aggregate(F.coalesce(forms, F.array().cast("array<array<double>>")), start, lambda acc, m: turned(m, acc))
    return F.array(F.least(out[0], out[2]), F.least(out[1], out[3]), F.greatest(out[0], out[2]), F.greatest(out[1], out[3]))


def saved_images(images: DataFrame, folder: str, encode: Callable[[bytes], tuple[str, bytes]]) -> DataFrame:
    """(path, file, error): images(path, content, passthrough) written to the folder; what can't be written as it is goes through ``encode``, which gives a suffix and bytes."""
    from marlstone.sources.readers import put_file

    def one(path: str, content: bytes, passthrough: bool) -> str:
        suffix, data = (".jpg", content) if passthrough else encode(content)
        put_file(folder, f"{path}{suffix}", data)
        return f"{path}{suffix}"

    rows = images.select("path", F.col("path").alias("stem"), "content", F.coalesce("passthrough", F.lit(False)).alias("passthrough"))
    return called(rows, one, ["stem", "content", "passthrough"], "file")
