"""Sources and sinks: files with their facts, JSON lines, pages, Markdown folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import routing


def files(spark: SparkSession, *globs: str, content: bool = True) -> DataFrame:
    """Files under the patterns, with name, stem and suffix; content is read only where it is used."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(globs))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = rows.withColumns({"name": name, "stem": F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "suffix": routing.suffix(F.col("path"))})
    return rows if content else rows.drop("content")


def expanded(spark: SparkSession, patterns: list[str]) -> tuple[list[str], list[str]]:
    """Paths that the patterns name, each pattern's in order, and patterns that name nothing; folders stand for what is in them."""
    found: list[str] = []
    missing: list[str] = []
    for pattern in patterns:
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        hits = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        names = sorted(s.getPath().toString() for s in hits or [])
        found += names
        missing += [] if names else [pattern]
    return list(dict.fromkeys(found)), missing


def resolved(spark: SparkSession, path: str) -> tuple[str | None, str | None]:
    """The whole path of a file, or why it is none: MS-103 where there is nothing, MS-104 for a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return None, "MS-103"
    found = system.getFileStatus(place)
    return (None, "MS-104") if found.isDirectory() else (found.getPath().toString(), None)


def texts(spark: SparkSession, *globs: str) -> DataFrame:
    """(path, text) of UTF-8 files, one row each."""
    return spark.read.text(list(globs), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, schema: str, *globs: str) -> DataFrame:
    """Objects of JSON lines; blank, torn and other lines are left out."""
    rows = spark.read.text(list(globs)).where(F.regexp_like("value", F.lit(r"^\s*\{")))
    parsed = rows.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("x"))
    return parsed.where("x._bad is null").select("x.*").drop("_bad")


def recent_sessions(events: DataFrame, n: int) -> DataFrame:
    """The newest n session names of events(session, t)."""
    return events.groupBy("session").agg(F.max("t").alias("t")).orderBy(F.desc("t"), "session").limit(n)


def output_path(path, folder: str | None = None):
    """Where a file's Markdown goes: beside it, or into the folder."""
    stem = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    return F.concat(stem if folder is None else F.concat(F.lit(f"{folder.rstrip('/')}/"), F.regexp_extract(stem, r"([^/]+)$", 1)), F.lit(".md"))


def distinct_names(rows: DataFrame, column: str = "stem") -> DataFrame:
    """Adds out_name: names that come again get -2, -3 and so on, in order of path."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(column).orderBy("path"))
    return rows.withColumn("out_name", F.when(k == 1, F.col(column)).otherwise(F.concat_ws("-", column, k.cast("string"))))


def put_file(folder: str, path: str, data: bytes) -> None:
    """Write a file under a temporary name and rename it; the folder may be of any file system that Arrow opens."""
    import re
    import uuid

    from pyarrow import fs

    if ".." in path.split("/"):
        raise ValueError(f"a name leads out of the folder: {path}")
    system, root = fs.FileSystem.from_uri(folder if re.match(r"\w+:", folder) else f"file://{folder}")
    full = f"{root}/{path}"
    system.create_dir(full.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(temp := f"{full}.{uuid.uuid4().hex}") as out:
        out.write(data)
    system.move(temp, full)


def write_files(rows: DataFrame, folder: str, name: str = "file", content: str = "content") -> None:
    """Each row as a file of its own, written by the executors."""

    def run(batches):
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                put_file(folder, path, (text.as_py() or "").encode())
            yield batch

    rows.select(name, content).mapInArrow(run, f"{name} string, {content} string").write.format("noop").mode("overwrite").save()
