"""Tables and plans written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local master, which is one machine, gets a temporary one where none
    is set; elsewhere a missing folder is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="marlstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


_watching: list[list[Scratch]] = []


@contextmanager
def cleared() -> Iterator[None]:
    """Close at the end what is opened inside; for results that have been written elsewhere by then."""
    opened: list[Scratch] = []
    _watching.append(opened)
    try:
        yield
    finally:
        _watching.remove(opened)
        for scratch in opened:
            scratch.close()


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and a lost executor loses nothing.

    ``drop`` removes single tables, ``close`` the whole folder; what a result
    still reads has to stay until the result has been used.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/marlstone-{name}-{uuid.uuid4().hex}"
        for opened in _watching:
            opened.append(self)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            self._remove(self.path(name))

    def close(self) -> None:
        """Remove all tables."""
        self._remove(self.base)
