"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder which driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset (tests, local mode) a folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="boxweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's (file system, path) of a path, on the driver."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


@contextlib.contextmanager
def _cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries inside remove their shuffle files when they end, not when the driver's
    garbage collection finds them: what they wrote is read from the shared folder."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and
    nothing is lost with an executor.  Shuffle files of the write go with its end,
    the table when the application ends, or with ``discard``."""
    spark = df.sparkSession
    path = own_path(spark, name)
    with _cleaned_shuffles(spark):
        df.write.mode("overwrite").option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def shares(table: DataFrame, n: int) -> list[DataFrame]:
    """A table of ``stored`` as at most ``n`` tables of whole files, all rows in one each."""
    files = sorted(table.inputFiles())
    read = table.sparkSession.read.schema(table.schema)
    return [read.parquet(*files[i::n]) for i in range(min(n, len(files)))] or [table]


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` which nothing reads any more: all that was made
    of them is stored itself."""
    for t in tables:
        remove(t.sparkSession, t._stored_at)
