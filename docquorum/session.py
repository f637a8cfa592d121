"""Session helpers: shared scratch folders and tables that cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of all executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="docquorum-"), "docquorum")
    shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(f"{archive}.zip")
    _shipped.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Session settings the results depend on: UTC times, and last-wins repeated JSON keys."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="docquorum-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new, empty folder name below the shared folder."""
    return f"{shared_dir(spark)}/docquorum-{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Unlike a checkpoint of an uncached table this computes it once, and a lost executor
    costs no recomputation afterwards.
    """
    folder = scratch_dir(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Scratch:
    """Tables that rounds write and the next round supersedes, all below one folder.

    `write` is `cut_lineage`; `drop` removes tables that nothing will read any more.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self._root = scratch_dir(spark, purpose)
        self._folders: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame) -> DataFrame:
        folder = f"{self._root}/{len(self._folders)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(folder)
        table = df.sparkSession.read.schema(df.schema).parquet(folder)
        self._folders[id(table)] = (table, folder)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, folder = self._folders.pop(id(table), (None, None))
            if folder is not None:
                fs, path = hadoop_path(table.sparkSession, folder)
                fs.delete(path, True)


def posix_path(path: str) -> str:
    """Mounted-folder form of a path, for connectors that use plain file calls."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        return "/" + path.lstrip("/")
    if "://" in path:
        raise ValueError(f"not a mounted folder: {path}")
    return os.path.abspath(path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) pair for metadata checks on any storage Spark can reach."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target
