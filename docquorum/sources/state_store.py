"""Job table and metadata kept as plain Parquet folders.

Every commit is one numbered folder: a full snapshot, or a delta with only the changed rows.
A folder without ``_SUCCESS`` is an unfinished commit and is never read. One driver writes
at a time. Job rows lie in buckets by their path's hash, so that a reader who knows which
paths it needs reads only their buckets.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquorum.operators.state import JOB_DDL, METADATA_DDL, upsert_metadata
from docquorum.session import hadoop_path


COMMIT_NAME = re.compile(r"(full|delta)-\d{8}")
# Fixed value: the number of buckets is part of the stored form.
BUCKETS = 16


def bucket_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


class StateStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _names(self, table: str) -> list[str]:
        """Folder names of all commits, finished or not, ascending by number."""
        fs, folder = hadoop_path(self.spark, f"{self.root}/{table}")
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(filter(COMMIT_NAME.fullmatch, names), key=_number)

    def _finished(self, table: str, name: str) -> bool:
        fs, done = hadoop_path(self.spark, f"{self.root}/{table}/{name}/_SUCCESS")
        return fs.exists(done)

    def _current(self, table: str) -> list[str]:
        """The newest finished snapshot and the finished deltas after it; older commits are not looked at."""
        current = []
        for name in reversed(self._names(table)):
            if self._finished(table, name):
                current.append(name)
                if name.startswith("full-"):
                    break
        return current[::-1]

    def _write(self, table: str, rows: DataFrame, kind: str) -> int:
        names = self._names(table)
        number = _number(names[-1]) + 1 if names else 1
        writer = rows.write.mode("errorifexists")
        if "bucket" in rows.columns:
            writer = rows.hint("rebalance", "bucket").write.mode("errorifexists").partitionBy("bucket")
        writer.parquet(f"{self.root}/{table}/{kind}-{number:08d}")
        return number

    def _drop_superseded(self, table: str) -> None:
        """Remove what came before the last snapshot but one: a reader may still hold that one."""
        names = self._names(table)
        snapshots = [name for name in names if name.startswith("full-") and self._finished(table, name)]
        for name in names[:names.index(snapshots[-2])] if len(snapshots) > 1 else []:
            fs, folder = hadoop_path(self.spark, f"{self.root}/{table}/{name}")
            fs.delete(folder, True)

    def _read(self, table: str, ddl: str, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], ddl)
        folders = [f"{self.root}/{table}/{name}" for name in names]
        return self.spark.read.schema(ddl).parquet(*folders)

    def _read_jobs(self, names: list[str], buckets: Iterable[int] | None) -> DataFrame:
        """Job rows with their commit, from the folders of the wanted buckets only.

        Commits of before there were buckets are read whole.
        """
        wanted = None if buckets is None else {f"bucket={bucket}" for bucket in buckets}
        paths = []
        for name in names:
            folder = f"{self.root}/jobs/{name}"
            fs, path = hadoop_path(self.spark, folder)
            inside = {status.getPath().getName() for status in fs.listStatus(path)} if wanted is not None else set()
            if wanted is None or any(n.endswith(".parquet") for n in inside):
                paths.append(folder)
            else:
                paths += [f"{folder}/{bucket}" for bucket in sorted(wanted & inside)]
        if not paths:
            return self.spark.createDataFrame([], f"{JOB_DDL}, commit bigint")
        rows = self.spark.read.schema(JOB_DDL).option("recursiveFileLookup", True).parquet(*paths)
        # The commit number is part of the folder name.
        number = F.regexp_extract("_metadata.file_path", r"/(?:full|delta)-(\d+)/", 1).cast("bigint")
        numbered = rows.withColumn("commit", number)
        return numbered if buckets is None else numbered.filter(bucket_of(F.col("file_path")).isin(*buckets))

    def exists(self) -> bool:
        return bool(self._current("jobs"))

    def version(self) -> int:
        return max(map(_number, self._current("jobs")), default=0)

    def jobs(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """Current job table, or only some buckets: the last snapshot, overlaid with the newest delta row per path.

        Only delta rows are folded; the snapshot passes through one anti-join on its key.
        """
        names = self._current("jobs")
        bases = [name for name in names if name.startswith("full-")]
        base = self._read_jobs(bases, buckets).drop("commit")
        deltas = [name for name in names if name not in bases]
        if not deltas:
            return base
        # One scan over all deltas.
        stacked = self._read_jobs(deltas, buckets)
        columns = [c for c in stacked.columns if c not in ("file_path", "commit")]
        newest = stacked.groupBy("file_path").agg(F.max(F.struct("commit", *columns)).alias("last"))
        changed = newest.select("file_path", *[f"last.{c}" for c in columns])
        if not bases:
            return changed
        return base.join(changed.select("file_path"), "file_path", "left_anti").unionByName(changed)

    def commit(self, jobs: DataFrame) -> int:
        """Write a full snapshot; columns the caller does not have are null."""
        return self._write("jobs", _bucketed(_completed(jobs, JOB_DDL)), "full")

    def append(self, changed: DataFrame) -> int:
        """Write only added or changed rows; columns the caller does not have are null."""
        return self._write("jobs", _bucketed(_completed(changed, JOB_DDL)), "delta")

    def compact(self) -> int:
        """Fold all deltas, of jobs and of metadata, into new snapshots, and drop what these supersede."""
        number = self.commit(self.jobs())
        if self._names("metadata"):
            self._write("metadata", _completed(self.metadata(), METADATA_DDL), "full")
        for table in ("jobs", "metadata"):
            self._drop_superseded(table)
        return number

    def metadata(self) -> DataFrame:
        return upsert_metadata(self._read("metadata", METADATA_DDL, self._current("metadata")))

    def set_metadata(self, changes: DataFrame) -> int:
        return self._write("metadata", _completed(changes, METADATA_DDL), "delta")


def _number(name: str) -> int:
    return int(name.split("-")[1])


def _bucketed(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("bucket", bucket_of(F.col("file_path")))


def _fields(ddl: str) -> list[tuple[str, str]]:
    return [tuple(field.strip().split(" ")) for field in ddl.split(",")]


def _completed(rows: DataFrame, ddl: str) -> DataFrame:
    """The rows with exactly the stored columns, so that tables of before a column was added can be stored."""
    return rows.select(*[
        (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name) for name, kind in _fields(ddl)
    ])
