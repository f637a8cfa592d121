"""A file tree on a mounted folder as rows of (path, size, content).

Hidden names and dotfiles are included, links to directories are not followed. A directory without read permission is
one row without a size, its path ending in a slash.

Folders are rows: each job lists one level of the tree, every folder once, in the task it was dealt to, and its
folders are the rows of the next job. Files of all levels are then dealt out anew to be read, so that neither a deep
subtree nor a wide folder holds up a single task. A folder's own listing cannot be split; it streams.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquorum.functions.paths import decode_text
from docquorum.session import Scratch, posix_path

HEAD_BYTES = 8192
# Rows and bytes per Arrow batch of contents, rows per batch of a listing.
BATCH_ROWS = 256
BATCH_BYTES = 32 << 20
LISTED_ROWS = 10_000
FOLDER, FILE, UNREADABLE = "folder", "file", "unreadable"
CONTENTS = ("none", "head", "full")


def _entries(root: str, folder: str, prune: frozenset[str]) -> Iterator[tuple[str, str]]:
    """(path, kind) of what stands in one folder, as it is listed; paths are relative to the root.

    A folder that may not be read stands for itself, with a slash at its end. One that went away since its parent
    was listed is empty. Any other fault, such as one of a network mount, is raised: its files must not look deleted.
    """
    before = f"{folder}/" if folder else ""
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            for entry in found:
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in prune:
                        yield before + entry.name, FOLDER
                elif not entry.is_dir():
                    yield before + entry.name, FILE
    except PermissionError:
        yield before, UNREADABLE
    except FileNotFoundError:
        return


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(value) for value in row if isinstance(value, bytes))
        if len(held) >= most or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held), types)], names=names)


def list_tree(spark: SparkSession, path: str, prune: frozenset[str] = frozenset(), tasks: int | None = None) -> DataFrame:
    """(path, kind) of all files and unreadable folders; one job per level of the tree."""
    root = posix_path(path)
    os.scandir(root).close()  # a root that cannot be read is an error, not an empty tree
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders = (folder for batch in batches for folder in batch.column("path").to_pylist())
        found = (entry for folder in folders for entry in _entries(root, folder, prune))
        yield from _batches(found, ["path", "kind"], [pa.string(), pa.string()], LISTED_ROWS)

    scratch = Scratch(spark, "tree")
    folders, waiting, levels = spark.createDataFrame([("",)], "path string"), 1, []
    while waiting:
        level = scratch.write(
            folders.repartition(min(tasks, waiting), "path").mapInArrow(listed, "path string, kind string")
        )
        levels.append(level)
        folders = level.filter(F.col("kind") == FOLDER).select("path")
        waiting = folders.count()
    return reduce(DataFrame.unionByName, levels).filter(F.col("kind") != FOLDER)


def _size(path: str) -> int | None:
    try:
        return os.stat(path).st_size
    except OSError:
        return None


def _content(path: str, mode: str) -> bytes | None:
    if mode == "none":
        return None
    try:
        with open(path, "rb") as handle:
            return handle.read(HEAD_BYTES if mode == "head" else -1)
    except OSError:
        return None


def read_tree(
    spark: SparkSession, path: str, withContent: str = "full", pruneDirs: str = "", targetPartitions: int | str | None = None,
) -> DataFrame:
    """(path, size, content) of a file tree, listed now and read when used.

    `withContent` is ``none``, ``head`` for the sniffed bytes, or ``full``; `pruneDirs` is a comma-separated list of
    directory names never entered; `targetPartitions` the number of tasks.
    """
    if withContent not in CONTENTS:
        raise ValueError(f"withContent must be one of {CONTENTS}")
    root = posix_path(path)
    tasks = int(targetPartitions or 4 * spark.sparkContext.defaultParallelism)
    prune = frozenset(name for name in pruneDirs.split(",") if name)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name, kind in zip(batch.column("path").to_pylist(), batch.column("kind").to_pylist()):
                    if kind == UNREADABLE:
                        yield name, None, b""
                    else:
                        full = os.path.join(root, name)
                        content = _content(full, withContent)
                        yield name, _size(full), content

        yield from _batches(rows(), ["path", "size", "content"], [pa.string(), pa.int64(), pa.binary()], BATCH_ROWS)

    spread = list_tree(spark, path, prune, tasks).repartition(tasks, "path")
    return spread.mapInArrow(read, "path string, size bigint, content binary")


def root_entries(spark: SparkSession, root: str, names: set[str]) -> DataFrame:
    """The given names that stand at the root, as a path column; reads one directory."""
    with os.scandir(posix_path(root)) as found:
        present = [(entry.name,) for entry in found if entry.name in names]
    return spark.createDataFrame(present, "path string")


def read_texts(paths: DataFrame, root: str) -> DataFrame:
    """(path, text, error) for the given relative paths; a failed read has an error instead.

    Reads only what is asked for, spread over all tasks by path.
    """
    folder = posix_path(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path in batch.column("path").to_pylist():
                    try:
                        with open(os.path.join(folder, path), "rb") as handle:
                            yield path, handle.read(), None
                    except OSError as failure:
                        yield path, None, str(failure)

        yield from _batches(rows(), ["path", "content", "error"], [pa.string(), pa.binary(), pa.string()], BATCH_ROWS)

    tasks = 4 * paths.sparkSession.sparkContext.defaultParallelism
    spread = paths.select("path").repartition(tasks, "path")
    found = spread.mapInArrow(read, "path string, content binary, error string")
    return found.select("path", decode_text(F.col("content")).alias("text"), "error")
