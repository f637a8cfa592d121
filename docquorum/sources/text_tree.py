"""``text_tree``: one text file per row of (path, text) below a mounted folder.

Paths must stay below the folder. Files are put in place by renaming, so a retried task
only repeats itself. One file per row does not suit very large results; keep those as tables.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from docquorum.functions.jsonx import parse_field
from docquorum.functions.render import render_markdown
from docquorum.session import hadoop_path, posix_path


def safe_target(root: str, path: str) -> str:
    parts = path.split("/")
    if path.startswith("/") or ".." in parts or "" in parts or "\x00" in path:
        raise ValueError(f"path leaves the output folder: {path!r}")
    return os.path.join(root, *parts)


class _Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, rows: Iterator) -> WriterCommitMessage:
        for row in rows:
            target = safe_target(self.root, row["path"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            partial = f"{target}.{uuid.uuid4().hex}.tmp"
            with open(partial, "w", encoding="utf-8", newline="") as handle:
                handle.write(row["text"] or "")
            os.replace(partial, target)
        return WriterCommitMessage()


class TextTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_tree"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(posix_path(self.options["path"]))


def write_tree(texts: DataFrame, root: str) -> None:
    """Write (path, text) rows as files below `root`."""
    texts.sparkSession.dataSource.register(TextTree)
    rows = texts.select("path", "text")
    rows.write.format("text_tree").option("path", root).mode("append").save()


def write_markdown(records: DataFrame, output_dir: str) -> None:
    """``files/<path>.md`` for rows of (path, final_description)."""
    documents = render_markdown(records)
    write_tree(documents.withColumn("path", F.concat(F.lit("files/"), "path", F.lit(".md"))), output_dir)


def flagged_json(jobs: DataFrame) -> DataFrame:
    """(file_path, text): the history of a flagged job as JSON with seven keys, nulls kept."""
    def parsed(name: str) -> Column:
        return parse_field(F.col(name)).alias(name)

    history = F.struct(
        "file_path", "status", "retry_count",
        parsed("pass1_result"), parsed("pass2_result"), parsed("quorum_result"), "error_log",
    )
    options = {"ignoreNullFields": "false", "pretty": "true"}
    flagged = jobs.filter(F.col("status") == "flagged")
    return flagged.select("file_path", F.to_json(history, options).alias("text"))


def write_flagged(jobs: DataFrame, output_dir: str) -> None:
    """``flagged/<path>.json`` for flagged jobs."""
    path = F.concat(F.lit("flagged/"), "file_path", F.lit(".json"))
    write_tree(flagged_json(jobs).select(path.alias("path"), "text"), output_dir)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines in order, as one text file that appears when it is complete.

    Tasks write the ordered parts; the commit joins them in partition order, byte by byte and in constant memory, and
    puts the file in place by renaming, so an earlier report stays until then. Any storage Spark can write will do.
    """
    spark = lines.sparkSession
    parts = f"{path}.{uuid.uuid4().hex}.parts"
    lines.orderBy("section", "position").select(F.col("line").alias("value")).write.text(parts)
    fs, folder = hadoop_path(spark, parts)
    _, partial = hadoop_path(spark, f"{parts}.joined")
    _, target = hadoop_path(spark, path)
    copy = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    names = sorted(status.getPath().getName() for status in fs.listStatus(folder))
    out = fs.create(partial, True)
    try:
        for name in (n for n in names if n.startswith("part-")):
            source = fs.open(hadoop_path(spark, f"{parts}/{name}")[1])
            try:
                copy(source, out, 1 << 20, False)
            finally:
                source.close()
    finally:
        out.close()
    fs.delete(target, True)
    if not fs.rename(partial, target):
        raise OSError(f"could not put the report in place: {path}")
    fs.delete(folder, True)
