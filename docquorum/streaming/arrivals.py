"""Files and reply chunks that arrive while the job runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquorum.operators.chunks import assemble_chunks, parse_chunks
from docquorum.operators.state import jobs_to_add
from docquorum.sources.state_store import StateStore, bucket_of

TOKEN_DDL = "request_id bigint, seq bigint, token string, stop boolean"


def track_arrivals(
    paths: DataFrame, store: StateStore, checkpoint_dir: str, compact_every: int = 100
) -> StreamingQuery:
    """Add each batch of arriving paths to the job table, as a delta of the new rows.

    A batch reads only the buckets of the job table that its paths fall into. Inserting only absent paths makes a
    repeated batch harmless. Every `compact_every` batches the deltas are folded into a snapshot, and folders it
    supersedes are removed.
    """
    def add(batch: DataFrame, number: int) -> None:
        arrived = batch.select(F.col(batch.columns[0]).alias("file_path")).distinct()
        arrived.persist()  # a batch may not be read twice from every source
        touched = [row["bucket"] for row in arrived.select(bucket_of(F.col("file_path")).alias("bucket")).distinct().collect()]
        if touched:
            store.append(jobs_to_add(store.jobs(touched), arrived))
        arrived.unpersist()
        if number and number % compact_every == 0:
            store.compact()

    return (
        paths.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


def stream_chunks(lines: DataFrame, style: str, out_dir: str, checkpoint_dir: str) -> StreamingQuery:
    """Append parsed chunks to a table. Parsing needs no state, so none can grow."""
    return (
        parse_chunks(lines, style).writeStream.format("parquet")
        .option("path", out_dir).option("checkpointLocation", checkpoint_dir)
        .outputMode("append").trigger(availableNow=True)
        .start()
    )


def streamed_replies(spark, out_dir: str) -> DataFrame:
    """Reply texts of all chunks appended so far."""
    return assemble_chunks(spark.read.schema(TOKEN_DDL).parquet(out_dir))
