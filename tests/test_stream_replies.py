"""Replies assembled on an open stream: as in batch, with state that ends with the reply."""

import json

from pyspark.sql import functions as F

from docquorum.operators.chunks import decode_chunks
from docquorum.streaming.replies import REPLY_DDL, stream_replies

DDL = "request_id bigint, seq bigint, line string, at timestamp"


def data(token):
    return "data: " + json.dumps({"choices": [{"delta": {"content": token}}]})


class Feed:
    """A folder of files that a stream reads one by one."""

    def __init__(self, spark, root):
        self.spark, self.root, self.last = spark, root, None

    def send(self, *rows):
        """Lines of (request, seq, line, minute) as one more file, then run the stream over it."""
        frame = self.spark.createDataFrame([(r, s, x, (m + 1_000_000) * 60) for r, s, x, m in rows], "r bigint, s bigint, x string, m bigint")
        frame.select(F.col("r").alias("request_id"), F.col("s").alias("seq"), F.col("x").alias("line"),
                     F.timestamp_seconds("m").alias("at")).coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        query = stream_replies(
            self.spark.readStream.schema(DDL).parquet(f"{self.root}/in"), "data", "10 minutes",
            f"{self.root}/out", f"{self.root}/progress")
        query.awaitTermination()
        self.last = query.lastProgress or self.last

    def replies(self):
        rows = self.spark.read.schema(REPLY_DDL).parquet(f"{self.root}/out").collect()
        return sorted((r["request_id"], r["text"], r["complete"]) for r in rows)

    def state_rows(self):
        return self.last["stateOperators"][0]["numRowsTotal"]


def test_replies_end_with_their_marker_and_state_shrinks(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    feed.send((1, 0, data("a"), 0), (1, 1, data("b"), 0), (2, 0, data("x"), 0), (3, 0, "data: [DONE]", 0))
    assert feed.replies() == [(3, "", True)]
    # The marker comes before the line that it follows; the reply waits for it. Surplus lines change nothing.
    feed.send((1, 3, "data: [DONE]", 1), (1, 9, data("surplus"), 1))
    assert feed.replies() == [(3, "", True)]
    feed.send((1, 2, data("c"), 2), (1, 2, data("c"), 2), (3, 0, "data: [DONE]", 2))
    assert feed.replies() == [(1, "abcc", True), (3, "", True)]
    feed.send((1, 1, data("again"), 3))
    assert feed.replies() == [(1, "abcc", True), (3, "", True)]
    # An hour later the reply without an end goes out as it is, and of all three nothing stays.
    feed.send((4, 0, data("new"), 60))
    feed.send((4, 1, data("er"), 61))
    assert feed.replies() == [(1, "abcc", True), (2, "x", False), (3, "", True)]
    assert feed.state_rows() == 1
    # Lines behind the watermark are dropped.
    feed.send((2, 1, data("late"), 5))
    feed.send((4, 2, "data: [DONE]", 62))
    assert feed.replies() == [(1, "abcc", True), (2, "x", False), (3, "", True), (4, "newer", True)]


def test_stream_equals_batch(spark, tmp_path):
    feed, rows = Feed(spark, str(tmp_path)), []
    for request in range(30):
        length = 3 + request % 5
        lines = [data(f"{request}.{i} ") for i in range(length)] + ["data: [DONE]"] * (request % 3 > 0)
        rows += [(request, i, line, 0) for i, line in enumerate(lines)]
    for part in range(4):
        feed.send(*[r for n, r in enumerate(rows) if n % 4 == part])
    feed.send((99, 0, "data: [DONE]", 100))
    feed.send((98, 0, "data: [DONE]", 101))
    table = spark.createDataFrame([r[:3] for r in rows], "request_id bigint, seq bigint, line string")
    batch = sorted((r["request_id"], r["text"]) for r in decode_chunks(table, "data").collect())
    assert [(r, text) for r, text, _ in feed.replies() if r < 98] == batch
    assert {r for r, _, complete in feed.replies() if not complete} == set(range(0, 30, 3))
