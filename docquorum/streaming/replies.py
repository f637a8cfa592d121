"""Replies put together while their chunks still arrive, with state that ends with the reply."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docquorum.operators.chunks import parse_chunks

REPLY_DDL = "request_id bigint, text string, complete boolean"
STATE_DDL = "given boolean, body string, last bigint"


def _joined(items: list) -> str:
    """Texts of (seq, token, stop) in order, up to and including the first that stops."""
    out = []
    for _, token, stop in sorted(items, key=lambda i: (i[0], i[1] is None, i[1] or "", i[2])):
        out.append(token or "")
        if stop:
            break
    return "".join(out)


def _has_ended(items: list, first_seq: int) -> bool:
    """Whether an end marker and every line before it have arrived."""
    ends = [seq for seq, _, stop in items if stop]
    if not ends:
        return False
    end = min(ends)
    return len({seq for seq, _, _ in items if first_seq <= seq <= end}) == end - first_seq + 1


def assemble_stream(lines: DataFrame, style: str, delay: str, first_seq: int = 0) -> DataFrame:
    """(request_id, text, complete) of a stream of (request_id, seq, line, at), one row per reply.

    A reply is given out as soon as its end marker and all lines before it are there, whatever their order, and its
    chunks are forgotten; only a mark stays until the watermark, `delay` behind the newest line, has passed the reply's
    last line, so that repeated or surplus lines of the meantime change nothing. A reply without an end is given out as it
    is, not `complete`, once the watermark has passed its last line. Lines behind the watermark are dropped. A line
    of a request that was forgotten begins a new reply.
    """
    chunks = parse_chunks(lines, style, "at").withWatermark("at", delay)

    def settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        given, items, last = False, [], 0
        if state.exists:
            given, body, last = state.get
            items = json.loads(body)
        if state.hasTimedOut:
            state.remove()
            if not given:
                yield pd.DataFrame([(key[0], _joined(items), False)], columns=["request_id", "text", "complete"])
            return
        for frame in frames:
            last = max(last, int(frame["at"].max().timestamp() * 1000))
            if not given:
                items += [[int(s), t, bool(e)] for s, t, e in zip(frame["seq"], frame["token"], frame["stop"])]
        if not given and _has_ended(items, first_seq):
            yield pd.DataFrame([(key[0], _joined(items), True)], columns=["request_id", "text", "complete"])
            given, items = True, []
        state.update((given, json.dumps(items), last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)

    return chunks.groupBy("request_id").applyInPandasWithState(
        settle, REPLY_DDL, STATE_DDL, "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_replies(
    lines: DataFrame, style: str, delay: str, out_dir: str, checkpoint_dir: str, first_seq: int = 0
) -> StreamingQuery:
    """Append replies to a table as they end."""
    return (
        assemble_stream(lines, style, delay, first_seq).writeStream.format("parquet")
        .option("path", out_dir).option("checkpointLocation", checkpoint_dir)
        .outputMode("append").trigger(availableNow=True)
        .start()
    )
