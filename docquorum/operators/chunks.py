"""Recorded reply chunks: lines of (request_id, seq, line) put together into reply texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquorum.functions.jsonx import member, strict_array, truthy

# The two line formats.
DATA_PREFIX = "data: "
DATA_END = "[DONE]"
DATA_TOKEN = "$[0].choices[0].delta.content"
LINES_TOKEN = "$[0].message.content"
LINES_END = "$[0].done"
WHOLE_REPLY = {
    "data": "$.choices[0].message.content",
    "lines": "$.message.content",
}
STYLES = tuple(WHOLE_REPLY)
# How many consecutive sequence numbers are joined at a time.
BLOCK = 4096


def parse_chunks(lines: DataFrame, style: str, *more: str) -> DataFrame:
    """Stateless part: (request_id, seq, token, stop) per line, and `more` columns of it.

    Works the same on a batch and on a stream. `token` is null for lines without text. A
    ``data:`` end marker carries no token; in the line format the final line's token counts.
    """
    line = F.col("line")
    if style == "data":
        payload = F.when(line.startswith(DATA_PREFIX), F.substring(line, len(DATA_PREFIX) + 1, F.length(line)))
        stop = F.coalesce(F.trim(payload) == DATA_END, F.lit(False))
        token = F.when(~stop, member(strict_array(payload), DATA_TOKEN, "string"))
    elif style == "lines":
        parsed = strict_array(line)
        stop = truthy(member(parsed, LINES_END))
        token = member(parsed, LINES_TOKEN, "string")
    else:
        raise ValueError(f"style must be one of {STYLES}")
    return lines.select("request_id", "seq", token.alias("token"), stop.alias("stop"), *more)


def _cut_and_join(items: Column, text: str) -> Column:
    """Join the texts of sorted items up to and including the first that stops."""
    first_stop = F.array_position(F.transform(items, lambda i: i["stop"]), True)
    kept = F.when(first_stop > 0, F.slice(items, F.lit(1), first_stop.cast("int"))).otherwise(items)
    return F.array_join(F.transform(kept, lambda i: i[text]), "")


def assemble_chunks(tokens: DataFrame, block: int = BLOCK) -> DataFrame:
    """One text per request from parsed chunks.

    Two levels keep a very long reply out of a single group: runs of `block` sequence
    numbers are cut and joined first, then the runs of a request. A request whose lines are
    all without text still gives an empty text. Tokens of equal seq join in text order.
    """
    item = F.struct("seq", "token", "stop")
    runs = (
        tokens.groupBy("request_id", F.floor(F.col("seq") / block).alias("run"))
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .select(
            "request_id",
            F.struct(
                F.col("run"),
                _cut_and_join(F.col("items"), "token").alias("text"),
                F.exists("items", lambda i: i["stop"]).alias("stop"),
            ).alias("part"),
        )
    )
    parts = runs.groupBy("request_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return parts.select("request_id", _cut_and_join(F.col("parts"), "text").alias("text"))


def decode_chunks(lines: DataFrame, style: str, block: int = BLOCK) -> DataFrame:
    return assemble_chunks(parse_chunks(lines, style), block)


def complete_reply(body: Column, style: str) -> Column:
    """Text of a reply that arrived in one piece."""
    return member(F.try_parse_json(body), WHOLE_REPLY[style], "string")
