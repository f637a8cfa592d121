"""Files over a prompt bound: cut into parts, asked part by part, their replies merged into one per file.

A request and its log rows carry `chunk_no` and `n_chunks`; a file within the bound is part 0 of 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from docquorum.functions.prompts import (
    CHARS_PER_TOKEN, PART_LABEL, analysis_user, estimated_tokens, with_analysis_prompt,
)
from docquorum.operators.graph import merge_chunk_records
from docquorum.operators.quorum import checked_replies, stage_reply

# Characters kept free for the label that numbers a part.
LABEL_ROOM = 40
NO_ROOM = "prompt without its text leaves no room under the bound of %d tokens"
OVER_BOUND = "prompt of %d tokens is over the bound of %d"


def cut_at_lines(text: str, most: int) -> list[str]:
    """Parts of at most `most` characters that together are the text, each as long as line ends allow.

    A line longer than a part is cut within.
    """
    parts, at = [], 0
    while len(text) - at > most:
        line_end = text.rfind("\n", at, at + most) + 1
        end = line_end if line_end > at else at + most
        parts.append(text[at:end])
        at = end
    return [*parts, text[at:]]


@F.pandas_udf(ArrayType(StringType()))
def _parts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, rooms in batches:
        yield pd.Series(
            [None if t is None else cut_at_lines(t, int(r)) for t, r in zip(texts, rooms)], dtype=object
        )


def bounded_requests(files: DataFrame, max_tokens: int) -> DataFrame:
    """Analysis prompts of (path, text) rows, none above `max_tokens`: a longer file becomes several rows.

    The language is that of the whole file. Only texts above the bound go through Python. A file that cannot be
    asked says why in `error`; one that came with an error keeps it.
    """
    most = CHARS_PER_TOKEN * max_tokens
    text = F.coalesce("text", F.lit(""))
    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    framed = with_analysis_prompt(files).drop("user_prompt").withColumns({
        "frame": F.length("system_prompt") + F.length(analysis_user(F.col("path"), F.lit(""))), "error": error,
    })
    is_long = (F.col("frame") + F.length(text) > most) & F.col("error").isNull()
    room = F.lit(most - LABEL_ROOM) - F.col("frame")
    marked = framed.withColumns({"is_long": is_long, "room": room}).withColumn(
        "error", F.when(F.col("is_long") & (room < 1), F.format_string(NO_ROOM, F.lit(max_tokens))).otherwise(F.col("error"))
    )
    cut = F.col("is_long") & F.col("error").isNull()
    pieces = marked.withColumn("parts", _parts(F.when(cut, text), F.when(cut, F.col("room"))))
    each = pieces.withColumn("n_chunks", F.coalesce(F.size("parts"), F.lit(1))).select(
        "*", F.posexplode(F.coalesce("parts", F.array("text"))).alias("chunk_no", "piece")
    )
    label = F.when(F.col("n_chunks") > 1, F.format_string(PART_LABEL, F.col("chunk_no") + 1, F.col("n_chunks")))
    named = F.concat(F.col("path"), F.coalesce(label, F.lit("")))
    asked = each.withColumn("user_prompt", F.when(F.col("error").isNull(), analysis_user(named, F.col("piece"))))
    return asked.drop("frame", "is_long", "room", "parts", "piece", "text")


def refuse_over_bound(requests: DataFrame, max_tokens: int) -> DataFrame:
    """Give requests above the bound an `error`, which keeps them from being sent."""
    tokens = estimated_tokens(F.col("system_prompt"), F.col("user_prompt"))
    over = F.when(tokens > max_tokens, F.format_string(OVER_BOUND, tokens, F.lit(max_tokens)))
    return requests.withColumn("error", over)


def is_part() -> Column:
    return F.coalesce(F.col("n_chunks"), F.lit(1)) > 1


def merge_part_replies(log: DataFrame, max_retries: int) -> DataFrame:
    """A log of whole files: each stage's replies about parts become one reply about the file.

    When every part has a usable reply, that is their merged record; otherwise it is the first part's that has none.
    A stage of which parts are not answered yet has no row. Rows about whole files pass through.
    """
    columns = ("path", "attempt", "stage", "call_no", "raw")
    whole = log.filter(~is_part()).select(*columns)
    keys = ("path", "attempt", "stage", "n_chunks")
    best = checked_replies(log.filter(is_part()), max_retries, "n_chunks", "chunk_no").groupBy(*keys, "chunk_no").agg(
        stage_reply().alias("reply")
    )
    broken = F.min(F.when(~F.col("reply.usable"), F.struct("chunk_no", "reply.call_no", "reply.body")))
    stages = best.groupBy(*keys).agg(F.count(F.lit(1)).alias("answered"), broken.alias("broken"))
    failed = stages.filter("broken IS NOT NULL AND answered = n_chunks").select(
        "path", "attempt", "stage", "broken.call_no", F.col("broken.body").alias("raw")
    )
    usable = stages.filter("broken IS NULL AND answered = n_chunks").select(*keys)
    records = best.join(usable, list(keys), "left_semi").select(*keys, "chunk_no", F.col("reply.body").alias("result"))
    merged = merge_chunk_records(records, *keys)
    fields = [c for c in merged.columns if c not in keys]
    described = merged.select("path", "attempt", "stage", F.lit(1).alias("call_no"), F.to_json(F.struct(*fields)).alias("raw"))
    return whole.unionByName(failed).unionByName(described)
