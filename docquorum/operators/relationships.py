"""Module batches under a token bound, prompts about how files work together, and the tree of prompts above them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquorum.functions.jsonx import extract_json, member, store_json
from docquorum.functions.prompts import CHARS_PER_TOKEN, estimated_tokens
from docquorum.operators.annotate import LOST, REPLY, ChatFn, ResponseLog
from docquorum.operators.graph import module_of, ordered_position
from docquorum.session import cut_lineage

# Default bounds of a batch: files, and estimated tokens of what is sent.
BATCH_FILES = 50
BATCH_TOKENS = 100_000
# Tokens kept free for the head of a prompt.
HEAD_TOKENS = 128
# Rows one task packs at a time, and how many such blocks one task strings together.
BLOCK_ROWS = 10_000
BLOCKS_TOGETHER = 1_000


# -- packing --------------------------------------------------------------------------------

def _whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows sorted by their keys in frames of whole groups, with the position each group begins at."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        new = np.zeros(len(frame), bool)
        for key in keys:
            values = frame[key].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        begins = np.r_[0, np.flatnonzero(new)]
        if len(begins) > 1:
            yield frame.iloc[:begins[-1]], begins[:-1]
        held = frame.iloc[begins[-1]:].reset_index(drop=True) if len(frame) else None
    if held is not None:
        yield held, np.zeros(1, np.int64)


def next_starts(tokens: np.ndarray, begins: np.ndarray, files: int, most: int) -> np.ndarray:
    """Per row where the batch that starts there ends: within its group, `files` rows or `most` tokens, one row at least."""
    count = len(tokens)
    ends = np.repeat(np.r_[begins[1:], count], np.diff(np.r_[begins, count]))
    upto = np.cumsum(tokens)
    row = np.arange(count)
    full = np.searchsorted(upto, upto - tokens + most, side="right")
    return np.minimum(np.maximum(np.minimum(full, row + files), row + 1), ends)


def _blocks(rows: DataFrame, group: str, files: int, block_rows: int) -> DataFrame:
    """Rows by block of consecutive positions; a block also sees the rows ahead that its last batch may reach."""
    block, offset = F.floor(F.col("position") / block_rows), F.col("position") % block_rows
    seen_by = F.array_compact(F.array(block, F.when((offset < files - 1) & (block > 0), block - 1)))
    placed = rows.withColumn("block", F.explode(seen_by))
    return placed.repartition(group, "block").sortWithinPartitions(group, "block", "position")


def packed_batches(
    rows: DataFrame, group: str, order: str, files: int = BATCH_FILES, most: int = BATCH_TOKENS,
    block_rows: int = BLOCK_ROWS, together: int = BLOCKS_TOGETHER,
) -> DataFrame:
    """Add `batch`, counting from 0 per group: rows in order, each batch as full as `files` rows and `most` tokens allow.

    Only a row of more than `most` tokens makes a batch above the bound, alone. Rows are (group, order, tokens, ...).
    A group of any size spans many tasks: every block of rows says for each row its first batch may start at where the
    next block's first batch starts, and stringing these together settles all blocks.
    """
    if files < 1 or files >= block_rows:
        raise ValueError("files must be at least 1 and less than block_rows")
    # Written, so that the sort's sampling reads slim rows.
    placed = cut_lineage(ordered_position(cut_lineage(rows), group, order))
    kind = dict(rows.dtypes)[group]
    links_ddl = f"{group} {kind}, block long, entry int, leaves int, starts long"

    def links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, begins in _whole_groups(frames, [group, "block"]):
            after = next_starts(frame["tokens"].to_numpy(), begins, files, most)
            out = []
            for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(frame)]):
                block = frame["block"].iloc[begin]
                own = int((frame["position"].iloc[begin:end] < (block + 1) * block_rows).sum())
                if block == 0 and end - begin == own:
                    continue  # the group's only block
                leaves, starts = [0] * own, [0] * own
                for i in range(own - 1, -1, -1):
                    to = int(after[begin + i]) - begin
                    leaves[i], starts[i] = (leaves[to], starts[to] + 1) if to < own else (to - own, 1)
                out += [(frame[group].iloc[begin], block, i, leaves[i], starts[i]) for i in range(min(files, own))]
            yield pd.DataFrame(out, columns=[group, "block", "entry", "leaves", "starts"])

    first = cut_lineage(_blocks(placed, group, files, block_rows).mapInPandas(links, links_ddl))
    entries = _settled(first, group, kind, together).withColumnRenamed("starts", "earlier")
    columns = [*placed.columns, "batch"]
    ddl = ", ".join(f"`{name}` {kind}" for name, kind in placed.dtypes) + ", batch long"
    asked = _blocks(placed, group, files, block_rows).join(entries, [group, "block"], "left")

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, begins in _whole_groups(frames, [group, "block"]):
            after = next_starts(frame["tokens"].to_numpy(), begins, files, most)
            started = np.zeros(len(frame), np.int64)
            batch = np.empty(len(frame), np.int64)
            for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(frame)]):
                entry, earlier = frame["entry"].iloc[begin], frame["earlier"].iloc[begin]
                at = begin + (0 if pd.isna(entry) else int(entry))
                while at < end:
                    started[at] = 1
                    at = int(after[at])
                batch[begin:end] = np.cumsum(started[begin:end]) - 1 + (0 if pd.isna(earlier) else int(earlier))
            own = frame["position"].to_numpy() // block_rows == frame["block"].to_numpy()
            yield frame.assign(batch=batch).loc[own, columns]

    ordered = asked.sortWithinPartitions(group, "block", "position")
    return ordered.mapInPandas(numbered, ddl).drop("position")


def _settled(links: DataFrame, group: str, kind: str, together: int) -> DataFrame:
    """(group, block, entry, starts): where each block's first batch starts, and how many start before the block.

    Runs of blocks become one link, run after run, until a group has one; then the entries go back down.
    """
    levels = [links]
    while True:
        runs = F.floor(F.col("block") / together).alias("run")
        if levels[-1].select(F.max("block")).first()[0] in (None, 0):
            break

        def strung(frame: pd.DataFrame) -> pd.DataFrame:
            by_block = [dict(zip(b["entry"], zip(b["leaves"], b["starts"]))) for _, b in frame.sort_values("block").groupby("block")]
            out = []
            for entry in by_block[0]:
                at, starts = entry, 0
                for link in by_block:
                    if at not in link:  # the group ends before
                        break
                    at, more = link[at]
                    starts += more
                out.append((frame[group].iloc[0], frame["block"].min() // together, entry, at, starts))
            return pd.DataFrame(out, columns=[group, "block", "entry", "leaves", "starts"])

        levels.append(cut_lineage(levels[-1].groupBy(group, runs).applyInPandas(
            strung, f"{group} {kind}, block long, entry int, leaves int, starts long")))
    known = levels[-1].select(group, F.lit(0).cast("long").alias("block"), F.lit(0).alias("entry"),
                              F.lit(0).cast("long").alias("starts")).distinct()
    for links in reversed(levels[:-1]):
        above = known.select(group, F.col("block").alias("run"), F.col("entry").alias("comes"), F.col("starts").alias("before"))
        met = links.withColumn("run", F.floor(F.col("block") / together)).join(above, [group, "run"])

        def spread(frame: pd.DataFrame) -> pd.DataFrame:
            at, before, out = frame["comes"].iloc[0], frame["before"].iloc[0], []
            for block, b in frame.sort_values("block").groupby("block"):
                link = dict(zip(b["entry"], zip(b["leaves"], b["starts"])))
                out.append((frame[group].iloc[0], block, at, before))
                if at not in link:
                    break
                at, more = link[at]
                before += more
            return pd.DataFrame(out, columns=[group, "block", "entry", "starts"])

        known = cut_lineage(met.groupBy(group, "run").applyInPandas(spread, f"{group} {kind}, block long, entry int, starts long"))
    return known


def module_batches(records: DataFrame, batch_files: int = BATCH_FILES, max_tokens: int = BATCH_TOKENS) -> DataFrame:
    """(module, batch, path, tokens): files of a module in path order, packed by number and estimated tokens."""
    slim = records.select(
        module_of(F.col("path")).alias("module"), "path", estimated_tokens(F.coalesce("text", F.lit(""))).alias("tokens"),
    )
    return packed_batches(slim, "module", "path", batch_files, max_tokens).select("module", "batch", "path", "tokens")


def batch_sizes(batches: DataFrame) -> DataFrame:
    return batches.groupBy("module", "batch").agg(
        F.count(F.lit(1)).alias("files"), F.sum("tokens").alias("tokens")
    )


# -- prompts --------------------------------------------------------------------------------

PROMPT_INTRO = "Describe how the files of this module work together, and name what they depend on.\n"
IMPORTS_TITLE = "\n## Imports from other modules\n\n"


def _import_lines(edges: DataFrame) -> DataFrame:
    """(path, links): a line for every file of another module that a file imports; one file bounds the list."""
    line = F.concat(F.lit("- "), "src_path", F.lit(" -> "), "dst_path")
    lines = edges.filter("cross_module").select(F.col("src_path").alias("path"), line.alias("line")).distinct()
    return lines.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("links"))


def relationship_prompts(
    records: DataFrame, edges: DataFrame | None = None, batch_files: int = BATCH_FILES, max_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """(module, batch, prompt): the (path, text) descriptions of a batch and its files' imports from other modules.

    `edges` are resolved dependencies. No prompt is above `max_tokens` unless it is about one file.
    """
    # Descriptions are rendered once, then read for their length and for their text.
    described = cut_lineage(records.select("path", "text"))
    if edges is None:
        linked = described.withColumn("links", F.lit(None).cast("string"))
    else:
        linked = cut_lineage(described.join(_import_lines(edges), "path", "left"))
    slim = linked.select(
        module_of(F.col("path")).alias("module"), "path",
        (estimated_tokens(F.coalesce("text", F.lit(""))) + F.coalesce(estimated_tokens(F.col("links")), F.lit(0))).alias("tokens"),
    )
    batches = packed_batches(slim, "module", "path", batch_files, max_tokens - HEAD_TOKENS)
    whole = batches.select("module", "batch", "path").join(linked, "path")
    grouped = whole.groupBy("module", "batch").agg(  # a batch bounds the list
        F.array_sort(F.collect_list(F.struct("path", "text", "links"))).alias("files")
    )
    links = F.array_join(F.transform("files", lambda f: f["links"]), "\n")
    return grouped.select(
        "module", "batch",
        F.concat(
            F.lit("# Module "), "module", F.lit("\n\n"), F.lit(PROMPT_INTRO), F.lit("\n"),
            F.array_join(F.transform("files", lambda f: f["text"]), "\n"),
            F.when(links != "", F.concat(F.lit(IMPORTS_TITLE), links)).otherwise(""),
        ).alias("prompt"),
    )


SUMMARY_SYSTEM = """You explain the architecture of a code base to engineers who are new to it. Answer with a single
JSON object and nothing else, with one field, summary: what belongs together, what depends on what, and where
execution begins.
"""
SYNTHESIS_INTRO = "Put these summaries of parts of one code base together into one.\n"
NO_SUMMARY = "(no summary)"


def synthesis_prompts(summaries: DataFrame, batch_files: int = BATCH_FILES, max_tokens: int = BATCH_TOKENS) -> DataFrame:
    """(batch, prompt) over (name, summary) rows in order of name, packed like the files of a module.

    So that every round has fewer prompts, a summary takes no more than half of a prompt.
    """
    room = (max_tokens - HEAD_TOKENS) // 2
    part = F.concat(F.lit("## "), "name", F.lit("\n\n"), "summary", F.lit("\n"))
    texts = cut_lineage(summaries.select("name", F.left(part, F.lit(room * CHARS_PER_TOKEN)).alias("text")))
    slim = texts.select(F.lit(0).alias("all"), "name", estimated_tokens(F.col("text")).alias("tokens"))
    batches = packed_batches(slim, "all", "name", max(2, batch_files), max_tokens - HEAD_TOKENS)
    ordered = F.array_sort(F.collect_list(F.struct("name", "text")))
    return batches.select("name", "batch").join(texts, "name").groupBy("batch").agg(ordered.alias("parts")).select(
        "batch", F.concat(F.lit(SYNTHESIS_INTRO), F.lit("\n"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n")).alias("prompt")
    )


def relationship_map(
    records: DataFrame, edges: DataFrame | None, log_dir: str, client_factory: Callable[[], ChatFn],
    batch_files: int = BATCH_FILES, max_tokens: int = BATCH_TOKENS, parallelism: int | None = None,
) -> DataFrame:
    """(level, name, summary): summaries of module batches, of batches of summaries, and so on up to a single one.

    Replies are logged level by level before they are read; a run over the same `log_dir` asks only for what is
    missing. When the connection is lost the levels reached so far are returned. A prompt without a usable reply
    takes part with a remark in place of its summary.
    """
    spark = records.sparkSession
    log = ResponseLog(spark, log_dir)
    room = max_tokens - estimate(SUMMARY_SYSTEM)
    prompts = relationship_prompts(records, edges, batch_files, room).select(
        F.format_string("%s#%06d", "module", "batch").alias("name"), "prompt"
    )
    levels, level = None, 0
    while True:
        prompts = cut_lineage(prompts)
        missing = prompts
        if log.is_written(level, "summary"):
            answered = log.read((level, "summary")).filter(F.col("kind") != LOST).select(F.col("path").alias("name"))
            missing = prompts.join(answered.distinct(), "name", "left_anti")
        if not missing.isEmpty():
            requests = missing.select(
                F.col("name").alias("path"), F.lit(level).alias("attempt"), F.lit(SUMMARY_SYSTEM).alias("system_prompt"),
                F.col("prompt").alias("user_prompt"),
            )
            log.ask(level, "summary", requests, ("summary",), client_factory, parallelism)
        replies = log.read((level, "summary")).join(prompts.select(F.col("name").alias("path")), "path", "left_semi")
        parsed = replies.filter(F.col("kind") == REPLY).withColumn("parsed", extract_json(F.col("raw")))
        said = F.coalesce(member(F.col("parsed"), "$.summary", "string"), store_json(F.col("parsed")))
        best = parsed.filter("parsed IS NOT NULL").groupBy("path").agg(F.min_by(said, "call_no").alias("summary"))
        answered = replies.filter(F.col("kind") != LOST).select("path").distinct()
        summaries = cut_lineage(answered.join(best, "path", "left").select(
            F.lit(level).alias("level"), F.col("path").alias("name"), F.coalesce("summary", F.lit(NO_SUMMARY)).alias("summary")
        ))
        levels = summaries if levels is None else levels.unionByName(summaries)
        asked = prompts.count()
        if asked <= 1 or summaries.count() < asked:
            return levels
        level += 1
        prompts = synthesis_prompts(summaries, batch_files, room).select(
            F.format_string("level%02d#%06d", F.lit(level), "batch").alias("name"), "prompt"
        )


def estimate(text: str) -> int:
    return -(-len(text) // CHARS_PER_TOKEN)
