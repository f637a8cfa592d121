"""Live annotation: model calls on executors, resolved by the quorum operators.

Each attempt has two steps, the two passes and the judge. A step writes every raw reply to
the response log before anything reads it, so that a retried task or a restarted driver
never calls the model again for a step that is already written. Keep speculative execution
off while calling a model.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquorum.functions.prompts import with_analysis_prompt, with_judge_prompt
from docquorum.operators.long_files import bounded_requests, is_part, merge_part_replies, refuse_over_bound
from docquorum.operators.quorum import (
    CALLS_PER_STAGE, STAGES, both_passes, is_usable, resolve_quorum, split_paths,
)
from docquorum.session import cut_lineage, hadoop_path, scratch_dir

# Retry and back-off of lost connections, in tries and seconds.
CONNECTION_TRIES = 5
BACKOFF_FIRST = 1
BACKOFF_MAX = 60

LOG_DDL = (
    "path string, attempt int, stage string, call_no int, raw string, kind string, error string, content_hash string, "
    "chunk_no int, n_chunks int"
)
REPLY, FAILED, LOST = "reply", "error", "lost"
ROWS_PER_FLUSH = 64
# Written requests that one client is sent in one go, and the rows of one of their files.
BYTES_PER_CLIENT = 128 << 20
ROWS_PER_FILE = 5_000
ANY = 2**30  # of attempts

ChatFn = Callable[[str, str], str]


class Annotation(NamedTuple):
    outcomes: DataFrame
    log: DataFrame
    connection_lost: bool


class _ConnectionLost(Exception):
    pass


class _Caller:
    """One client per partition, with back-off over consecutive connection failures."""

    def __init__(self, client_factory: Callable[[], ChatFn], sleep: Callable[[float], None]):
        self._client = client_factory()
        self._sleep = sleep
        self._failures = 0

    def __call__(self, system: str, user: str) -> str:
        pause = BACKOFF_FIRST
        while True:
            try:
                reply = self._client(system, user)
            except (ConnectionError, TimeoutError) as lost:
                self._failures += 1
                if self._failures >= CONNECTION_TRIES:
                    raise _ConnectionLost(str(lost)) from lost
                self._sleep(pause)
                pause = min(2 * pause, BACKOFF_MAX)
                continue
            self._failures = 0
            return reply


def _refuse_constant(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_refuse_constant)


def reply_is_usable(raw: str, stage: str) -> bool:
    """Whether to stop asking: the same rule the log is later resolved with."""
    parts = raw.split("```", 2)
    body = parts[1] if len(parts) == 3 else raw
    start = body.find("{")
    if start < 0:
        return False
    try:
        value, _ = _DECODER.raw_decode(body, start)
    except (ValueError, RecursionError):
        return False
    return stage != "judge" or "agree" in value


def _ask(row, stages: tuple[str, ...], chat: Callable[[str, int], str]) -> Iterator[tuple]:
    """Log rows of one path; a stage without a usable reply ends the path's attempt."""
    for stage in stages:
        for call_no in range(1, CALLS_PER_STAGE + 1):
            key = (row.path, row.attempt, stage, call_no)
            try:
                raw = str(chat(stage, call_no))
            except _ConnectionLost:
                raise
            except Exception as failure:  # a failing row must not end the run
                yield (*key, None, FAILED, str(failure))
                return
            yield (*key, raw, REPLY, None)
            if reply_is_usable(raw, stage):
                break
        else:
            return


def call_model(
    requests: DataFrame,
    stages: tuple[str, ...],
    client_factory: Callable[[], ChatFn],
    parallelism: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Log rows for requests of (path, attempt, system_prompt, user_prompt).

    A request whose text could not be read says so in an `error` column and is not sent. A
    `content_hash` is copied to the log, as are `chunk_no` and `n_chunks` of a request about a part of a file.
    `parallelism` is the number of partitions, hence of concurrent clients; by default the cluster's. Each partition
    is one task: `ResponseLog.ask` keeps their size within bounds. Without a client, each request carries its replies in a `recorded` array.
    """
    # Without a fixed number, adaptive execution would join the small partitions of the judge step into one client.
    clients = parallelism or requests.sparkSession.sparkContext.defaultParallelism
    requests = requests.repartition(clients, "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = _Caller(client_factory, sleep)
        lost = None
        columns = [field.strip().split(" ")[0] for field in LOG_DDL.split(",")]
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                def chat(stage, call_no, row=row):
                    return caller(row.system_prompt, row.user_prompt)

                unreadable = getattr(row, "error", None)
                more = (getattr(row, "content_hash", None), getattr(row, "chunk_no", 0), getattr(row, "n_chunks", 1))
                if unreadable is not None:
                    rows.append((row.path, row.attempt, stages[0], 0, None, FAILED, unreadable, *more))
                elif lost is None:
                    try:
                        # Keep a path's rows only when all its calls went through.
                        rows.extend([(*logged, *more) for logged in _ask(row, stages, chat)])
                    except _ConnectionLost as failure:
                        lost = str(failure)
                if lost is not None and unreadable is None:
                    rows.append((row.path, row.attempt, stages[0], 0, None, LOST, lost, *more))
                if len(rows) >= ROWS_PER_FLUSH:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return requests.mapInPandas(run, LOG_DDL)


def _portions(requests: DataFrame, folder: str, clients: int) -> Iterator[DataFrame]:
    """The requests, written to a folder first, in portions that leave each client a bounded share.

    There are as many portions as the size of the table asks for, so a task's share does not grow with the table.
    """
    spark = requests.sparkSession
    requests.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(folder)
    fs, path = hadoop_path(spark, folder)
    written = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(path))
    files = [(f"{folder}/{name}", size) for name, size in written if not name.startswith(("_", "."))]
    table = spark.read.schema(requests.schema)
    chosen, held = [], 0
    for file, size in files:
        if chosen and held + size > clients * BYTES_PER_CLIENT:
            yield table.parquet(*chosen)
            chosen, held = [], 0
        chosen.append(file)
        held += size
    yield table.parquet(*(chosen or [folder]))


class ResponseLog:
    """The written log: one folder per attempt and step, one part per run that added to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _parts(self, attempt: int, step: str) -> list[tuple[str, bool]]:
        base = f"{self.root}/attempt={attempt}/{step}"
        fs, folder = hadoop_path(self.spark, base)
        if not fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        return [
            (f"{base}/{name}", fs.exists(hadoop_path(self.spark, f"{base}/{name}/_SUCCESS")[1]))
            for name in names
        ]

    def read(self, *keys: tuple[int, str]) -> DataFrame:
        folders = [path for key in keys for path, done in self._parts(*key) if done]
        if not folders:
            return self.spark.createDataFrame([], LOG_DDL)
        return self.spark.read.schema(LOG_DDL).parquet(*folders)

    def append(self, attempt: int, step: str, rows: DataFrame) -> None:
        number = len(self._parts(attempt, step))
        rows.write.mode("errorifexists").parquet(
            f"{self.root}/attempt={attempt}/{step}/part-{number:05d}"
        )

    def ask(
        self, attempt: int, step: str, requests: DataFrame, stages: tuple[str, ...], client_factory: Callable[[], ChatFn],
        parallelism: int | None = None, sleep: Callable[[float], None] = time.sleep,
    ) -> None:
        """Have a client answer the requests and add its replies, one part for each portion of the requests.

        Portions follow one another, so there are never more than `parallelism` clients at once.
        """
        folder = scratch_dir(self.spark, "requests")
        clients = parallelism or self.spark.sparkContext.defaultParallelism
        for portion in _portions(requests, folder, clients):
            self.append(attempt, step, call_model(portion, stages, client_factory, parallelism, sleep))
        fs, path = hadoop_path(self.spark, folder)
        fs.delete(path, True)

    def is_written(self, attempt: int, step: str) -> bool:
        return any(done for _, done in self._parts(attempt, step))

    def everything(self, max_retries: int) -> DataFrame:
        return self.read(*[(a, step) for a in range(max_retries + 1) for step in ("passes", "judge")])


def _answered(log: DataFrame) -> DataFrame:
    """Paths of which every part is answered."""
    return _answered_parts(log).groupBy("path", "n_chunks").agg(F.count(F.lit(1)).alias("answered")).filter(
        "answered = n_chunks"
    ).select("path").distinct()


def _answered_parts(log: DataFrame) -> DataFrame:
    """(path, n_chunks, chunk_no) of answers; rows of logs that knew no parts are about whole files."""
    return log.filter(F.col("kind") != LOST).select(
        "path", F.coalesce("n_chunks", F.lit(1)).alias("n_chunks"), F.coalesce("chunk_no", F.lit(0)).alias("chunk_no")
    ).distinct()


def _by_attempt(recorded: DataFrame, max_retries: int) -> DataFrame:
    """The recorded log, written by attempt and stage, so that each step reads its own replies only."""
    folder = scratch_dir(recorded.sparkSession, "recorded")
    columns = ["path", "attempt", "stage", "call_no", "raw"]
    wanted = recorded.filter(
        F.col("attempt").between(0, max_retries) & F.col("call_no").between(1, CALLS_PER_STAGE) & F.col("stage").isin(*STAGES)
    ).select(*columns)
    wanted.write.partitionBy("attempt", "stage").parquet(folder)
    return recorded.sparkSession.read.schema(wanted.schema).parquet(folder).select(*columns)


def _replayed(paths: DataFrame, recorded: DataFrame, attempt: int, stages: tuple[str, ...]) -> DataFrame:
    """Log rows of paths whose recorded replies take the place of a client's, by the rules of `_ask`.

    A call that was not recorded gives an empty reply. The replies of a path are folded where they lie and meet it in one
    shuffle; a stage's replies are parsed only up to the first usable one.
    """
    calls = range(1, CALLS_PER_STAGE + 1)
    replies = recorded.filter((F.col("attempt") == attempt) & F.col("stage").isin(*stages)).groupBy("path").agg(*[
        F.min(F.when((F.col("stage") == s) & (F.col("call_no") == c), F.struct(F.col("raw").isNull().alias("none"), "raw"))).alias(f"{s}_{c}")
        for s in stages for c in calls
    ])
    rows, before = paths.join(replies, "path", "left"), F.lit(True)
    for stage in stages:
        # A recorded null counts as the text of it, as in a reply of a client.
        rows = rows.withColumns({
            f"{stage}_{c}": F.when(F.col(f"{stage}_{c}").isNull(), "").otherwise(F.coalesce(f"{stage}_{c}.raw", F.lit("None")))
            for c in calls
        })
        first = F.lit(None).cast("int")
        for c in reversed(calls):
            first = F.when(is_usable(F.col(f"{stage}_{c}"), stage), c).otherwise(first)
        rows = rows.withColumn(f"{stage}_first", F.when(before, first)).withColumn(
            f"{stage}_asked", F.when(before, F.coalesce(f"{stage}_first", F.lit(CALLS_PER_STAGE))).otherwise(0))
        before = F.col(f"{stage}_first").isNotNull()
    asked = F.flatten(F.array(*[
        F.slice(F.array(*[
            F.struct(F.lit(s).alias("stage"), F.lit(c).alias("call_no"), F.col(f"{s}_{c}").alias("raw")) for c in calls
        ]), F.lit(1), F.col(f"{s}_asked"))
        for s in stages
    ]))
    content_hash = F.col("content_hash") if "content_hash" in rows.columns else F.lit(None).cast("string")
    return rows.select("path", content_hash.alias("content_hash"), F.inline(asked)).select(
        "path", F.lit(attempt).alias("attempt"), "stage", "call_no", "raw", F.lit(REPLY).alias("kind"),
        F.lit(None).cast("string").alias("error"), "content_hash", F.lit(0).alias("chunk_no"), F.lit(1).alias("n_chunks"),
    )


def annotate(
    files: DataFrame,
    log_dir: str,
    client_factory: Callable[[], ChatFn] | None = None,
    recorded: DataFrame | None = None,
    max_retries: int = 3,
    parallelism: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
    reader: Callable[[DataFrame], DataFrame] | None = None,
    slices: int = 1,
    max_tokens: int | None = None,
) -> Annotation:
    """Annotate (path, text) rows until every path agrees, fails or runs out of attempts.

    `client_factory` builds a ``chat(system, user) -> str`` on each executor partition;
    `recorded` replays an earlier response log instead. With a `reader`, `files` holds paths
    only, and each attempt reads just the texts it needs. With a `content_hash` column, only log
    rows of the same hash count as answers, so a file that changed is asked about anew. Running again over the same
    `log_dir` continues where the last run stopped; with `slices`, each step is logged in that
    many parts, so that a stopped driver loses at most one part's calls. Requests are written before they are sent, and
    sent in portions of at most `BYTES_PER_CLIENT` a client; every portion is a part of the log.

    No prompt above an estimated `max_tokens` is sent: a longer file is cut at line ends, its parts are asked one by
    one, and their records are merged before the judge sees them. A continued run asks only for parts it lacks.
    """
    if (client_factory is None) == (recorded is None):
        raise ValueError("give either client_factory or recorded")
    if max_tokens is not None and client_factory is None:
        raise ValueError("a bound on prompts needs a client")
    if recorded is not None:
        recorded = _by_attempt(recorded, max_retries)
    log = ResponseLog(files.sparkSession, log_dir)
    earlier = log.is_written(0, "passes")
    lost = False

    hashed = "content_hash" in files.columns
    in_parts = max_tokens is not None or earlier and not log.everything(max_retries).filter(is_part()).isEmpty()

    def mine(rows: DataFrame) -> DataFrame:
        """Rows of the given files and, where hashes are given, of their present content.

        An earlier run may have logged other files, or another content of the same file.
        """
        if hashed:
            same = F.col("content_hash").eqNullSafe(F.col("present"))
            present = files.select(F.col("path").alias("file"), F.col("content_hash").alias("present"))
            return rows.join(present, (F.col("path") == F.col("file")) & same, "left_semi")
        return rows.join(files.select("path"), "path", "left_semi") if earlier else rows

    def with_hash(requests: DataFrame) -> DataFrame:
        if not hashed:
            return requests
        return requests.drop("content_hash").join(files.select("path", "content_hash"), "path", "left")

    def step(attempt: int, name: str, paths: DataFrame, prompts: Callable, stages: tuple[str, ...]) -> DataFrame:
        nonlocal lost
        missing = None
        if log.is_written(attempt, name):
            missing = paths.join(_answered(mine(log.read((attempt, name)))), "path", "left_anti")
        for part in range(slices if missing is None or not missing.isEmpty() else 0):
            chosen = missing
            if slices > 1:
                here = F.pmod(F.xxhash64("path"), F.lit(slices)) == part
                chosen = (paths if missing is None else missing).filter(here)
            if recorded is None:
                requests = with_hash(prompts(chosen)).withColumn("attempt", F.lit(attempt))
                columns = ["path", "attempt", "system_prompt", "user_prompt"]
                requests = requests.select(*columns, *(
                    c for c in requests.columns if c in ("error", "content_hash", "chunk_no", "n_chunks")))
                if missing is not None and "n_chunks" in requests.columns:  # some parts of a file may be answered
                    done = _answered_parts(mine(log.read((attempt, name))))
                    requests = requests.join(done, ["path", "n_chunks", "chunk_no"], "left_anti")
                log.ask(attempt, name, requests, stages, client_factory, parallelism, sleep)
            else:
                log.append(attempt, name, _replayed(with_hash(paths if chosen is None else chosen), recorded, attempt, stages))
        written = mine(log.read((attempt, name)))
        if recorded is None:
            cut_off = written.filter(F.col("kind") == LOST)
            lost = lost or not cut_off.join(_answered(written), "path", "left_anti").isEmpty()
        return written

    split = None
    for attempt in range(max_retries + 1):
        def analysis(missing: DataFrame | None, waiting: DataFrame | None = split) -> DataFrame:
            chosen = waiting if missing is None else missing
            if reader is not None:
                texts = reader(files.select("path") if chosen is None else chosen)
            else:
                texts = files if chosen is None else files.join(chosen, "path", "left_semi")
            return with_analysis_prompt(texts) if max_tokens is None else bounded_requests(texts, max_tokens)

        paths = files.select("path") if split is None else split
        passes = step(attempt, "passes", paths, analysis, ("pass1", "pass2"))
        whole = _whole_files(_replies(passes), in_parts)
        pairs = both_passes(whole, ANY)

        def judging(missing: DataFrame | None, pairs: DataFrame = pairs) -> DataFrame:
            asked = with_judge_prompt(pairs if missing is None else pairs.join(missing, "path", "left_semi"))
            return asked if max_tokens is None else refuse_over_bound(asked, max_tokens)

        judged = step(attempt, "judge", pairs.select("path"), judging, ("judge",))
        if lost or attempt == max_retries:
            break
        # Only files with both passes are judged, so the verdicts alone tell which are asked again.
        split = cut_lineage(split_paths(_replies(judged), ANY))
        if split.isEmpty():
            break
    everything = mine(log.everything(max_retries))
    return Annotation(outcomes(everything, max_retries, in_parts), everything, lost)


def _whole_files(replies: DataFrame, in_parts: bool) -> DataFrame:
    """(path, attempt, stage, call_no, raw) with the replies about a file's parts merged."""
    if in_parts:
        return merge_part_replies(replies, max_retries=ANY)
    return replies.select("path", "attempt", "stage", "call_no", "raw")


def _replies(log: DataFrame) -> DataFrame:
    return log.filter(F.col("kind") == REPLY)


def outcomes(log: DataFrame, max_retries: int = 3, in_parts: bool = True) -> DataFrame:
    """Resolve a live log: failed calls give status ``error``, unanswered paths no row.

    `in_parts` may be False when it is known that no file was asked in parts.
    """
    failed = (
        log.filter(F.col("kind") == FAILED)
        .groupBy("path")
        .agg(F.min(F.struct("attempt", "stage", "call_no", "error")).alias("first"))
        .select("path", F.col("first.error").alias("call_error"))
    )
    finished = _whole_files(_replies(log).join(failed, "path", "left_anti"), in_parts)
    resolved = resolve_quorum(finished, max_retries, still_open=True)
    errors = failed.select(
        "path", F.lit("error").alias("status"), F.lit(0).alias("retry_count"),
        F.col("call_error").alias("error"),
    )
    return resolved.unionByName(errors, allowMissingColumns=True)
