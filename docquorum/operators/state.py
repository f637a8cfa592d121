"""Job table and run metadata as relational operators.

A job row is file_path, status, three JSON results, retry_count, final_description,
error_log, created_at, updated_at; file_path is unique. Operators return new tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status names.
ACTIVE = (
    "pending", "pass1_done", "pass2_done", "quorum_pass",
    "quorum_fail", "retry_1", "retry_2", "retry_3",
)
TERMINAL = ("complete", "flagged", "error", "removed")
# Resume order, earliest stage first.
RESUME_ORDER = (
    "pending", "pass1_done", "pass2_done", "quorum_fail",
    "retry_1", "retry_2", "retry_3", "quorum_pass",
)
# Columns of the job table, and those an update may set.
JOB_DDL = (
    "file_path string, status string, pass1_result string, pass2_result string, "
    "quorum_result string, retry_count int, final_description string, error_log string, "
    "created_at timestamp, updated_at timestamp, content_hash string"
)
UPDATABLE = (
    "pass1_result", "pass2_result", "quorum_result",
    "retry_count", "final_description", "error_log", "content_hash",
)
METADATA_DDL = "key string, value string, updated_at timestamp"


def valid_status(status: Column) -> Column:
    return F.coalesce(status.isin(*ACTIVE, *TERMINAL), F.lit(False))


def invalid_updates(updates: DataFrame) -> DataFrame:
    return updates.filter(~valid_status(F.col("status")))


def empty_jobs(spark) -> DataFrame:
    return spark.createDataFrame([], JOB_DDL)


def pending_rows(paths: DataFrame, now: Column | None = None) -> DataFrame:
    """Fresh pending jobs for the distinct paths of a one-column table."""
    now = F.current_timestamp() if now is None else now
    blank = {"status": F.lit("pending"), "retry_count": F.lit(0), "created_at": now, "updated_at": now}
    unique = paths.select(F.col(paths.columns[0]).alias("file_path")).distinct()
    fields = [field.strip().split(" ") for field in JOB_DDL.split(",")]
    return unique.select(
        "file_path",
        *[blank.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields[1:]],
    )


def jobs_to_add(jobs: DataFrame, paths: DataFrame, now: Column | None = None) -> DataFrame:
    """Pending rows for paths that have no job yet, whatever its status."""
    return pending_rows(paths, now).join(jobs.select("file_path"), "file_path", "left_anti")


def add_jobs(jobs: DataFrame, paths: DataFrame, now: Column | None = None) -> DataFrame:
    """Insert-if-absent."""
    return jobs.unionByName(jobs_to_add(jobs, paths, now), allowMissingColumns=True).select(*jobs.columns)


def latest_updates(updates: DataFrame, order: str | None = None) -> DataFrame:
    """One update per path, folded before any join: the greatest by `order`, then by content."""
    others = [c for c in updates.columns if c != "file_path"]
    ranked = ([order] if order else []) + [c for c in others if c != order]
    best = updates.groupBy("file_path").agg(F.max(F.struct(*ranked)).alias("last"))
    kept = [c for c in others if c != order]
    return best.select("file_path", *[F.col(f"last.{c}").alias(c) for c in kept])


def apply_updates(
    jobs: DataFrame,
    updates: DataFrame,
    now: Column | None = None,
    order: str | None = None,
    check: bool = True,
    unique: bool = False,
) -> DataFrame:
    """Set status and any given fields on matching jobs; absent fields keep their values.

    Updates without a job are ignored. `order` names a column that ranks repeated updates;
    `unique` says that there are none.
    """
    fields = [c for c in updates.columns if c not in ("file_path", "status", order)]
    unknown = sorted(set(fields) - set(UPDATABLE))
    if unknown:
        raise ValueError(f"Unknown field: {unknown[0]!r}")
    if check:  # inside the plan, so that the updates are computed once
        bad = F.raise_error(F.concat(F.lit("Invalid status in updates: "), F.coalesce("status", F.lit("null"))))
        updates = updates.withColumn("status", F.when(valid_status(F.col("status")), F.col("status")).otherwise(bad))
    now = F.current_timestamp() if now is None else now
    new = updates if unique else latest_updates(updates, order)
    changed = new.select(
        "file_path", F.lit(True).alias("hit"), *[F.col(c).alias(f"new_{c}") for c in ["status", *fields]]
    )
    joined = jobs.join(changed, "file_path", "left")
    hit = F.col("hit")

    def value(name: str) -> Column:
        if name == "updated_at":
            return F.when(hit, now).otherwise(F.col(name)).alias(name)
        if name == "status" or name in fields:
            return F.when(hit, F.col(f"new_{name}")).otherwise(F.col(name)).alias(name)
        return F.col(name)

    return joined.select(*[value(name) for name in jobs.columns])


def get_job(jobs: DataFrame, file_path: str) -> DataFrame:
    return jobs.filter(F.col("file_path") == file_path)


def jobs_by_status(jobs: DataFrame, *statuses: str) -> DataFrame:
    return jobs.filter(F.col("status").isin(*statuses))


def resume_rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in RESUME_ORDER]), status) - 1


def resumable_jobs(jobs: DataFrame) -> DataFrame:
    """Unfinished jobs, earliest stage first, ties by path."""
    active = jobs_by_status(jobs, *ACTIVE)
    return active.orderBy(resume_rank(F.col("status")), "file_path")


def tracked_paths(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status") != "removed").select("file_path")


def _walked_paths(walked: DataFrame) -> DataFrame:
    return walked.select(F.col(walked.columns[0]).alias("file_path"))


def new_files(jobs: DataFrame, walked: DataFrame) -> DataFrame:
    """Walked but not tracked."""
    return _walked_paths(walked).distinct().join(tracked_paths(jobs), "file_path", "left_anti")


def removed_files(jobs: DataFrame, walked: DataFrame) -> DataFrame:
    """Tracked but no longer walked."""
    return tracked_paths(jobs).join(_walked_paths(walked), "file_path", "left_anti")


def mark_removed(jobs: DataFrame, paths: DataFrame, now: Column | None = None) -> DataFrame:
    gone = paths.select(F.col(paths.columns[0]).alias("file_path")).distinct()
    return apply_updates(jobs, gone.withColumn("status", F.lit("removed")), now, check=False, unique=True)


def reconcile_changes(
    jobs: DataFrame, walked: DataFrame, revive_removed: bool = False, now: Column | None = None
) -> DataFrame:
    """Only the job rows that a file listing adds or changes.

    A file that returns after removal stays removed unless `revive_removed` is set.
    """
    now = F.current_timestamp() if now is None else now
    fresh = jobs_to_add(jobs, walked, now)
    gone = (
        jobs.filter(F.col("status") != "removed")
        .join(_walked_paths(walked), "file_path", "left_anti")
        .withColumns({"status": F.lit("removed"), "updated_at": now})
    )
    changes = fresh.unionByName(gone, allowMissingColumns=True)
    if not revive_removed:
        return changes.select(*jobs.columns)
    back = (
        jobs_by_status(jobs, "removed")
        .join(_walked_paths(walked), "file_path", "left_semi")
        .withColumns({"status": F.lit("pending"), "updated_at": now})
    )
    return changes.unionByName(back, allowMissingColumns=True).select(*jobs.columns)


def below_folders(jobs: DataFrame, folders: DataFrame) -> DataFrame:
    """Paths of jobs below any of the folders, whose names end in a slash; joined by every folder on a path."""
    parts = F.split("file_path", "/")
    above = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0),
        lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/")))
    entered = jobs.select("file_path", F.explode(above).alias("folder"))
    return entered.join(folders.select(F.col("path").alias("folder")).distinct(), "folder", "left_semi").select(
        F.col("file_path").alias("path")).distinct()


def reopen_changed(jobs: DataFrame, hashes: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows to store for finished jobs by the present content of their file: pending ones where it changed.

    `hashes` is (path, content_hash) of the present files. A job stored without a hash takes the present one and stays
    as it is otherwise, so that the next change is seen. A file without a hash changes nothing.
    """
    now = F.current_timestamp() if now is None else now
    seen = hashes.select(F.col("path").alias("file_path"), F.col("content_hash").alias("present"))
    finished = jobs_by_status(jobs, *(status for status in TERMINAL if status != "removed"))
    met = finished.join(seen, "file_path").filter(F.col("present").isNotNull() & ~F.col("content_hash").eqNullSafe(F.col("present")))
    changed = F.col("content_hash").isNotNull()
    fresh = {name: F.when(~changed, F.col(name)).cast(kind) for name, kind in jobs.dtypes if name in UPDATABLE}
    fresh |= {
        "status": F.when(changed, "pending").otherwise(F.col("status")),
        "retry_count": F.when(changed, 0).otherwise(F.col("retry_count")),
        "updated_at": F.when(changed, now).otherwise(F.col("updated_at")),
        "content_hash": F.col("present"),
    }
    return met.withColumns(fresh).select(*jobs.columns)


def reconcile(
    jobs: DataFrame, walked: DataFrame, revive_removed: bool = False, now: Column | None = None
) -> DataFrame:
    """Job table in step with a file listing, in one full outer join."""
    now = F.current_timestamp() if now is None else now
    present = _walked_paths(walked).distinct().withColumn("walked", F.lit(True))
    table = jobs.withColumn("known", F.lit(True)).join(present, "file_path", "full_outer")
    unknown, status = F.col("known").isNull(), F.col("status")
    next_status = (
        F.when(unknown, "pending")
        .when(F.col("walked").isNull(), "removed")
        .when((status == "removed") & F.lit(revive_removed), "pending")
        .otherwise(status)
    )
    values = {
        "status": next_status,
        "retry_count": F.coalesce("retry_count", F.lit(0)),
        "created_at": F.coalesce("created_at", now),
        "updated_at": F.when(~status.eqNullSafe(next_status), now).otherwise(F.col("updated_at")),
    }
    return table.select(*[values.get(name, F.col(name)).alias(name) for name in jobs.columns])


def outcome_updates(outcomes: DataFrame) -> DataFrame:
    """Run outcomes as job updates, with the content hash if they carry one."""
    return outcomes.select(
        F.col("path").alias("file_path"), "status", "pass1_result", "pass2_result",
        "quorum_result", "retry_count",
        F.col("merged_result").alias("final_description"),
        F.col("error").alias("error_log"), *(c for c in outcomes.columns if c == "content_hash"),
    )


def apply_outcomes(jobs: DataFrame, outcomes: DataFrame, now: Column | None = None) -> DataFrame:
    """Write a run's outcomes into the job table."""
    return apply_updates(jobs, outcome_updates(outcomes), now, check=False, unique=True)


def upsert_metadata(metadata: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Latest value per key; equal times are decided by the greater value."""
    rows = metadata if changes is None else metadata.unionByName(changes)
    last = rows.groupBy("key").agg(F.max(F.struct("updated_at", "value")).alias("last"))
    return last.select("key", "last.value", "last.updated_at")


def get_metadata(metadata: DataFrame, key: str) -> DataFrame:
    return upsert_metadata(metadata.filter(F.col("key") == key)).select("value")


def run_started(metadata: DataFrame, repo_path: str, model: str, now: Column) -> DataFrame:
    """Metadata rows of a run: a first start records its settings, later ones a resume time.

    The choice is made inside the plan, from whether a start is already recorded.
    """
    known = metadata.filter(F.col("key") == "started_at").agg(F.count(F.lit(1)).alias("starts"))
    at = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX")

    def entry(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    start = F.array(
        entry("repo_path", F.lit(repo_path)), entry("model", F.lit(model)), entry("started_at", at)
    )
    resume = F.array(entry("last_resumed_at", at))
    chosen = F.when(F.col("starts") == 0, start).otherwise(resume)
    rows = known.select(F.explode(chosen).alias("row"))
    return rows.select("row.key", "row.value", now.alias("updated_at"))
