"""Whole runs over a file tree: annotate it, continue an interrupted run, and report progress.

An output folder holds the state store, the response log, the rendered texts and the report.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from datetime import UTC, datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquorum.operators import state as s
from docquorum.operators.annotate import ChatFn, annotate
from docquorum.operators.discover import MAX_FILE_SIZE, discover
from docquorum.operators.report import detailed_status, run_report, status_table
from docquorum.session import configure, cut_lineage, posix_path
from docquorum.sources.file_tree import read_texts, read_tree, root_entries
from docquorum.sources.ignore import IgnoreRule, ignore_rules
from docquorum.sources.profiles import Rules, bundled_profiles, profiles_from_yaml, resolve_profiles
from docquorum.sources.state_store import StateStore
from docquorum.sources.text_tree import write_flagged, write_markdown, write_report


# A stopped driver loses the calls of one part of a step at most.
FILES_PER_PART = 5_000


class RunResult(NamedTuple):
    jobs: DataFrame
    outcomes: DataFrame
    report: DataFrame
    profiles: list[str]
    connection_lost: bool


class RunStatus(NamedTuple):
    metadata: DataFrame
    progress: DataFrame
    detail: DataFrame


def root_ignore_rules(root: str) -> list[IgnoreRule]:
    path = os.path.join(posix_path(root), ".gitignore")
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as handle:
        return ignore_rules(handle)


def _rules(spark: SparkSession, root: str, profiles, profile_file, all_text_files) -> Rules:
    custom = profiles_from_yaml(profile_file) if profile_file else {}
    known = {**bundled_profiles(), **custom}
    markers = {marker for profile in known.values() for marker in profile.markers}
    return resolve_profiles(root_entries(spark, root, markers), profiles, custom, all_text_files)


def find_files(
    spark: SparkSession,
    root: str,
    profiles: str | None = None,
    profile_file: str | None = None,
    all_text_files: bool = False,
    max_file_size: int = MAX_FILE_SIZE,
    extra_excludes: Iterable[str] = (),
) -> tuple[DataFrame, Rules]:
    """Discovery over a mounted tree; reads only the head of each file."""
    rules = _rules(spark, root, profiles, profile_file, all_text_files)
    whole_names = [glob for glob in rules.exclude_dirs if not set(glob) & set("*?[/")]
    heads = read_tree(spark, root, withContent="head", pruneDirs=",".join([".git", *whole_names]))
    return discover(heads, rules, root_ignore_rules(root), max_file_size, extra_excludes, ordered=False), rules


def _hashes(paths: DataFrame, root: str) -> DataFrame:
    """(path, content_hash) of files; a file that cannot be read has no hash."""
    return read_texts(paths, root).select("path", F.sha2("text", 256).alias("content_hash"))


def analyze(
    spark: SparkSession,
    root: str,
    output_dir: str,
    client_factory: Callable[[], ChatFn],
    model: str = "unknown",
    max_retries: int = 3,
    parallelism: int | None = None,
    slices: int | None = None,
    log_name: str = "log",
    reannotate: bool = True,
    max_tokens: int | None = None,
    **discovery,
) -> RunResult:
    """Annotate a tree, or continue where the last run into `output_dir` stopped.

    New files are added, vanished ones marked removed, and every unfinished job is annotated.
    Each run commits only the job rows it changed. A new `log_name` asks the model afresh.
    Finished files are read again and annotated anew if their content changed; `reannotate=False`
    saves that reading. By default a step is logged in parts of about FILES_PER_PART files.
    With `max_tokens` files whose prompt would be longer are asked in parts.
    """
    configure(spark)
    store = StateStore(spark, f"{output_dir}/state")
    now = F.current_timestamp()
    started = datetime.now(UTC).isoformat(timespec="seconds")
    store.set_metadata(s.run_started(store.metadata(), root, model, now))

    files, rules = find_files(spark, root, **discovery)
    found = cut_lineage(files)
    walked = found.filter("selected").select("path")
    # Files below a folder that may not be read are unseen, not removed.
    unseen = s.below_folders(store.jobs(), found.filter(F.endswith("path", F.lit("/"))))
    store.append(s.reconcile_changes(store.jobs(), walked.union(unseen).distinct()))
    if reannotate:
        hashes = cut_lineage(_hashes(walked, root))
        store.append(s.reopen_changed(store.jobs(), hashes))

    todo = s.jobs_by_status(store.jobs(), *s.ACTIVE).select(F.col("file_path").alias("path"))
    todo = cut_lineage(todo.join(hashes if reannotate else _hashes(todo, root), "path", "left"))
    if slices is None:
        slices = max(1, -(-todo.count() // FILES_PER_PART))
    run = annotate(
        todo, f"{output_dir}/{log_name}", client_factory, max_retries=max_retries, parallelism=parallelism,
        reader=lambda paths: read_texts(paths, root), slices=slices, max_tokens=max_tokens,
    )
    outcomes = cut_lineage(run.outcomes.join(todo, "path", "left"))

    before = store.jobs().join(outcomes.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    changed = cut_lineage(s.apply_outcomes(before, outcomes))
    store.append(changed)
    write_markdown(
        changed.filter("status = 'complete'").select(F.col("file_path").alias("path"), "final_description"), output_dir
    )
    write_flagged(changed, output_dir)
    report = run_report(store.jobs(), store.metadata(), found, started_at=F.lit(started))
    write_report(report, f"{output_dir}/run_report.md")
    return RunResult(store.jobs(), outcomes, report, rules.names, run.connection_lost)


def status(spark: SparkSession, output_dir: str) -> RunStatus:
    """Metadata, progress table and status breakdown of a run."""
    store = StateStore(spark, f"{output_dir}/state")
    if not store.exists():
        raise FileNotFoundError(f"no run state in {output_dir}")
    jobs = store.jobs()
    return RunStatus(store.metadata(), status_table(jobs), detailed_status(jobs))
