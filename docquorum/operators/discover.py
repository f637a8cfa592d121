"""Rule-based file selection with a ledger of skipped files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquorum.functions.paths import (
    extension, has_nul, is_binary_name, name_or_path_match, under_directory,
)
from docquorum.sources.ignore import IgnoreRule, ignored
from docquorum.sources.profiles import Rules

# Skip reasons and the default size limit in bytes.
BINARY_REASON = "binary file"
UNREADABLE_REASON = "unable to stat"
EMPTY_REASON = "empty file"
LARGE_REASON = "large file (%,d bytes) — will be chunked"
MAX_FILE_SIZE = 100_000
ALWAYS_PRUNED = ".git"


def out_of_scope(
    path: Column,
    rules: Rules,
    ignore: list[IgnoreRule] = (),
    extra_excludes: Iterable[str] = (),
) -> Column:
    """Paths dropped without a ledger entry: pruned directories, ignored and excluded paths."""
    return (
        under_directory(path, ALWAYS_PRUNED, *rules.exclude_dirs)
        | ignored(path, list(ignore))
        | name_or_path_match(path, *extra_excludes)
    )


def matches_profile(path: Column, rules: Rules) -> Column:
    if rules.all_text:
        return F.lit(True)
    by_name = name_or_path_match(path, *rules.include_patterns)
    if not rules.extensions:
        return by_name
    return extension(path).isin(*rules.extensions) | by_name


def rejection(path: Column, size: Column, content: Column) -> Column:
    """First reason that keeps a file out; null when none applies."""
    return (
        F.when(is_binary_name(path), BINARY_REASON)
        .when(has_nul(content), BINARY_REASON)
        .when(size.isNull(), UNREADABLE_REASON)
        .when(size == 0, EMPTY_REASON)
    )


def discover(
    files: DataFrame,
    rules: Rules,
    ignore: list[IgnoreRule] = (),
    max_file_size: int = MAX_FILE_SIZE,
    extra_excludes: Iterable[str] = (),
    ordered: bool = True,
) -> DataFrame:
    """Selected and skipped files as (path, size, selected, skip_reason).

    `files` holds (path, size, content), content being the bytes or at least their head.
    Rules are constants in the plan, so this is one narrow pass over the scan; only the
    optional sort moves data, and it moves paths, not content. Large files are selected
    and also listed.
    """
    path, size = F.col("path"), F.col("size")
    judged = files.filter(~out_of_scope(path, rules, ignore, extra_excludes)).select(
        "path", "size", rejection(path, size, F.col("content")).alias("rejection")
    )
    in_profile = judged.filter(F.col("rejection").isNotNull() | matches_profile(path, rules))
    large = F.when(size > max_file_size, F.format_string(LARGE_REASON, size))
    found = in_profile.select(
        "path",
        "size",
        F.col("rejection").isNull().alias("selected"),
        F.coalesce("rejection", large).alias("skip_reason"),
    )
    # The small rows are shuffled once before the sort, whose sampling would else scan
    # the content a second time.
    return found.repartition("path").orderBy("path") if ordered else found


def skip_ledger(found: DataFrame) -> DataFrame:
    return found.filter(F.col("skip_reason").isNotNull()).select("path", "skip_reason")


def skip_count(found: DataFrame) -> DataFrame:
    """Length of the ledger; large files count although they are processed."""
    return found.agg(F.count("skip_reason").alias("skipped"))
