"""Progress figures and the run report, as tables.

The report is a table of ordered lines, so that its flagged-file part may be any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquorum.functions.jsonx import member, parse_field
from docquorum.operators.state import upsert_metadata

# Fixed value: the summary of a flagged file that left no trace.
NO_DETAILS = "No details available"
REPORTED_KEYS = ("repo_path", "model", "started_at")


def progress(jobs: DataFrame) -> DataFrame:
    """Count by status."""
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def detailed_status(jobs: DataFrame) -> DataFrame:
    return progress(jobs).orderBy("status")


def total_counts(jobs: DataFrame, *more: Column) -> DataFrame:
    """One row: total, completed, flagged, errors, removed, in_progress, and further aggregates."""
    status = F.col("status")
    terminal = {
        "completed": "complete", "flagged": "flagged", "errors": "error", "removed": "removed",
    }
    return jobs.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(status == value).alias(name) for name, value in terminal.items()],
        F.count_if(~status.isin(*terminal.values())).alias("in_progress"),
        *more,
    )


def tenths_of_percent(count: Column, total: Column) -> Column:
    """Share in tenths of a percent, rounded half up on exact integers; null when total is 0."""
    return F.when(total > 0, F.floor((count * 2000 + total) / (total * 2)).cast("bigint"))


def percent(count: Column, total: Column) -> Column:
    return tenths_of_percent(count, total) / F.lit(10.0)


def percent_text(count: Column, total: Column) -> Column:
    return F.when(total > 0, F.format_string("%.1f%%", percent(count, total)))


def status_table(jobs: DataFrame) -> DataFrame:
    """Rows of (position, label, count, percentage); a dash when there are no jobs."""
    counts = total_counts(jobs)
    labels = {
        "completed": "Completed", "in_progress": "In Progress", "flagged": "Flagged",
        "errors": "Errors", "removed": "Removed",
    }
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(label).alias("label"), F.col(name).alias("count"),
            F.coalesce(percent_text(F.col(name), F.col("total")), F.lit("—")).alias("percentage"),
        )
        for i, (name, label) in enumerate(labels.items())
    ]
    rows.append(F.struct(
        F.lit(len(labels)).alias("position"), F.lit("Total").alias("label"),
        F.col("total").alias("count"), F.lit("").alias("percentage"),
    ))
    return counts.select(F.inline(F.array(*rows)))


def progress_percentages(jobs: DataFrame) -> DataFrame:
    """Completed and flagged shares of all jobs, removed ones included."""
    total = F.col("total")
    return total_counts(jobs).select(
        "total", "completed", "flagged", "errors", "in_progress",
        percent(F.col("completed"), total).alias("completed_pct"),
        percent(F.col("flagged"), total).alias("flagged_pct"),
    )


def retry_histogram(jobs: DataFrame) -> DataFrame:
    """Completed jobs by retry count."""
    done = jobs.filter(F.col("status") == "complete")
    return done.groupBy("retry_count").agg(F.count(F.lit(1)).alias("files"))


def disagreement_summary(quorum_result: Column, error_log: Column) -> Column:
    """First three disagreements, else the start of the error text, else a fixed phrase."""
    points = member(parse_field(quorum_result), "$.disagreements", "array<string>")
    return F.coalesce(
        F.when(F.size(points) > 0, F.array_join(F.slice(points, 1, 3), "; ")),
        F.when(error_log != "", F.substring(error_log, 1, 100)),
        F.lit(NO_DETAILS),
    )


def flagged_table(jobs: DataFrame) -> DataFrame:
    """(file_path, summary) of flagged jobs."""
    flagged = jobs.filter(F.col("status") == "flagged")
    return flagged.select(
        "file_path", disagreement_summary(F.col("quorum_result"), F.col("error_log")).alias("summary")
    )


def _instant(text: Column) -> tuple[Column, Column]:
    """(instant, carries an offset) of an ISO-8601 text; zone-less values count as UTC."""
    aware = text.rlike(r"\A.*\d\d:\d\d.*(Z|[+-]\d\d:?\d\d)\z")
    iso = F.when(text.rlike(r"\A\d{4}-\d\d-\d\d"), text)
    return F.when(aware, iso).otherwise(F.concat(iso, _utc_suffix(iso))).try_cast("timestamp"), aware


def _utc_suffix(iso: Column) -> Column:
    return F.when(F.length(iso) > 10, "Z").otherwise("T00:00:00Z")


def format_duration(started: Column, completed: Column) -> Column:
    """``Hh MMm``, or ``Mm`` below an hour; ``unknown`` when either time is unusable."""
    begin, begin_aware = _instant(started)
    end, end_aware = _instant(completed)
    micros = F.unix_micros(end) - F.unix_micros(begin)
    seconds = (micros / F.lit(1_000_000)).cast("bigint")
    hours = F.floor(seconds / F.lit(3600))
    minutes = F.floor(F.pmod(seconds, F.lit(3600)) / F.lit(60))
    text = F.when(hours > 0, F.format_string("%dh %02dm", hours, minutes)).otherwise(
        F.format_string("%dm", minutes)
    )
    return F.coalesce(F.when((begin_aware == end_aware) & seconds.isNotNull(), text), F.lit("unknown"))


def _thousands(count: Column) -> Column:
    return F.format_string("%,d", count)


def _share(count: Column, total: Column) -> Column:
    return F.concat(
        _thousands(count),
        F.coalesce(F.concat(F.lit(" ("), percent_text(count, total), F.lit(")")), F.lit("")),
    )


def _retry_counts() -> list[Column]:
    done = F.col("status") == "complete"
    return [F.count_if(done & (F.col("retry_count") == n)).alias(f"retries_{n}") for n in range(4)]


def run_report(
    jobs: DataFrame, metadata: DataFrame, found: DataFrame | None = None, completed_at: Column | None = None,
    started_at: Column | None = None,
) -> DataFrame:
    """Report lines as (section, position, line), to be read in that order.

    Section 0 holds the figures and has a fixed number of lines. Section 1 holds one line per
    flagged file, positioned by path. `found` is the discovery result behind the skip count.
    `started_at` is the start of this run as ISO text; without it the first start in the metadata counts.
    """
    if completed_at is None:
        completed_at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    latest = upsert_metadata(metadata.filter(F.col("key").isin(*REPORTED_KEYS))).agg(*[
        F.max(F.when(F.col("key") == key, F.col("value"))).alias(key) for key in REPORTED_KEYS
    ])
    parts = total_counts(jobs, *_retry_counts()).unionByName(latest, allowMissingColumns=True)
    if found is not None:
        skipped = found.agg(F.count("skip_reason").alias("skipped"))
        parts = parts.unionByName(skipped, allowMissingColumns=True)
    # The parts are one-row aggregates with disjoint columns; a maximum lines them up.
    figures = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    if found is None:
        figures = figures.withColumn("skipped", F.lit(0).cast("bigint"))
    if started_at is not None:
        figures = figures.withColumn("started_at", started_at)
    return _figure_lines(figures, completed_at).unionByName(_flagged_lines(jobs))


def _figure_lines(figures: DataFrame, completed_at: Column) -> DataFrame:
    total, flagged = F.col("total"), F.col("flagged")
    started = F.coalesce("started_at", F.lit("unknown"))

    def bullet(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"- {label}: "), value)

    def strong(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"- **{label}:** "), value)

    # The wording of the report, in order.
    lines = [
        F.lit("# Run Report"), F.lit(""),
        strong("Repository", F.coalesce("repo_path", F.lit("unknown"))),
        strong("Model", F.coalesce("model", F.lit("unknown"))),
        strong("Started", started),
        strong("Completed", completed_at),
        strong("Duration", format_duration(started, completed_at)),
        F.lit(""), F.lit("## Progress"), F.lit(""),
        bullet("Total files", _thousands(total)),
        bullet("Completed (quorum pass)", _share(F.col("completed"), total)),
        bullet("Flagged", _share(flagged, total)),
        bullet("Skipped (too large / binary)", _thousands(F.col("skipped"))),
        bullet("Errors", _thousands(F.col("errors"))),
        F.when(F.col("in_progress") > 0, bullet("Still in progress", _thousands(F.col("in_progress")))),
        F.lit(""), F.lit("## Quorum Stats"), F.lit(""),
        bullet("First-pass agreement", _thousands(F.col("retries_0"))),
        bullet("Required 1 retry", _thousands(F.col("retries_1"))),
        bullet("Required 2 retries", _thousands(F.col("retries_2"))),
        bullet("Required 3 retries", _thousands(F.col("retries_3"))),
        bullet("Failed all retries", _thousands(flagged)),
        *[
            F.when(flagged > 0, text)
            for text in ("", "## Flagged Files", "", "| File | Disagreement Summary |", "|---|---|")
        ],
    ]
    numbered = figures.select(F.posexplode(F.array(*lines)).alias("n", "line"))
    return numbered.filter(F.col("line").isNotNull()).select(
        F.lit(0).alias("section"), F.format_string("%02d", "n").alias("position"), "line"
    )


def _flagged_lines(jobs: DataFrame) -> DataFrame:
    return flagged_table(jobs).select(
        F.lit(1).alias("section"),
        F.col("file_path").alias("position"),
        F.concat(F.lit("| "), "file_path", F.lit(" | "), "summary", F.lit(" |")).alias("line"),
    )
