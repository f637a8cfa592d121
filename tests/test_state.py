"""Job table, reconciliation, metadata, snapshots and reports."""

import json

import pytest
from rows import column
from pyspark.sql import functions as F

from docquorum.operators import report as r
from docquorum.operators import state as s
from docquorum.sources.state_store import StateStore


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def jobs(spark, *rows):
    """Jobs from (path, status, {field: value})."""
    names = [f.strip().split(" ")[0] for f in s.JOB_DDL.split(",")]
    full = []
    for path, status, *more in rows:
        fields = {"file_path": path, "status": status, "retry_count": 0, **(more[0] if more else {})}
        full.append(tuple(fields.get(n) for n in names))
    return spark.createDataFrame(full, s.JOB_DDL)


def statuses(df):
    return {row["file_path"]: row["status"] for row in df.collect()}


def test_add_jobs_is_insert_if_absent(spark):
    start = jobs(spark, ("a", "complete"), ("gone", "removed"))
    added = s.add_jobs(start, paths(spark, "a", "b", "b", "gone"))
    assert statuses(added) == {"a": "complete", "b": "pending", "gone": "removed"} and added.count() == 3
    assert added.columns == start.columns and added.schema["retry_count"].dataType.simpleString() == "int"


def test_updates_keep_absent_fields(spark):
    start = jobs(spark, ("a", "pending", {"error_log": "old", "retry_count": 2}), ("b", "pending"))
    updates = spark.createDataFrame([("a", "pass1_done", '{"x": 1}'), ("nobody", "error", None)], "file_path string, status string, pass1_result string")
    rows = {x["file_path"]: x for x in s.apply_updates(start, updates).collect()}
    assert (rows["a"]["status"], rows["a"]["pass1_result"], rows["a"]["error_log"], rows["a"]["retry_count"]) == ("pass1_done", '{"x": 1}', "old", 2)
    assert rows["a"]["updated_at"] is not None and rows["b"]["updated_at"] is None and set(rows) == {"a", "b"}


def test_updates_are_validated(spark):
    start = jobs(spark, ("a", "pending"))
    with pytest.raises(Exception, match="Invalid status"):
        s.apply_updates(start, spark.createDataFrame([("a", "bogus")], "file_path string, status string")).collect()
    with pytest.raises(ValueError, match="Unknown field"):
        s.apply_updates(start, spark.createDataFrame([("a", "error", 1)], "file_path string, status string, colour int"))


def test_latest_of_repeated_updates_wins(spark):
    start = jobs(spark, ("a", "pending"))
    updates = spark.createDataFrame([("a", "retry_1", i) for i in range(500)] + [("a", "complete", 999)], "file_path string, status string, seq int")
    assert statuses(s.apply_updates(start, updates.repartition(5), order="seq")) == {"a": "complete"}


def test_lookups_and_resume_order(spark):
    rows = [("q", "quorum_fail"), ("p1", "pass1_done"), ("z", "pending"), ("a", "pending"), ("c", "complete"), ("r3", "retry_3"), ("qp", "quorum_pass")]
    table = jobs(spark, *rows)
    assert column(s.resumable_jobs(table), "file_path") == ["a", "z", "p1", "q", "r3", "qp"]
    assert column(s.get_job(table, "q"), "status") == ["quorum_fail"] and s.get_job(table, "no").isEmpty()
    assert set(column(s.jobs_by_status(table, "complete", "retry_3"), "file_path")) == {"c", "r3"}


@pytest.mark.parametrize("revive, back", [(False, "removed"), (True, "pending")])
def test_reconcile(spark, revive, back):
    start = jobs(spark, ("kept", "complete"), ("lost", "pending"), ("back", "removed"), ("away", "removed"))
    walked = paths(spark, "kept", "new", "new", "back")
    expected = {"kept": "complete", "lost": "removed", "back": back, "away": "removed", "new": "pending"}
    once = s.reconcile(start, walked, revive)
    assert statuses(once) == expected and once.count() == 5
    assert statuses(s.reconcile(once, walked, revive)) == expected
    changes = statuses(s.reconcile_changes(start, walked, revive))
    assert changes == {k: v for k, v in expected.items() if statuses(start).get(k) != v}
    assert set(column(s.new_files(start, walked), "file_path")) == {"new", "back"}
    assert column(s.removed_files(start, walked), "file_path") == ["lost"]
    assert set(column(s.tracked_paths(start), "file_path")) == {"kept", "lost"}


def test_mark_removed(spark):
    table = s.mark_removed(jobs(spark, ("a", "pending"), ("b", "complete")), paths(spark, "a", "a", "x"))
    assert statuses(table) == {"a": "removed", "b": "complete"}


def test_metadata(spark):
    meta = spark.createDataFrame([], s.METADATA_DDL)
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        meta = s.upsert_metadata(meta, s.run_started(meta, f"/repo/{day}", "m", F.lit(day).cast("timestamp")))
    found = {x["key"]: x["value"] for x in meta.collect()}
    assert found == {
        "repo_path": "/repo/2024-01-01", "model": "m", "started_at": "2024-01-01T00:00:00Z", "last_resumed_at": "2024-01-03T00:00:00Z",
    }
    assert s.get_metadata(meta, "model").first()[0] == "m" and s.get_metadata(meta, "none").isEmpty()


def test_state_store(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "state"))
    assert not store.exists() and store.version() == 0 and store.jobs().isEmpty()
    store.commit(jobs(spark, ("a", "pending"), ("b", "pending")))
    store.append(jobs(spark, ("a", "complete"), ("c", "pending")))
    store.append(jobs(spark, ("c", "error")))
    expected = {"a": "complete", "b": "pending", "c": "error"}
    assert statuses(store.jobs()) == expected and store.version() == 3 and store.exists()
    # An unfinished commit is not read, and its number is not used again.
    store.append(jobs(spark, ("a", "removed")))
    (tmp_path / "state" / "jobs" / "delta-00000004" / "_SUCCESS").unlink()
    assert statuses(store.jobs()) == expected
    assert store.compact() == 5 and statuses(store.jobs()) == expected
    times = [F.lit(f"2024-01-0{d}").cast("timestamp") for d in (1, 2)]
    for now in times:
        store.set_metadata(s.run_started(store.metadata(), "/r", "m", now))
    assert {x["key"] for x in store.metadata().collect()} == {"repo_path", "model", "started_at", "last_resumed_at"}


def test_counts_and_percentages(spark):
    table = jobs(spark, *[(f"c{i}", "complete", {"retry_count": i % 2}) for i in range(14)], ("f", "flagged"), ("r", "removed"))
    counts = r.total_counts(table).first().asDict()
    assert counts == {"total": 16, "completed": 14, "flagged": 1, "errors": 0, "removed": 1, "in_progress": 0}
    shares = r.progress_percentages(table).first()
    assert (shares["completed_pct"], shares["flagged_pct"]) == (87.5, 6.3)
    assert {x["retry_count"]: x["files"] for x in r.retry_histogram(table).collect()} == {0: 7, 1: 7}
    rows = [tuple(x)[1:] for x in r.status_table(table).orderBy("position").collect()]
    assert rows[0] == ("Completed", 14, "87.5%") and rows[2] == ("Flagged", 1, "6.3%") and rows[-1] == ("Total", 16, "")
    assert all(x["percentage"] in ("—", "") for x in r.status_table(table.limit(0)).collect())
    assert [x["status"] for x in r.detailed_status(table).collect()] == ["complete", "flagged", "removed"]


@pytest.mark.parametrize("begin, end, text", [
    ("2024-01-01T00:00:00+00:00", "2024-01-01T02:30:00+00:00", "2h 30m"),
    ("2024-01-01T00:00:00+00:00", "2024-01-01T02:05:59+00:00", "2h 05m"),
    ("2024-01-01T00:00:00", "2024-01-01T00:45:30.5", "45m"),
    ("2024-01-01T00:00:00+02:00", "2024-01-01T00:00:00+00:00", "2h 00m"),
    ("2024-01-01", "2024-01-02", "24h 00m"),
    ("unknown", "2024-01-01T00:00:00", "unknown"),
    ("2024-01-01T00:00:00", "2024-01-01T00:00:00Z", "unknown"),
    (None, "2024-01-01T00:00:00Z", "unknown"),
])
def test_durations(spark, begin, end, text):
    row = spark.createDataFrame([(begin, end)], "a string, b string")
    assert row.select(r.format_duration(F.col("a"), F.col("b"))).first()[0] == text


def test_summaries(spark):
    rows = [
        (json.dumps({"disagreements": ["a", "b", "c", "d"]}), "log"), (json.dumps({"disagreements": []}), "x" * 150),
        ("broken", "log"), (None, ""), (None, None),
    ]
    table = spark.createDataFrame(rows, "quorum_result string, error_log string").coalesce(1)
    found = column(table.select(r.disagreement_summary(F.col("quorum_result"), F.col("error_log")).alias("s")), "s")
    assert found == ["a; b; c", "x" * 100, "log", r.NO_DETAILS, r.NO_DETAILS]


def test_run_report(spark):
    table = jobs(
        spark, ("a", "complete"), ("b", "complete", {"retry_count": 1}),
        ("z", "flagged", {"error_log": "late"}), ("c", "flagged", {"quorum_result": '{"disagreements": ["p", "q"]}'}),
    )
    started = F.lit("2024-01-01 00:00:00").cast("timestamp")
    meta = s.run_started(spark.createDataFrame([], s.METADATA_DDL), "/r", "m", started)
    found = spark.createDataFrame([("x", "binary file"), ("y", None)], "path string, skip_reason string")
    lines = column(r.run_report(table, meta, found, F.lit("2024-01-01T02:30:00Z")).orderBy("section", "position"), "line")
    assert lines[:7] == [
        "# Run Report", "", "- **Repository:** /r", "- **Model:** m", "- **Started:** 2024-01-01T00:00:00Z",
        "- **Completed:** 2024-01-01T02:30:00Z", "- **Duration:** 2h 30m",
    ]
    assert "- Completed (quorum pass): 2 (50.0%)" in lines and "- Skipped (too large / binary): 1" in lines
    assert "- Required 1 retry: 1" in lines and "- Failed all retries: 2" in lines
    assert not any("in progress" in line for line in lines)
    assert lines[-2:] == ["| c | p; q |", "| z | late |"]
    empty = column(r.run_report(table.limit(0), meta.limit(0)).orderBy("section", "position"), "line")
    assert "- Total files: 0" in empty and "- Completed (quorum pass): 0" in empty and "- **Model:** unknown" in empty
    assert "## Flagged Files" not in empty


def test_store_fills_columns_its_caller_does_not_have(spark, tmp_path):
    """Job tables of before a column was added can still be stored and read."""
    store = StateStore(spark, str(tmp_path / "old"))
    old = jobs(spark, ("a", "complete"), ("b", "pending")).drop("content_hash")
    store.commit(old)
    store.append(old.filter("file_path = 'b'").withColumn("status", F.lit("error")).drop("final_description"))
    assert statuses(store.jobs()) == {"a": "complete", "b": "error"}
    assert store.jobs().columns == [f.strip().split(" ")[0] for f in s.JOB_DDL.split(",")]
    assert {r["content_hash"] for r in store.jobs().collect()} == {None}


def test_buckets_and_superseded_folders(spark, tmp_path):
    """Some buckets read alone; folders before the last snapshot but one go; plain folders of earlier stores are read."""
    from docquorum.sources.state_store import BUCKETS, bucket_of

    names = [f"d/f{i}" for i in range(300)]
    store = StateStore(spark, str(tmp_path / "state"))
    jobs(spark, *[(n, "pending") for n in names]).write.parquet(str(tmp_path / "state/jobs/full-00000001"))  # an old store
    store.append(jobs(spark, *[(n, "complete") for n in names[:100]]))
    where = {r["file_path"]: r["b"] for r in paths(spark, *names).toDF("file_path").withColumn("b", bucket_of(F.col("file_path"))).collect()}
    assert set(where.values()) <= set(range(BUCKETS)) and len(set(where.values())) > BUCKETS // 2
    want = {n: "complete" if i < 100 else "pending" for i, n in enumerate(names)}
    some = [where[names[0]], where[names[200]]]
    assert statuses(store.jobs()) == want
    assert statuses(store.jobs(some)) == {n: s_ for n, s_ in want.items() if where[n] in some}
    store.set_metadata(s.run_started(store.metadata(), "/r", "m", F.lit("2024-06-01 12:00:00").cast("timestamp")))
    assert store.compact() == 3 and statuses(store.jobs(some)) == {n: s_ for n, s_ in want.items() if where[n] in some}
    files = store.jobs(some).inputFiles()
    assert files and all(any(f"/bucket={b}/" in f for b in some) for f in files)
    store.append(jobs(spark, (names[5], "flagged")))
    assert statuses(store.jobs([where[names[5]]]))[names[5]] == "flagged"
    assert store.compact() == 5
    left = sorted(p.name for p in (tmp_path / "state/jobs").iterdir() if not p.name.startswith("."))
    assert left == ["delta-00000004", "full-00000003", "full-00000005"]
    assert statuses(store.jobs()) == {**want, names[5]: "flagged"} and store.version() == 5
    assert {r["key"] for r in store.metadata().collect()} == {"repo_path", "model", "started_at"}


def test_jobs_stored_without_a_hash_take_the_present_one(spark):
    """They stay finished; only the next change of their file opens them again."""
    start = jobs(
        spark, ("old", "complete", {"pass1_result": "{}"}), ("same", "complete", {"content_hash": "h"}),
        ("new", "flagged", {"content_hash": "g", "pass1_result": "{}"}), ("gone", "removed"), ("open", "pending"), ("unread", "complete"))
    hashes = spark.createDataFrame(
        [(n, "h") for n in ("old", "same", "new", "gone", "open")] + [("unread", None)], "path string, content_hash string")
    found = {r["file_path"]: (r["status"], r["pass1_result"], r["content_hash"]) for r in s.reopen_changed(start, hashes).collect()}
    assert found == {"old": ("complete", "{}", "h"), "new": ("pending", None, "h")}
