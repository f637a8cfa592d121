"""Whole runs over a small tree with stand-in clients."""

import json
import sys

import pytest
from pyspark import cloudpickle

from docquorum import runs
from docquorum.functions.prompts import JUDGE_SYSTEM

cloudpickle.register_pickle_by_value(sys.modules[__name__])

AGREE = json.dumps({"agree": True, "merged_result": {"purpose": "m", "type": "module"}, "confidence": "high"})


def client():
    def chat(system, user):
        if system == JUDGE_SYSTEM:
            return '{"agree": false, "disagreements": ["purpose"]}' if "odd.py" in user else AGREE
        return '{"purpose": "p"}'
    return chat


def forbidden():
    def chat(system, user):
        raise AssertionError("asked again")
    return chat


def statuses(result):
    return {r["file_path"]: r["status"] for r in result.jobs.collect()}


def test_run_resume_and_changes(spark, tmp_path):
    root, out = tmp_path / "repo", tmp_path / "out"
    (root / "lib").mkdir(parents=True)
    for name in ("setup.py", "main.py", "lib/odd.py"):
        (root / name).write_text("x = 1\n")
    (root / "skip.png").write_bytes(b"x")
    first = runs.analyze(spark, str(root), str(out), client, model="m", max_retries=1)
    assert first.profiles == ["config", "devops", "python", "web"]
    assert statuses(first) == {"setup.py": "complete", "main.py": "complete", "lib/odd.py": "flagged"}
    assert (out / "files/main.py.md").read_text().startswith("# main.py\n\n**Type:** module")
    assert json.loads((out / "flagged/lib/odd.py.json").read_text())["retry_count"] == 1
    lines = [r["line"] for r in first.report.collect()]
    assert "- Flagged: 1 (33.3%)" in lines and "- Skipped (too large / binary): 1" in lines

    again = runs.analyze(spark, str(root), str(out), forbidden)
    assert statuses(again) == statuses(first) and again.outcomes.isEmpty()

    (root / "new.py").write_text("y = 2\n")
    (root / "main.py").unlink()
    third = runs.analyze(spark, str(root), str(out), client)
    assert statuses(third) == {"setup.py": "complete", "main.py": "removed", "lib/odd.py": "flagged", "new.py": "complete"}
    seen = runs.status(spark, str(out))
    assert {r["key"]: r["value"] for r in seen.metadata.collect()}["model"] == "m"
    assert {r["label"]: r["count"] for r in seen.progress.collect()} == {
        "Completed": 2, "In Progress": 0, "Flagged": 1, "Errors": 0, "Removed": 1, "Total": 4,
    }


def test_unreadable_file_is_an_error(spark, tmp_path, monkeypatch):
    root, out = tmp_path / "repo", tmp_path / "out"
    root.mkdir()
    (root / "a.py").write_text("x\n")
    (root / "gone.py").write_text("x\n")
    read = runs.read_texts

    def read_late(paths, folder):
        (root / "gone.py").unlink(missing_ok=True)
        return read(paths, folder)

    monkeypatch.setattr(runs, "read_texts", read_late)
    result = runs.analyze(spark, str(root), str(out), client, all_text_files=True)
    rows = {r["file_path"]: r for r in result.jobs.collect()}
    assert rows["a.py"]["status"] == "complete" and rows["gone.py"]["status"] == "error"
    assert "No such file" in rows["gone.py"]["error_log"]


def test_status_needs_a_run(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        runs.status(spark, str(tmp_path))


def lost_at_the_judge():
    def chat(system, user):
        if system == JUDGE_SYSTEM:
            raise ConnectionError("gone")
        return '{"purpose": "old"}' if "old text" in user else '{"purpose": "new"}'
    return chat


def echoing():
    def chat(system, user):
        purpose = "new" if "new text" in user or '"new"' in user else "old"
        if system == JUDGE_SYSTEM:
            return json.dumps({"agree": True, "merged_result": {"purpose": purpose}, "confidence": "high"})
        return json.dumps({"purpose": purpose})
    return chat


def test_changed_file_is_asked_about_anew(spark, tmp_path, monkeypatch):
    root, out = tmp_path / "repo", tmp_path / "out"
    root.mkdir()
    (root / "setup.py").write_text("old text\n")
    monkeypatch.setattr("docquorum.operators.annotate.CONNECTION_TRIES", 1)
    monkeypatch.setattr("docquorum.operators.annotate.BACKOFF_FIRST", 0)
    first = runs.analyze(spark, str(root), str(out), lost_at_the_judge, parallelism=1)
    assert first.connection_lost and statuses(first)["setup.py"] != "complete"

    (root / "setup.py").write_text("new text\n")
    resumed = runs.analyze(spark, str(root), str(out), echoing)
    assert json.loads(resumed.jobs.first()["final_description"]) == {"purpose": "new"}

    (root / "setup.py").write_text("old text\n")
    again = runs.analyze(spark, str(root), str(out), echoing)
    assert json.loads(again.jobs.first()["final_description"]) == {"purpose": "old"}
    unchanged = runs.analyze(spark, str(root), str(out), forbidden)
    assert statuses(unchanged) == {"setup.py": "complete"} and unchanged.outcomes.isEmpty()
