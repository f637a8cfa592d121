"""The live loop with small stand-in clients."""

import json
import os
import sys
import uuid

import pytest
from pyspark import cloudpickle

from docquorum.functions.prompts import JUDGE_SYSTEM
from docquorum.operators import annotate as an
from docquorum.operators import quorum as q

# Workers cannot import this file, so its clients travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

AGREE = json.dumps({"agree": True, "merged_result": {"purpose": "m"}, "confidence": "high"})
DISAGREE = json.dumps({"agree": False, "disagreements": ["x"]})


def files(spark, *names):
    return spark.createDataFrame([(n, f"text of {n}") for n in names], "path string, text string").repartition(2)


def by_path(run):
    return {r["path"]: r for r in run.outcomes.collect()}


def agreeing():
    return lambda system, user: AGREE if system == JUDGE_SYSTEM else '{"purpose": "p"}'


def picky():
    """Behaves by file name: unreadable replies, refused calls, eternal disagreement."""
    def chat(system, user):
        if "refused" in user:
            raise RuntimeError("context too long")
        if system == JUDGE_SYSTEM:
            return DISAGREE if "split" in user else AGREE
        return "no object" if "garbled" in user else '```json\n{"purpose": "p"}\n```'
    return chat


def test_every_kind_of_outcome(spark, tmp_path):
    run = an.annotate(
        files(spark, "fine.py", "split.py", "garbled.py", "refused.py"), str(tmp_path / "log"), picky, max_retries=1, parallelism=3,
    )
    rows = by_path(run)
    assert rows["fine.py"]["status"] == "complete" and json.loads(rows["fine.py"]["merged_result"]) == {"purpose": "m"}
    assert (rows["split.py"]["status"], rows["split.py"]["retry_count"]) == ("flagged", 1)
    assert rows["garbled.py"]["error"] == q.PASS_ERROR and rows["garbled.py"]["raw_output"] == "no object"
    assert (rows["refused.py"]["status"], rows["refused.py"]["error"]) == ("error", "context too long")
    assert not run.connection_lost
    # 3 calls for the agreeing file, 6 for two attempts, 3 for the unreadable one, 1 refused.
    assert run.log.count() == 3 + 6 + 3 + 1


def test_finished_log_is_not_asked_again(spark, tmp_path):
    def forbidden():
        def chat(system, user):
            raise AssertionError("called again")
        return chat

    an.annotate(files(spark, "a", "b"), str(tmp_path / "log"), agreeing)
    again = an.annotate(files(spark, "a", "b"), str(tmp_path / "log"), forbidden)
    assert {r["status"] for r in by_path(again).values()} == {"complete"}
    more = an.annotate(files(spark, "a", "b", "c"), str(tmp_path / "log"), agreeing)
    assert set(by_path(more)) == {"a", "b", "c"} and more.log.count() == 9


def test_sliced_steps(spark, tmp_path):
    """Slicing changes no outcome, and a resumed step asks only for the part it lost."""
    names = [f"f{i}.py" for i in range(9)] + ["split.py"]
    whole = by_path(an.annotate(files(spark, *names), str(tmp_path / "one"), picky, max_retries=1))
    run = an.annotate(files(spark, *names), str(tmp_path / "log"), picky, max_retries=1, slices=3)
    assert by_path(run) == whole and run.log.count() == 9 * 3 + 6
    parts = sorted(p.name for p in (tmp_path / "log" / "attempt=0" / "passes").iterdir())
    assert len(parts) == 3
    # As after a driver that stopped before the last part was finished.
    (tmp_path / "log" / "attempt=0" / "passes" / parts[2] / "_SUCCESS").unlink()
    again = an.annotate(files(spark, *names), str(tmp_path / "log"), picky, max_retries=1, slices=3)
    assert by_path(again) == whole and again.log.count() == 9 * 3 + 6


def test_other_files_of_the_log_are_left_alone(spark, tmp_path):
    an.annotate(files(spark, "split.py"), str(tmp_path / "log"), picky, max_retries=0)
    later = an.annotate(files(spark, "fine.py"), str(tmp_path / "log"), picky, max_retries=2)
    assert set(by_path(later)) == {"fine.py"} and later.log.count() == 3
    assert an.ResponseLog(spark, str(tmp_path / "log")).everything(2).count() == 6


def test_lost_connection_keeps_what_is_done(spark, tmp_path):
    def failing():
        def chat(system, user):
            if "down" in user:
                raise ConnectionError("gone")
            return AGREE if system == JUDGE_SYSTEM else '{"purpose": "p"}'
        return chat

    names = ("a", "down")
    lost = an.annotate(files(spark, *names), str(tmp_path / "log"), failing, parallelism=1, sleep=lambda s: None)
    assert lost.connection_lost and "down" not in by_path(lost)
    back = an.annotate(files(spark, *names), str(tmp_path / "log"), agreeing)
    assert not back.connection_lost
    assert {p: r["status"] for p, r in by_path(back).items()} == {"a": "complete", "down": "complete"}


def test_lost_judge_leaves_the_path_open(spark, tmp_path):
    def no_judge():
        def chat(system, user):
            if system == JUDGE_SYSTEM:
                raise TimeoutError("slow")
            return '{"purpose": "p"}'
        return chat

    lost = an.annotate(files(spark, "a"), str(tmp_path / "log"), no_judge, sleep=lambda s: None)
    assert lost.connection_lost and by_path(lost) == {}
    assert by_path(an.annotate(files(spark, "a"), str(tmp_path / "log"), agreeing))["a"]["status"] == "complete"


def test_backoff_doubles_up_to_a_limit():
    pauses = []

    def down():
        def chat(system, user):
            raise ConnectionError("gone")
        return chat

    caller = an._Caller(down, pauses.append)
    with pytest.raises(an._ConnectionLost):
        caller("s", "u")
    assert pauses == [1, 2, 4, 8]


@pytest.mark.parametrize("raw, stage, usable", [
    ('{"a": 1} x', "pass1", True), ('```json\n{"agree": 1}\n```', "judge", True), ('{"a": 1}', "judge", False),
    ("none", "pass1", False), ('{"a": NaN}', "pass1", False), ('{"a": 1', "pass1", False), ("```x```{}", "pass1", False),
    ('{"a": 1, "a": 2}', "pass2", True),
])
def test_stop_rule_agrees_with_resolution(spark, raw, stage, usable):
    assert an.reply_is_usable(raw, stage) is usable
    log = spark.createDataFrame([("p", 0, stage, 1, raw)], "path string, attempt int, stage string, call_no int, raw string")
    assert q.checked_replies(log, 3).first()["usable"] is usable


def test_needs_exactly_one_source(spark, tmp_path):
    with pytest.raises(ValueError):
        an.annotate(files(spark, "a"), str(tmp_path))


def test_a_client_is_sent_a_bounded_share_at_once(spark, tmp_path, monkeypatch):
    """More requests mean more portions of a step, not more in one task; there are never more clients at once than asked for."""
    monkeypatch.setattr(an, "BYTES_PER_CLIENT", 30_000)
    monkeypatch.setattr(an, "ROWS_PER_FILE", 5)
    bodies = [os.urandom(2_000).hex() for _ in range(120)]  # 4 kB of text each, half of that when compressed
    texts = spark.createDataFrame([(f"f{i}.py", body) for i, body in enumerate(bodies)], "path string, text string")
    sizes = []

    def noting():
        own = uuid.uuid4().hex

        def chat(system, user):
            return AGREE if system == JUDGE_SYSTEM else json.dumps({"purpose": own, "size": len(system) + len(user)})
        return chat

    run = an.annotate(texts, str(tmp_path / "log"), noting, max_retries=0, parallelism=2)
    rows = by_path(run)
    assert len(rows) == 120 and {r["status"] for r in rows.values()} == {"complete"} and run.log.count() == 120 * 3
    parts = sorted((tmp_path / "log" / "attempt=0" / "passes").iterdir())
    assert len(parts) > 3
    for part in parts:
        said = [json.loads(r["raw"]) for r in spark.read.parquet(str(part)).filter("stage = 'pass1'").collect()]
        assert len({s["purpose"] for s in said}) <= 2
        sizes.append(sum(s["size"] for s in said))
    # Before, all 120 files were one job of two tasks.
    assert max(sizes) < sum(sizes) / 3


def test_replay_is_folded_where_the_log_lies(spark, tmp_path, monkeypatch):
    """A replay gives the rows that a client saying the same would, without Python workers and with one shuffle of the log."""
    plans, append = [], an.ResponseLog.append

    def noting(log, attempt, step, rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        append(log, attempt, step, rows)

    monkeypatch.setattr(an.ResponseLog, "append", noting)
    fine = '{"purpose": "p"}'
    said = [
        ("a", "pass1", 1, "none"), ("a", "pass1", 2, fine), ("a", "pass1", 3, "unheard"), ("a", "pass2", 2, fine),
        ("a", "judge", 1, '{"merged_result": 1}'), ("a", "judge", 2, AGREE), ("b", "pass1", 1, "x"), ("b", "pass1", 2, "y"),
        ("b", "pass2", 1, fine), ("c", "pass1", 1, None), ("c", "pass1", 2, None), ("c", "pass1", 2, fine), ("c", "pass2", 1, fine),
        ("c", "judge", 1, DISAGREE), ("elsewhere", "pass1", 1, fine),
    ]
    recorded = spark.createDataFrame(said, "path string, stage string, call_no int, raw string").selectExpr("*", "0 AS attempt")
    run = an.annotate(files(spark, "a", "b", "c", "d"), str(tmp_path / "log"), recorded=recorded, max_retries=0)
    logged = {(r["path"], r["stage"], r["call_no"]): r["raw"] for r in run.log.filter("kind = 'reply'").collect()}
    assert logged == {
        ("a", "pass1", 1): "none", ("a", "pass1", 2): fine, ("a", "pass2", 1): "", ("a", "pass2", 2): fine,
        ("a", "judge", 1): '{"merged_result": 1}', ("a", "judge", 2): AGREE,
        ("b", "pass1", 1): "x", ("b", "pass1", 2): "y", ("b", "pass1", 3): "",
        ("c", "pass1", 1): "None", ("c", "pass1", 2): fine, ("c", "pass2", 1): fine, ("c", "judge", 1): DISAGREE,
        ("d", "pass1", 1): "", ("d", "pass1", 2): "", ("d", "pass1", 3): "",
    }
    assert run.log.count() == len(logged)
    assert {p: (r["status"], r["error"]) for p, r in by_path(run).items()} == {
        "a": ("complete", None), "b": ("flagged", q.PASS_ERROR), "c": ("flagged", q.DISAGREEMENT % 1), "d": ("flagged", q.PASS_ERROR),
    }
    assert all("MapInPandas" not in plan for plan in plans)
    assert plans[0].count("Exchange hashpartitioning") <= 2  # the files and the log
