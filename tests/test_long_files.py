"""Files over the prompt bound: cutting, asking in parts, merging, continuing."""

import json
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle

from docquorum.functions.prompts import CHARS_PER_TOKEN, JUDGE_SYSTEM, TEXT_END, TEXT_LABEL
from docquorum.operators import annotate as an
from docquorum.operators import long_files as lf
from docquorum.operators import quorum as q
from rows import column

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BOUND = 450


@given(st.text(alphabet="ab\n\U0001f600", max_size=80), st.integers(1, 20))
@settings(max_examples=300, deadline=None)
def test_parts_are_the_text(text, most):
    parts = lf.cut_at_lines(text, most)
    assert "".join(parts) == text and all(len(p) <= most for p in parts) and len(parts) >= 1
    for part, following in zip(parts, parts[1:]):
        # A part ends at its last line end, or holds no line end and is full.
        assert part and (part.endswith("\n") or "\n" not in part and len(part) == most)
        head = (part + following)[:most]
        assert "\n" not in head[len(part):] or part.endswith("\n") is False and "\n" not in part


def files(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


LINES = "".join(f"line {i} of this file\n" for i in range(200))


def test_no_request_above_the_bound(spark):
    texts = {"short.py": "x = 1", "long.py": LINES, "oneline.js": "y" * 5_000, "empty.py": ""}
    rows = lf.bounded_requests(files(spark, **texts), BOUND).orderBy("path", "chunk_no").collect()
    for row in rows:
        assert -(-(len(row["system_prompt"]) + len(row["user_prompt"])) // CHARS_PER_TOKEN) <= BOUND
    for path, text in texts.items():
        own = [r for r in rows if r["path"] == path]
        assert [r["chunk_no"] for r in own] == list(range(len(own))) and {r["n_chunks"] for r in own} == {len(own)}
        assert "".join(r["user_prompt"].split(TEXT_LABEL, 1)[1].removesuffix(TEXT_END) for r in own) == text
        assert all((f"(part {i + 1} of {len(own)})" in r["user_prompt"]) is (len(own) > 1) for i, r in enumerate(own))
    assert sum(r["path"] == "short.py" for r in rows) == 1 < sum(r["path"] == "long.py" for r in rows)


def test_a_bound_that_leaves_no_room(spark):
    rows = lf.bounded_requests(files(spark, **{"long.py": LINES}), 10).collect()
    assert [(r["error"], r["user_prompt"]) for r in rows] == [(lf.NO_ROOM % 10, None)]


def counting():
    """Names the lines it sees; refuses and garbles by file name."""
    def chat(system, user):
        if system == JUDGE_SYSTEM:
            return json.dumps({"agree": True, "confidence": "high"})
        if "refused" in user and "(part 2" in user:
            raise RuntimeError("too hot")
        if "garbled" in user and "(part 2" in user:
            return "nothing usable"
        text = user.split(TEXT_LABEL, 1)[1]
        return json.dumps({
            "purpose": text.split("\n", 1)[0], "imports": ["os"],
            "exports": [w for w in text.split() if w.isdigit() and (w == "1" or int(w) % 20 == 0)],
        })
    return chat


def by_path(run):
    return {r["path"]: r for r in run.outcomes.collect()}


def test_parts_are_merged_before_the_judge(spark, tmp_path):
    rows = files(spark, **{"long.py": LINES, "short.py": "one 1", "refused.py": LINES, "garbled.py": LINES})
    run = an.annotate(rows, str(tmp_path / "log"), counting, max_tokens=BOUND, max_retries=0, parallelism=3)
    done = by_path(run)
    merged = json.loads(done["long.py"]["merged_result"])
    assert done["long.py"]["status"] == "complete" and merged["purpose"] == "line 0 of this file"
    assert merged["exports"] == ["0", "1", *(str(i) for i in range(20, 200, 20))] and merged["imports"] == ["os"]
    assert json.loads(done["short.py"]["merged_result"]) == {"purpose": "one 1", "exports": ["1"], "imports": ["os"]}
    assert (done["refused.py"]["status"], done["refused.py"]["error"]) == ("error", "too hot")
    assert (done["garbled.py"]["status"], done["garbled.py"]["error"]) == ("flagged", q.PASS_ERROR)
    assert done["garbled.py"]["raw_output"] == "nothing usable"
    judged = run.log.filter("stage = 'judge'").collect()
    assert sorted(r["path"] for r in judged) == ["long.py", "short.py"] and {r["n_chunks"] for r in judged} == {1}


def forbidden():
    def chat(system, user):
        raise AssertionError("called again")
    return chat


def losing():
    """Loses its connection at the third part."""
    answer = counting()

    def chat(system, user):
        if "(part 3" in user:
            raise ConnectionError("gone")
        return answer(system, user)
    return chat


def test_a_continued_run_asks_for_missing_parts_only(spark, tmp_path):
    rows, log = files(spark, **{"long.py": LINES}), str(tmp_path / "log")
    first = an.annotate(rows, log, losing, max_tokens=BOUND, parallelism=1, sleep=lambda s: None)
    assert first.connection_lost and by_path(first) == {}
    answered = {r["chunk_no"] for r in first.log.filter("kind = 'reply'").collect()}
    assert answered == {0, 1}

    def second_half():
        answer = counting()

        def chat(system, user):
            assert "(part 1 " not in user and "(part 2 " not in user
            return answer(system, user)
        return chat

    again = an.annotate(rows, log, second_half, max_tokens=BOUND)
    done = by_path(again)["long.py"]
    assert done["status"] == "complete" and len(json.loads(done["merged_result"])["exports"]) == 11
    assert by_path(an.annotate(rows, log, forbidden, max_tokens=BOUND)) == {"long.py": done}
    # Without a bound the finished log still tells the same.
    assert by_path(an.annotate(rows, log, forbidden)) == {"long.py": done}


def wordy():
    def chat(system, user):
        return json.dumps({"purpose": "p " * 2_000})
    return chat


def test_a_judge_prompt_above_the_bound_is_not_sent(spark, tmp_path):
    run = an.annotate(files(spark, **{"a.py": "x"}), str(tmp_path / "log"), wordy, max_tokens=BOUND)
    done = by_path(run)["a.py"]
    assert done["status"] == "error" and done["error"].endswith(f"is over the bound of {BOUND}")


def test_logs_of_before_there_were_parts(spark):
    log = spark.createDataFrame(
        [("a", 0, s, 1, r, None, None) for s, r in (("pass1", "{}"), ("pass2", "{}"), ("judge", '{"agree": true}'))],
        "path string, attempt int, stage string, call_no int, raw string, chunk_no int, n_chunks int")
    assert column(q.resolve_quorum(lf.merge_part_replies(log, 3)), "status") == ["complete"]


def test_a_bound_needs_a_client(spark, tmp_path):
    with pytest.raises(ValueError):
        an.annotate(files(spark, a="x"), str(tmp_path), recorded=files(spark, a="x"), max_tokens=5)
