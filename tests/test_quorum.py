"""Resolution of response logs, compared with a plain-Python reading of the rules."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from docquorum.operators import quorum as q

LOG = "path string, attempt int, stage string, call_no int, raw string"
PASS = '{"purpose": "%s"}'
AGREE = '{"agree": true, "merged_result": {"purpose": "m"}, "confidence": "high"}'
DISAGREE = '{"agree": false, "disagreements": ["d1", "d2"]}'


def attempt(path, n, pass1=("one",), pass2=("two",), judge=(AGREE,)):
    rows = []
    for stage, replies in (("pass1", pass1), ("pass2", pass2), ("judge", judge)):
        for call, raw in enumerate(replies, 1):
            text = PASS % raw if stage != "judge" and raw.isalnum() else raw
            rows.append((path, n, stage, call, text))
    return rows


def resolve(spark, rows, **kw):
    log = spark.createDataFrame(rows, LOG)
    return {r["path"]: r for r in q.resolve_quorum(log, **kw).collect()}


def test_agreement_at_once(spark):
    row = resolve(spark, attempt("a", 0))["a"]
    assert (row["status"], row["retry_count"], row["error"]) == ("complete", 0, None)
    assert json.loads(row["merged_result"]) == {"purpose": "m"}
    assert json.loads(row["pass1_result"]) == {"purpose": "one"}


def test_disagree_then_agree(spark):
    row = resolve(spark, attempt("a", 0, judge=(DISAGREE,)) + attempt("a", 1, pass1=("later",)))["a"]
    assert (row["status"], row["retry_count"]) == ("complete", 1)
    assert json.loads(row["pass1_result"]) == {"purpose": "later"}


def test_exhausted_retries(spark):
    rows = list(itertools.chain(*[attempt("a", n, pass1=(f"p{n}",), judge=(DISAGREE,)) for n in range(4)]))
    row = resolve(spark, rows)["a"]
    assert (row["status"], row["retry_count"]) == ("flagged", 3)
    assert row["error"] == "Quorum disagreement after 4 attempts"
    assert json.loads(row["pass1_result"]) == {"purpose": "p3"} and row["merged_result"] is None
    capped = resolve(spark, rows, max_retries=1)["a"]
    assert (capped["retry_count"], capped["error"]) == (1, "Quorum disagreement after 2 attempts")


def test_unusable_pass_clears_results(spark):
    rows = attempt("a", 0, judge=(DISAGREE,)) + attempt("a", 1, pass2=("no json 1", "no json 2", "no json 3"), judge=())
    row = resolve(spark, rows)["a"]
    assert (row["status"], row["retry_count"], row["error"]) == ("flagged", 1, "JSON parse failure after 3 attempts")
    assert row["pass1_result"] is None and row["quorum_result"] is None and row["raw_output"] == "no json 3"


def test_judge_without_agree(spark):
    row = resolve(spark, attempt("a", 0, judge=('{"x": 1}', '{"x": 2}', '{"x": 3}')))["a"]
    assert row["error"] == "Quorum judge JSON failure after 3 attempts" and row["raw_output"] == '{"x": 3}'
    ok = resolve(spark, attempt("a", 0, judge=('{"x": 1}', AGREE)))["a"]
    assert ok["status"] == "complete"


@pytest.mark.parametrize("verdict, status, purpose", [
    ('{"agree": 1}', "complete", "one"), ('{"agree": "false"}', "complete", "one"),
    ('{"agree": true, "merged_result": null}', "complete", "one"), ('{"agree": null}', "flagged", None),
    ('{"agree": []}', "flagged", None), ('{"agree": 0}', "flagged", None),
])
def test_truthiness_of_agree(spark, verdict, status, purpose):
    row = resolve(spark, attempt("a", 0, judge=(verdict,)), max_retries=0)["a"]
    assert row["status"] == status
    assert (json.loads(row["merged_result"])["purpose"] if row["merged_result"] else None) == purpose


def test_calls_beyond_budget_are_ignored(spark):
    rows = attempt("a", 0, pass1=("no", "no json", "still no json", "fourth"))
    rows[0] = ("a", 0, "pass1", 1, "not json")
    assert resolve(spark, rows)["a"]["error"] == "JSON parse failure after 3 attempts"


def brute_force(rows, max_retries):
    """The rules read one path at a time."""
    def usable(stage, raw):
        start = raw.find("{")
        try:
            value, _ = json.JSONDecoder().raw_decode(raw, start) if start >= 0 else (None, 0)
        except ValueError:
            return None
        return value if value is not None and (stage != "judge" or "agree" in value) else None

    out = {}
    for path in {r[0] for r in rows}:
        outcome = None
        attempts = sorted({r[1] for r in rows if r[0] == path and r[1] <= max_retries})
        for n in attempts:
            found, failed = {}, None
            for stage in q.STAGES:
                calls = sorted((r[3], r[4]) for r in rows if r[:3] == (path, n, stage) and r[3] <= 3)
                good = [v for v in (usable(stage, raw) for _, raw in calls) if v is not None]
                if not good:
                    failed = stage
                    break
                found[stage] = good[0]
            if failed:
                outcome = ("flagged", n, q.JUDGE_ERROR if failed == "judge" else q.PASS_ERROR, None)
                break
            if found["judge"].get("agree"):
                outcome = ("complete", n, None, found["judge"].get("merged_result") or found["pass1"])
                break
            outcome = ("flagged", max_retries, f"Quorum disagreement after {max_retries + 1} attempts", None)
        out[path] = outcome
    return out


def random_log(seed, paths=40):
    rng = random.Random(seed)
    rows = []
    for p in range(paths):
        for n in range(4):
            for stage in q.STAGES:
                for call in range(1, 5):
                    if stage == "judge":
                        raw = rng.choice([AGREE, DISAGREE, DISAGREE, '{"x": 1}', "nothing", '{"agree": true}'])
                    else:
                        raw = rng.choice([PASS % f"p{p}n{n}{stage}{call}", "nothing", '{"broken": '])
                    rows.append((f"f{p}", n, stage, call, raw))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random_logs_match_the_rules(spark, seed):
    rows = random_log(seed)
    expected = brute_force(rows, 3)
    random.Random(seed).shuffle(rows)
    found = {
        p: (r["status"], r["retry_count"], r["error"], json.loads(r["merged_result"]) if r["merged_result"] else None)
        for p, r in resolve(spark, rows).items()
    }
    assert found == expected


def test_one_path_with_most_of_the_log(spark):
    """Repeated rows of one path change nothing, whatever the partitioning."""
    rows = random_log(9, paths=6)
    log = spark.createDataFrame(rows, LOG)
    hot = log.filter("path = 'f1'").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("copy")
    plain = sorted(map(tuple, q.resolve_quorum(log).collect()), key=str)
    for partitions in (1, 7):
        skewed = q.resolve_quorum(log.unionByName(hot).repartition(partitions))
        assert sorted(map(tuple, skewed.collect()), key=str) == plain


def test_notes_and_labels(spark):
    rows = attempt("a", 0) + attempt("b", 0, judge=(DISAGREE,)) + attempt("b", 1) + attempt("c", 0, pass1=("x y",) * 3)
    outcomes = q.resolve_quorum(spark.createDataFrame(rows, LOG))
    notes = {r["path"]: (r["confidence"], r["retry_note"]) for r in q.confidence_notes(outcomes).collect()}
    assert notes == {"a": ("high", ""), "b": ("high", "[retry 1]")}
    labels = {r["path"]: r["label"] for r in outcomes.select("path", q.failure_label(F.col("error")).alias("label")).collect()}
    assert labels == {"a": None, "b": None, "c": "json_parse_failure"}


def test_texts_are_shuffled_once_and_parsed_once(spark, tmp_path):
    """The bare operator over a stored log: one exchange, one parser."""
    log = spark.createDataFrame([("p", 0, "judge", 1, "{}")], "path string, attempt int, stage string, call_no int, raw string")
    log.write.parquet(str(tmp_path / "log"))
    resolved = q.resolve_quorum(spark.read.parquet(str(tmp_path / "log")))
    plan = resolved._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("parseJson") == 1
