"""Resolution of a model-response log into one outcome per path.

The log has one row per model call: path, attempt (from 0), stage (pass1, pass2, judge),
call_no (from 1) and the raw reply.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquorum.functions.jsonx import (
    has_key, json_null_as_missing, member, object_text, parse_prefix, store_json, truthy,
)

STAGES = ("pass1", "pass2", "judge")
# Call budget per stage, status names and error texts.
CALLS_PER_STAGE = 3
COMPLETE = "complete"
FLAGGED = "flagged"
PASS_ERROR = f"JSON parse failure after {CALLS_PER_STAGE} attempts"
JUDGE_ERROR = f"Quorum judge JSON failure after {CALLS_PER_STAGE} attempts"
DISAGREEMENT = "Quorum disagreement after %d attempts"


def checked_replies(log: DataFrame, max_retries: int, *more: str) -> DataFrame:
    """Replies within budget with a usability flag, as JSON text where they are usable.

    An unusable reply keeps its raw text, which is reported if its stage fails. A judge's verdict and merged record
    are taken out here, so that no reply is parsed again later. `more` names further columns to keep.
    """
    in_budget = log.filter(
        (F.col("attempt") <= max_retries)
        & (F.col("call_no") <= CALLS_PER_STAGE)
        & F.col("stage").isin(*STAGES)
    )
    # Columns in steps, so that a reply is cut and parsed once.
    cut = in_budget.withColumn("body", object_text(F.col("raw")))
    parsed = cut.withColumn("parsed", parse_prefix(F.col("body")))
    judged = F.col("stage") == "judge"
    usable = parsed.withColumn(
        "usable", F.col("parsed").isNotNull() & (~judged | has_key(F.col("parsed"), "agree"))
    )
    verdict = judged & F.col("usable")
    merged = json_null_as_missing(member(F.col("parsed"), "$.merged_result"))
    return usable.select(
        "path", "attempt", "stage", "call_no", *more, "usable",
        F.when(F.col("usable"), store_json(F.col("parsed"))).otherwise(F.col("raw")).alias("body"),
        F.when(verdict, truthy(member(F.col("parsed"), "$.agree"))).alias("agrees"),
        F.when(verdict, store_json(merged)).alias("merged"),
    )


def is_usable(raw: Column, stage: str) -> Column:
    """Whether a raw reply ends its stage: the rule of `checked_replies`."""
    parsed = parse_prefix(object_text(raw))
    return has_key(parsed, "agree") if stage == "judge" else parsed.isNotNull()


def stage_reply(chosen: Column | None = None) -> Column:
    """First usable reply, else the last unusable one: both are the minimum of one struct."""
    rank = F.when(F.col("usable"), F.col("call_no")).otherwise(
        2 * CALLS_PER_STAGE + 1 - F.col("call_no")
    )
    reply = F.struct(rank.alias("rank"), "body", "usable", "call_no", "agrees", "merged")
    return F.min(reply if chosen is None else F.when(chosen, reply))


def first_usable_replies(log: DataFrame, max_retries: int = 3) -> DataFrame:
    """Per path, attempt and stage: the usable reply with the least call number, as JSON text."""
    best = (
        checked_replies(log, max_retries)
        .groupBy("path", "attempt", "stage")
        .agg(stage_reply().alias("reply"))
        .filter("reply.usable")
    )
    return best.select(
        "path", "attempt", "stage",
        F.col("reply.call_no").alias("call_no"), F.col("reply.body").alias("result"),
    )


def both_passes(log: DataFrame, max_retries: int = 3) -> DataFrame:
    """(path, pass1, pass2) of one attempt's log, as JSON texts, where both passes gave a usable reply."""
    passes = [stage_reply(F.col("stage") == stage).alias(stage) for stage in STAGES[:2]]
    best = checked_replies(log, max_retries).groupBy("path").agg(*passes)
    return best.filter("pass1.usable AND pass2.usable").select(
        "path", F.col("pass1.body").alias("pass1"), F.col("pass2.body").alias("pass2")
    )


def split_paths(verdicts: DataFrame, max_retries: int = 3) -> DataFrame:
    """Paths whose judge disagrees, from one attempt's replies of the judge."""
    best = checked_replies(verdicts, max_retries).groupBy("path").agg(stage_reply(F.col("stage") == "judge").alias("judge"))
    return best.filter(F.col("judge.usable") & ~F.coalesce("judge.agrees", F.lit(False))).select("path")


def _failed_stage(reply: Callable[[str], Column]) -> Column:
    """First stage without a usable reply, null when all have one."""
    return F.coalesce(*[
        F.when(~F.coalesce(reply(stage)["usable"], F.lit(False)), stage) for stage in STAGES
    ])


def _outcome(failed_stage: Column, judge: Column) -> Column:
    return (
        F.when(failed_stage.isNotNull(), "error").when(judge["agrees"], "agree").otherwise("disagree")
    )


def attempt_outcomes(log: DataFrame, max_retries: int = 3) -> DataFrame:
    """One row per path and attempt: the three stage replies and agree, disagree or error.

    Conditional minima pivot the stages inside the aggregate, so repeated log rows are
    folded before the shuffle, however many one path has.
    """
    per_stage = [stage_reply(F.col("stage") == stage).alias(stage) for stage in STAGES]
    attempts = checked_replies(log, max_retries).groupBy("path", "attempt").agg(*per_stage)
    return attempts.withColumn("failed_stage", _failed_stage(F.col)).withColumn(
        "outcome", _outcome(F.col("failed_stage"), F.col("judge"))
    )


def _attempts(max_retries: int) -> list[Column]:
    """Per attempt a struct of the stages' replies, null where nothing was asked: one aggregate by path has them all."""
    attempts = []
    for number in range(max_retries + 1):
        here = F.col("attempt") == number
        replies = [stage_reply(here & (F.col("stage") == stage)) for stage in STAGES]
        asked = F.coalesce(*replies).isNotNull()
        fields = [reply.alias(stage) for stage, reply in zip(STAGES, replies)]
        attempts.append(F.when(asked, F.struct(F.lit(number).alias("attempt"), *fields)))
    return attempts


def resolve_quorum(log: DataFrame, max_retries: int = 3, still_open: bool = False) -> DataFrame:
    """One outcome per path: the first attempt that agreed or failed decides, else flagged.

    Results are JSON texts. A failed stage clears the results and keeps the last raw reply.
    With `still_open` the log may stop early: paths that wait for a stage or a further
    attempt get no outcome yet. Every reply is parsed once, repeated rows are folded where they
    lie, and texts are shuffled once, by path.
    """
    replies = checked_replies(log, max_retries)
    asked = replies.groupBy("path").agg(F.array_compact(F.array(*_attempts(max_retries))).alias("attempts"))

    def judged(a: Column) -> Column:
        failed = _failed_stage(lambda stage: a[stage])
        return F.struct(
            a["attempt"].alias("attempt"), failed.alias("failed_stage"), _outcome(failed, a["judge"]).alias("outcome"),
            *[a[stage].alias(stage) for stage in STAGES],
        )

    known = asked.select("path", F.transform("attempts", judged).alias("attempts"))
    decided = F.filter("attempts", lambda a: a["outcome"] != "disagree")
    chosen = known.select(
        "path", F.coalesce(F.get(decided, F.lit(0)), F.try_element_at("attempts", F.lit(-1))).alias("deciding")
    ).select("path", "deciding.*")
    if still_open:
        waiting = (F.col("outcome") == "disagree") & (F.col("attempt") < max_retries)
        unasked = [(F.col("failed_stage") == s) & F.col(s).isNull() for s in STAGES]
        for condition in unasked:
            waiting = waiting | F.coalesce(condition, F.lit(False))
        chosen = chosen.filter(~waiting)
    return chosen.select(*_outcome_columns(max_retries))


def _outcome_columns(max_retries: int) -> list[Column]:
    outcome, failed_stage = F.col("outcome"), F.col("failed_stage")
    agreed, errored = outcome == "agree", outcome == "error"
    results = {stage: F.when(~errored, F.col(f"{stage}.body")) for stage in STAGES}
    raw = F.coalesce(*[F.when(failed_stage == s, F.col(f"{s}.body")) for s in STAGES])
    error = (
        F.when(errored & (failed_stage == "judge"), JUDGE_ERROR)
        .when(errored, PASS_ERROR)
        .when(~agreed, F.format_string(DISAGREEMENT, F.lit(max_retries + 1)))
    )
    return [
        F.col("path"),
        F.when(agreed, COMPLETE).otherwise(FLAGGED).alias("status"),
        F.when(outcome == "disagree", max_retries).otherwise(F.col("attempt"))
        .cast("int").alias("retry_count"),
        results["pass1"].alias("pass1_result"),
        results["pass2"].alias("pass2_result"),
        results["judge"].alias("quorum_result"),
        F.when(agreed, F.coalesce(F.col("judge.merged"), F.col("pass1.body"))).alias("merged_result"),
        error.alias("error"),
        raw.alias("raw_output"),
    ]


def is_complete(status: Column) -> Column:
    return status == COMPLETE


def is_flagged(status: Column) -> Column:
    return status == FLAGGED


def failure_label(error: Column) -> Column:
    """Kind of failure behind an error text; null when there is none."""
    return (
        F.when(error.isin(PASS_ERROR, JUDGE_ERROR), "json_parse_failure")
        .when(error.startswith("Quorum disagreement"), "quorum_disagreement")
        .when(error.isNotNull(), "api_error")
    )


def confidence_notes(outcomes: DataFrame) -> DataFrame:
    """Confidence and retry remark of each finished path."""
    confidence = member(parse_prefix(F.col("quorum_result")), "$.confidence", "string")
    return outcomes.filter(is_complete(F.col("status"))).select(
        "path",
        F.coalesce(confidence, F.lit("")).alias("confidence"),
        F.when(F.col("retry_count") > 0, F.format_string("[retry %d]", "retry_count"))
        .otherwise("").alias("retry_note"),
    )
