"""Prompt columns. The wording is ours; the requested JSON fields are the data contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquorum.functions.jsonx import parse_prefix
from docquorum.functions.language import HINTS, detect_language, hint_text

SYSTEM_BEFORE_LANGUAGE = "You document source files for other engineers. Language of this file: "
SYSTEM_AFTER_HINT = """
Report only what the text itself shows. Answer with a single JSON object and nothing else,
using these fields:
- purpose: what the file is for, at most three sentences
- type: one of module, class, script, config, template, test, migration, util, interface, unknown
- language: the language given above
- imports: array of everything imported or included
- exports: array of names offered to other files
- key_classes: array of {name, purpose, methods}
- key_functions: array of {name, purpose}
- dependencies: {imports_from: array of local files or modules, imported_by_hint: likely users}
- language_specific_notes: version or framework idioms
- side_effects: anything that happens on load
- complexity_notes: fragile or intricate parts
"""
JUDGE_SYSTEM = """Below are two descriptions of one file, written independently. Would readers of either one come
away with the same picture: what the file is there for, what kind of file it is, what it does and what it relies on?
Pay no heed to style, order or level of detail, only to statements that cannot both be true or that one lacks altogether.
Answer with a single JSON object and nothing else, using these fields:
- agree: true or false
- merged_result: when they agree, one description keeping the most specific statements of both
- disagreements: array of the points in conflict
- confidence: high, medium or low
"""
PATH_LABEL = "Path: "
PART_LABEL = " (part %d of %d)"
# Rough size of a token in characters, for estimates.
CHARS_PER_TOKEN = 4
TEXT_LABEL = "\nContent:\n```\n"
TEXT_END = "\n```"
FIRST_LABEL = "\nFirst description:\n```json\n"
SECOND_LABEL = "\n```\nSecond description:\n```json\n"


def estimated_tokens(*texts: Column) -> Column:
    """Tokens of texts that are sent together, by their length."""
    length = F.length(texts[0])
    for text in texts[1:]:
        length = length + F.length(text)
    return F.ceil(length / F.lit(CHARS_PER_TOKEN))


def analysis_system(language: Column, hints: dict[str, str] = HINTS) -> Column:
    return F.concat(
        F.lit(SYSTEM_BEFORE_LANGUAGE), language, F.lit("\n"), hint_text(language, hints),
        F.lit(SYSTEM_AFTER_HINT),
    )


def analysis_user(path: Column, text: Column) -> Column:
    return F.concat(F.lit(PATH_LABEL), path, F.lit(TEXT_LABEL), text, F.lit(TEXT_END))


def with_analysis_prompt(files: DataFrame, hints: dict[str, str] = HINTS) -> DataFrame:
    """Add language, system_prompt and user_prompt to (path, text) rows."""
    path, text = F.col("path"), F.col("text")
    return (
        files.withColumn("language", detect_language(path, text))
        .withColumn("system_prompt", analysis_system(F.col("language"), hints))
        .withColumn("user_prompt", analysis_user(path, text))
    )


def _clean(text: Column) -> Column:
    return F.to_json(parse_prefix(text))


def with_judge_prompt(pairs: DataFrame) -> DataFrame:
    """Add system_prompt and user_prompt to rows of (path, pass1, pass2) JSON texts."""
    user = F.concat(
        F.lit(PATH_LABEL), F.col("path"),
        F.lit(FIRST_LABEL), _clean(F.col("pass1")),
        F.lit(SECOND_LABEL), _clean(F.col("pass2")), F.lit(TEXT_END),
    )
    return pairs.withColumn("system_prompt", F.lit(JUDGE_SYSTEM)).withColumn("user_prompt", user)
