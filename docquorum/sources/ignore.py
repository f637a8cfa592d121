"""Ignore-file rules as regex rows, evaluated inside Spark expressions."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquorum.functions.paths import any_of, glob_body


class IgnoreRule(NamedTuple):
    seq: int
    regex: str
    negated: bool
    dir_only: bool


def _segment(text: str) -> str:
    pieces = text.split("\\")
    regex = glob_body(pieces[0], cross_slash=False)
    for piece in pieces[1:]:
        # A backslash takes the next character literally.
        regex += "\\" + piece[:1] if piece else ""
        regex += glob_body(piece[1:], cross_slash=False)
    return regex


def _rule_regex(pattern: str, dir_only: bool) -> str:
    """Regex over a slash-separated path; directories carry a trailing slash."""
    anchored = "/" in pattern
    segments = pattern.strip("/").split("/")
    regex = "" if anchored else "(?:.+/)?"
    last = len(segments) - 1
    for i, segment in enumerate(segments):
        if segment == "**":
            if i == last:
                return rf"\A{regex}.*\z"
            regex += "(?:.+/)?"
            continue
        regex += "[^/]+" if segment == "*" else _segment(segment)
        if i < last:
            regex += "/"
    tail = "/.*" if dir_only else "(?:/.*)?"
    return rf"\A{regex}{tail}\z"


def ignore_rules(lines: Iterable[str]) -> list[IgnoreRule]:
    """Ordered rules of an ignore file; comments and blank lines are dropped."""
    rules = []
    for line in lines:
        pattern = line.rstrip("\r\n")
        while pattern.endswith(" ") and not pattern.endswith("\\ "):
            pattern = pattern[:-1]
        if not pattern or pattern.startswith("#"):
            continue
        negated = pattern.startswith("!")
        pattern = pattern[1:] if negated else pattern
        dir_only = pattern.endswith("/")
        pattern = pattern[:-1] if dir_only else pattern
        if not pattern.strip("/"):
            continue
        rules.append(IgnoreRule(len(rules), _rule_regex(pattern, dir_only), negated, dir_only))
    return rules


def ignore_table(spark: SparkSession, rules: list[IgnoreRule]) -> DataFrame:
    return spark.createDataFrame(
        [tuple(rule) for rule in rules],
        "seq int, regex string, negated boolean, dir_only boolean",
    )


def _last_match(path: Column, rules: list[IgnoreRule]) -> Column:
    """Verdict of the last matching rule; neighbours of one sign share a regex."""
    verdict = F.lit(False)
    for negated, run in groupby(rules, key=lambda rule: rule.negated):
        regex = "(?s)" + any_of(rule.regex for rule in run)
        verdict = F.when(path.rlike(regex), F.lit(not negated)).otherwise(verdict)
    return verdict


def ignored(path: Column, rules: list[IgnoreRule]) -> Column:
    """True when the file or any directory above it is ignored.

    A rule cannot re-include a file below an ignored directory. Rule regexes cover all that
    lies below a match, so directories need a look of their own only where a rule negates.
    """
    if not any(rule.negated for rule in rules):
        return _last_match(path, rules)
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    parents = F.transform(
        F.sequence(F.lit(1), depth),
        lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")),
    )
    below_ignored = F.when(depth > 0, F.exists(parents, lambda p: _last_match(p, rules)))
    return _last_match(path, rules) | F.coalesce(below_ignored, F.lit(False))
