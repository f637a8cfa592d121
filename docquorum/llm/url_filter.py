"""Allow and block lists for web addresses, as a trie over reversed host labels and path segments.

A rule names a host and the beginning of a path. It fits its host and all subdomains where the path of the address
starts with the rule's path. The longest fitting rule wins: first the one with more host labels, then the one with
the longer path; of two equal rules the blocking one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 64 << 20


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; else ''."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Rules by reversed host labels, below each host by path segments.

    A node is a dictionary. Under a label or segment lies the next node, under ``None`` a host node keeps its paths.
    A path node keeps under ``''`` the rules that end inside the next segment: (beginning, rule) pairs, longest first.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in sorted(set(map(Rule._make, rules)), key=lambda r: (r.verdict != "block", r)):
            node = self.root
            for label in reversed(rule.host.lower().split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *segments, rest = rule.path.split("/")
            for segment in segments:
                node = node.setdefault((segment,), {})
            ends = node.setdefault("", {})
            ends.setdefault(rest, rule)  # the blocking rule came first
            node[""] = dict(sorted(ends.items(), key=lambda item: -len(item[0])))

    @staticmethod
    def _longest(paths: dict, segments: list[str]) -> Rule | None:
        best, node = None, paths
        for i, segment in enumerate(segments):
            for beginning, rule in node.get("", {}).items():
                if segment.startswith(beginning):
                    best = rule
                    break
            node = node.get((segment,)) if i + 1 < len(segments) else None
            if node is None:
                return best
        return best

    def match(self, host_name: str, url_path: str) -> Rule | None:
        """The longest rule that fits, or None."""
        segments, best, node = url_path.split("/"), None, self.root
        for label in reversed(host_name.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                best = self._longest(node[None], segments) or best
        return best


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url",
          max_bytes: int = MAX_BYTES) -> DataFrame:
    """All rows and columns, and ``url_filter``: a struct of ``host, path, rule, verdict``.

    ``rule`` is the winning rule as host and path in one, null where none fits; the verdict then is ``default``. A
    null url, or one without ``://``, has an empty host and path, which no rule fits. An empty table gives an empty
    result, repeated rows are judged alike, and a column of the input named ``url_filter`` is replaced.

    The trie is broadcast. Rules of more than ``max_bytes`` of text are cut into several tries, which are broadcast
    and applied one after the other in the same pass; the longest match over all of them wins.
    """
    blocks: list[list[Rule]] = [[]]
    size = 0
    for rule in map(Rule._make, rules):
        size += len(rule.host) + len(rule.path) + 64
        if size > max_bytes and blocks[-1]:
            blocks.append([])
            size = len(rule.host) + len(rule.path) + 64
        blocks[-1].append(rule)
    judged = pages.withColumn("url_filter", F.struct(host(F.col(url)).alias("host"), path(F.col(url)).alias("path")))
    at = F.col("url_filter")
    best = F.lit(None)
    for block in blocks:
        found = _matcher(pages.sparkSession, block)(at["host"], at["path"])
        best = found if len(blocks) == 1 else F.greatest(best, found)
    judged = judged.withColumn("url_filter", F.struct(at["host"].alias("host"), at["path"].alias("path"), best.alias("m")))
    return judged.withColumn("url_filter", F.struct(
        at["host"].alias("host"), at["path"].alias("path"), at["m"]["rule"].alias("rule"),
        F.coalesce(at["m"]["verdict"], F.lit(default)).alias("verdict"),
    ))


def _matcher(spark, rules: list[Rule]):
    trie = spark.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("labels int, length int, blocks boolean, rule string, verdict string")
    def longest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        walk = trie.value.match
        for hosts, paths in batches:
            found = [walk(h, p) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(
                [(r.host.count("."), len(r.path), r.verdict == "block", r.host + r.path, r.verdict) if r
                 else (None,) * 5 for r in found],
                columns=["labels", "length", "blocks", "rule", "verdict"],
            ).astype({"labels": "Int32", "length": "Int32", "blocks": "boolean"})

    return longest
