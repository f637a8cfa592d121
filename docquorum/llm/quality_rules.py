"""Line-first cleaning: every line is judged, failed lines go, and a document that loses too much goes whole.

Only DataFrame expressions are used. All work on a text stays in its row, so a source or a group of copies of any
size costs no shuffle at all.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import count_matches, words

# Navigation and boilerplate phrases condemn lines of up to twelve words.
SYMBOLS = "[#*$%&|<>]"
PAUSES = "[.,;:!?…]"
NAVIGATION = (
    "home", "next", "previous", "back to top", "skip to content", "read more", "click here", "sign in", "log in",
    "sign up", "subscribe", "share this", "menu", "search", "site map", "contact us",
)
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie", "javascript",
    "lorem ipsum", "powered by", "unsubscribe", "copyright ©", "\\(c\\) copyright",
)
NAVIGATION_LINE = f"^[^\\p{{L}}]*({'|'.join(NAVIGATION)})[^\\p{{L}}]*$"
RULES = ("symbols", "shouting", "navigation", "boilerplate", "repetition", "punctuation")


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; shares are in hundredths.

    :param symbol_share: symbols per word above which a line is markup, a table or noise
    :param shout_share: exclamation marks per word above which a line of ``min_words`` or more is shouting
    :param repeat_share: share of distinct words below which a line of ``long_words`` or more only repeats itself
    :param min_words: shorter lines are not judged by shouting
    :param long_words: from here on a line must hold some punctuation
    :param lost_share: a document that loses more of its words than this is rejected
    """

    symbol_share: int = 25
    shout_share: int = 50
    repeat_share: int = 25
    min_words: int = 3
    long_words: int = 40
    lost_share: int = 50


def tokenised_lines(text: Column) -> Column:
    """The lines of a text with their words."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), words(x).alias("tokens")))


def measured_lines(lines: Column, rules: LineRules = LineRules()) -> Column:
    """From ``tokenised_lines``: each line with the counts that the rules look at."""
    return F.transform(lines, lambda x: F.struct(
        x["line"].alias("line"), F.size(x["tokens"]).cast("long").alias("n"),
        F.when(F.size(x["tokens"]) >= rules.long_words, F.size(F.array_distinct(x["tokens"]))).alias("distinct"),
        F.when(F.size(x["tokens"]) <= 12, F.lower(x["line"])).alias("short"),
        F.when(x["line"].rlike(SYMBOLS), count_matches(x["line"], SYMBOLS)).otherwise(0).alias("symbols"),
        F.when(F.contains(x["line"], F.lit("!")), count_matches(x["line"], "!")).otherwise(0).alias("bangs"),
        F.when(F.size(x["tokens"]) >= rules.long_words, x["line"].rlike(PAUSES)).alias("pauses"),
    ))


def line_failure(x: Column, rules: LineRules = LineRules()) -> Column:
    """Name of the first rule a measured line breaks, or null. A line without words breaks none."""
    n = x["n"]
    return (
        F.when(n == 0, F.lit(None).cast("string"))
        .when(100 * x["symbols"] > rules.symbol_share * n, "symbols")
        .when((n >= rules.min_words) & (100 * x["bangs"] > rules.shout_share * n), "shouting")
        .when(x["short"].rlike(NAVIGATION_LINE), "navigation")
        .when(x["short"].rlike("|".join(BOILERPLATE)), "boilerplate")
        .when((n >= rules.long_words) & (100 * x["distinct"] < rules.repeat_share * n), "repetition")
        .when((n >= rules.long_words) & ~x["pauses"], "punctuation")
    )


def window_hashes(tokens: Column) -> Column:
    """64-bit hashes of all 3-word windows in their order; only equality within one text counts."""
    n = F.greatest(F.size(tokens), F.lit(1))
    triples = F.arrays_zip(tokens.alias("a"), F.slice(tokens, 2, n).alias("b"), F.slice(tokens, 3, n).alias("c"))
    return F.transform(
        F.slice(triples, 1, F.greatest(n - 2, F.lit(0))), lambda w: F.xxhash64(w["a"], w["b"], w["c"]))


def sorted_windows(hashes: Column) -> Column:
    """The windows with their positions, equal ones side by side; empty where all differ."""
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("text"), i.alias("at")))
    return F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(placed)
    ).otherwise(F.slice(placed, 1, 0))


def repeated_words(ordered: Column) -> Column:
    """Number of words inside a 3-word window that occurs twice or more, from ``sorted_windows``.

    Each window is compared with its neighbour in the sorted order alone.
    """
    twins = F.zip_with(
        ordered, F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))),
        lambda left, right: F.when(left["text"] == right["text"], F.array(left["at"], right["at"])),
    )
    covered = F.transform(F.flatten(F.array_compact(twins)), lambda p: F.array(p, p + 1, p + 2))
    return F.size(F.array_distinct(F.flatten(covered))).cast("long")


def clean(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Judge every document; all columns stay, in a column ``quality`` the findings are added.

    ``quality`` is a struct: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed`` (under 50 words, or over half of them in repeated windows), ``n_lines`` (lines with words),
    ``failed`` (number of failed lines by rule), ``clean_text`` (the lines that stay, in order), ``kept_words`` and
    ``kept``.

    A null or empty text has no words: counts are 0, ``base_failed`` is true and ``clean_text`` is empty. Repeated
    rows are judged alike. Columns of the input named ``quality`` or ``quality_...`` may be replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    tokens, lines, windows = F.col("quality_tokens"), F.col("quality_lines"), F.col("quality_windows")
    failures, worded, stay = F.col("quality_failures"), F.col("quality_worded"), F.col("quality_stay")
    # Arrays that several expressions need are columns of their own, or they would be built again for each.
    staged = (
        docs.withColumns({
            "quality_cut": tokenised_lines(t),
        })
        .withColumns({
            "quality_tokens": F.flatten(F.transform(F.col("quality_cut"), lambda x: x["tokens"])),
            "quality_lines": F.transform(measured_lines(F.col("quality_cut"), rules), lambda x: F.struct(
                x["line"].alias("line"), x["n"].alias("n"), x["symbols"].alias("symbols"),
                line_failure(x, rules).alias("failure"),
            )),
        })
        .withColumns({"quality_hashes": window_hashes(tokens)})
        .withColumns({
            "quality_windows": sorted_windows(F.col("quality_hashes")),
            "quality_failures": F.array_compact(F.transform(lines, lambda x: x["failure"])),
            "quality_worded": F.transform(F.filter(lines, lambda x: x["n"] > 0), lambda x: x["line"]),
            "quality_stay": F.filter(lines, lambda x: x["failure"].isNull()),
        })
        .withColumns({
            "quality_n_words": F.size(tokens).cast("long"),
            "quality_n_repeats": repeated_words(windows),
            "quality_kept_words": _total(F.transform(stay, lambda x: x["n"])),
        })
    )
    n, repeats, kept_words = F.col("quality_n_words"), F.col("quality_n_repeats"), F.col("quality_kept_words")
    base_failed = (n < 50) | (100 * repeats > 50 * n)
    judged = staged.withColumn("quality", F.struct(
        n.alias("n_words"),
        F.char_length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
        _total(F.transform(lines, lambda x: x["symbols"])).alias("n_symbols"),
        (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        F.size(worded).cast("long").alias("n_lines"),
        F.struct(*[
            F.size(F.filter(failures, _is(rule))).cast("long").alias(rule) for rule in RULES
        ]).alias("failed"),
        F.array_join(F.transform(stay, lambda x: x["line"]), "\n").alias("clean_text"),
        kept_words.alias("kept_words"),
        (~base_failed & (100 * kept_words >= (100 - rules.lost_share) * n)).alias("kept"),
    )).drop(*(c for c in staged.columns if c.startswith("quality_") and c not in docs.columns))
    # A filter on the findings must not be pushed into the steps above, which would repeat them inside its condition.
    return judged.observe(f"quality-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("judged"))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda total, x: total + x)


def _is(rule: str):
    return lambda failure: failure == rule
