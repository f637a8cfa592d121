"""Removal of runs of lines that occurred before, found by winnowing. DataFrame expressions only.

Let a run be consecutive lines with words (lines without words stand aside) that together hold at least
``min_words`` words. A line goes if it lies in a run that equals an earlier one; earlier means a smaller document, or
a smaller position in the same document. Documents are ordered by ``doc_id`` (null first), then by a hash of the text.

1. *Fingerprints.* From every line starts a shingle: the shortest sequence of whole lines of ``shingle_words`` words.
   From every line also starts a window: the shortest sequence of whole lines of ``min_words`` words. Of the shingles
   inside a window, the one with the smallest hash is its fingerprint. The choice depends on the window's lines
   alone, so two equal runs are guaranteed to select the same fingerprints.
2. *Positions.* Fingerprints are counted over all documents; those that occur once are dropped, by a join of the
   counts with the positions. All that follows only sees the windows that won one of the others.
3. *Extension.* A match reaches from its fingerprint to the right and to the left as far as the lines agree. Each
   maximal repeated run is exactly the union of its windows that start at a line and grow to the right and of those
   that end at a line and grow to the left; both are compared with their first occurrence by content hash.
4. *Deletion.* All lines of a match go unless it is itself the first occurrence.

A line, run or document that occurs millions of times costs its number of occurrences: groups are folded to their
count or first position before they are shuffled, and occurrences are never paired with each other. No text takes part
but in the last join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquorum.session import cut_lineage

from .words import words


def _line_table(text: Column) -> Column:
    """Lines with words: number of the line, hash of its trimmed text, number of words."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(
        i.alias("line"), F.xxhash64(F.btrim(x, F.lit(" \t\x0b\f\r"))).alias("hash"), F.size(words(x)).alias("n"),
    ))
    return F.filter(lines, lambda x: x["n"] > 0)


def _fold(lines: Column, enough: int) -> Column:
    """Length and hash of the shortest beginning of these lines that holds enough words; length 0 if none does."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("hash"), F.lit(0).alias("size"))

    def step(total: Column, x: Column) -> Column:
        return F.when(total["n"] >= enough, total).otherwise(F.struct(
            (total["n"] + x["n"]).alias("n"), F.xxhash64(total["hash"], x["hash"]).alias("hash"),
            (total["size"] + 1).alias("size"),
        ))

    return F.aggregate(lines, start, step, lambda total: F.struct(
        F.when(total["n"] >= enough, total["size"]).otherwise(0).alias("size"), total["hash"].alias("hash")))


def _growing_right(rows: Column, enough: int) -> Column:
    """For each line the shortest run of enough words that starts there."""
    return F.transform(rows, lambda x, i: F.struct(
        i.alias("at"), _fold(F.slice(rows, i + 1, enough), enough).alias("run")))


def _growing_left(rows: Column, enough: int) -> Column:
    """For each line the shortest run of enough words that ends there, with the hash it has when read forwards."""
    ends = F.transform(rows, lambda x, i: F.struct(i.alias("end"), _fold(F.reverse(F.slice(
        rows, F.greatest(i + 2 - enough, F.lit(1)), F.least(i + 1, F.lit(enough)))), enough)["size"].alias("size")))
    return F.transform(F.filter(ends, lambda x: x["size"] > 0), lambda x: F.struct(
        (x["end"] + 1 - x["size"]).alias("at"),
        _fold(F.slice(rows, x["end"] + 2 - x["size"], x["size"]), enough).alias("run"),
    ))


def _windows(docs: DataFrame, min_words: int, shingle_words: int, text: str, doc_id: str) -> DataFrame:
    """One row per window: document, first line and number of lines (lines with words count), hash, fingerprint."""
    # Written first: the folds below look into the array once for each line, and must find it made.
    cut = cut_lineage(docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        _line_table(F.coalesce(F.col(text), F.lit(""))).alias("rows"),
    ))
    rows = F.col("rows")
    held = cut_lineage(cut.select(
        "doc_id", "text_hash", F.transform(rows, lambda x: x["line"]).alias("lines"),
        _growing_right(rows, shingle_words).alias("shingles"),
        F.filter(
            F.array_distinct(F.concat(_growing_right(rows, min_words), _growing_left(rows, min_words))),
            lambda x: x["run"]["size"] > 0,
        ).alias("windows"),
    ).filter(F.size("windows") > 0))

    def inside(window: Column) -> Column:
        candidates = F.slice(F.col("shingles"), window["at"] + 1, window["run"]["size"])
        return F.array_min(F.transform(candidates, lambda s: F.when(
            (s["run"]["size"] > 0)
            & (s["at"] + s["run"]["size"] <= window["at"] + window["run"]["size"]),
            F.struct(s["run"]["hash"].alias("hash"), s["at"].alias("at")),
        )))

    return held.select("doc_id", "text_hash", F.explode(F.transform(F.col("windows"), lambda w: F.struct(
        w["at"].alias("at"), w["run"]["size"].alias("size"), w["run"]["hash"].alias("content"),
        inside(w).alias("fingerprint"),
        F.element_at(F.col("lines"), w["at"] + 1).alias("from"),
        F.element_at(F.col("lines"), w["at"] + w["run"]["size"]).alias("to"),
    ))).alias("w")).select("doc_id", "text_hash", "w.*")


def repeated_lines(docs: DataFrame, min_words: int = 50, shingle_words: int = 25, text: str = "text",
                   doc_id: str = "doc_id") -> DataFrame:
    """Lines that repeat an earlier run: ``doc_id``, ``text_hash``, ``repeated`` (sorted line numbers from 0).

    Only documents that lose a line have a row. Rows with the same ``doc_id`` and text are one document, so a
    repeated row never deletes the other; null and empty texts have no lines and never appear. Where a run overlaps
    its own first occurrence, the lines of that occurrence stay. An empty table gives an empty result. Other columns
    are not looked at. ``min_words`` must be twice ``shingle_words`` or more for the choice of fingerprints to be
    sparse; results are the same for any positive values up to ``min_words``.
    """
    windows = cut_lineage(_windows(docs, min_words, shingle_words, text, doc_id))
    place = F.struct("doc_id", "text_hash", "at", "from", "to")
    found_twice = (
        windows.select(
            F.col("fingerprint.hash").alias("key"),
            F.xxhash64("doc_id", "text_hash", "fingerprint.at").alias("place"))
        .groupBy("key").agg(F.min("place").alias("low"), F.max("place").alias("high"))
        .filter("low < high").select("key")
    )
    positions = windows.withColumn("key", F.col("fingerprint.hash")).join(found_twice, "key", "left_semi")
    first = (
        positions.groupBy("content").agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .filter(F.col("first") < F.col("last")).select("content", "first")
    )
    matches = positions.join(first, "content").filter(place > F.col("first"))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    begin = F.when(own, F.greatest(F.col("from"), F.col("first.to") + 1)).otherwise(F.col("from"))
    spans = matches.select("doc_id", "text_hash", begin.alias("from"), "to").filter(F.col("from") <= F.col("to"))
    return spans.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("from", "to")).alias("spans")
    ).select("doc_id", "text_hash", F.array_sort(F.array_distinct(F.flatten(
        F.transform("spans", lambda s: F.sequence(s["from"], s["to"]))
    ))).alias("repeated"))


def dedup_lines(docs: DataFrame, min_words: int = 50, shingle_words: int = 25, text: str = "text",
                doc_id: str = "doc_id") -> DataFrame:
    """The documents with repeated runs deleted, and ``repeated``: the numbers of the lines that matches cover.

    All rows and columns stay. Lines without words go together with the lines around them: one goes if it lies inside
    a match. A null text stays null and ``repeated`` is empty where nothing is deleted. A column of the input named
    ``repeated`` is replaced.
    """
    gone = repeated_lines(docs, min_words, shingle_words, text, doc_id)
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("repeated").alias("__gone"))
    joined = docs.join(gone, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left")
    lines, dead = F.split(F.col(text), "\n"), F.col("__gone")
    left = F.array_compact(F.transform(
        F.arrays_zip(lines.alias("line"), _marks(dead, F.size(lines)).alias("dead")),
        lambda x: F.when(~x["dead"], x["line"]),
    ))
    kept = joined.withColumn(text, F.when(dead.isNull(), F.col(text)).otherwise(F.array_join(left, "\n")))
    return kept.withColumn("repeated", F.coalesce(dead, F.array().cast("array<int>"))).drop("__id", "__hash", "__gone")


def _marks(numbers: Column, size: Column) -> Column:
    """Array of booleans of this size, true at the given positions, made without a search for each position."""
    gaps = F.zip_with(
        F.concat(F.array(F.lit(-1)), numbers), F.concat(numbers, F.array(size)),
        lambda left, right: F.concat(
            F.array_repeat(F.lit(False), right - left - 1), F.array(F.lit(True))),
    )
    return F.slice(F.flatten(gaps), 1, size)
