"""A corpus from raw documents to a mix, in stages that are each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.abspath(__file__))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from docquorum.llm import decontaminate, line_dedup, mixing, ngram_join, quality_rules  # noqa: E402
from docquorum.session import configure, cut_lineage  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Where a stage keeps the columns it does not work on, so that none clashes with the operator's own.
OTHERS = "__others"


def _packed(docs: DataFrame, *own: str) -> DataFrame:
    """The named columns as they are, all others in one struct."""
    others = [F.col(c) for c in docs.columns if c not in own]
    packed = F.struct(*others) if others else F.lit(None)
    return docs.select(*(c for c in own if c in docs.columns), packed.alias(OTHERS))


def _unpacked(worked: DataFrame, docs: DataFrame, own: tuple[str, ...], text: F.Column, changed: F.Column) -> DataFrame:
    """The columns of the documents in order, with another text; ``n_chars``, where it is a column, follows a change."""
    kinds, values = dict(docs.dtypes), []
    for name in docs.columns:
        value = F.col(name) if name in own else F.col(f"{OTHERS}.{name}")
        if name == "text":
            value = text
        elif name == "n_chars":
            value = F.when(changed, F.char_length(text).cast(kinds[name])).otherwise(value)
        values.append(value.alias(name))
    return worked.select(*values)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go; documents that the rules reject go. Nulls count as empty and are rejected."""
    configure(spark)
    judged = quality_rules.clean(_packed(docs, "text")).filter("quality.kept")
    return _unpacked(judged, docs, ("text",), F.col("quality.clean_text"), F.lit(True))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of 50 words and more go; a document of which no word is left goes with them."""
    configure(spark)
    deduped = line_dedup.dedup_lines(_packed(docs, "doc_id", "text"))
    hit = F.size("repeated") > 0
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    return _unpacked(deduped.filter(~hit | worded), docs, ("doc_id", "text"), F.col("text"), hit)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that 5-word shingles link at a similarity of 0.8."""
    configure(spark)
    return ngram_join.drop_near_copies(docs, n=5, percent=80).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    benchmark = configure(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes words from, with ``size``, ``source_size``, ``target``, ``taken`` and ``copies``.

    Columns of these names, or named ``mix``, are replaced.
    """
    configure(spark)
    own = ("doc_id", "text", "source")
    mixed = mixing.mix(_packed(docs, *own)).filter("mix.taken > 0")
    figures = ("size", "source_size", "target", "taken", "copies")
    kept = [c for c in docs.columns if c not in (*figures, "mix")]
    return mixed.select(
        *(F.col(c if c in own else f"{OTHERS}.{c}").alias(c) for c in kept), *(f"mix.{c}" for c in figures)
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Winnowing, near copies and retrieval have no SQL of bearable cost; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
