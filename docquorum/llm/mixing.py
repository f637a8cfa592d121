"""Mixing of sources to target weights, counted in words. DataFrame expressions only.

Every document gets a random key, a hash of its content. Within each source documents are put in the order of their
keys by a range sort over the whole table, so a source of any size spreads over many tasks. Prefix sums are made of
sums per range and sums inside each range. A source's budget then is a number of whole epochs and a last, partial one
that ends at one key: that cut, one row per source, is all that the documents need to know.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquorum.session import cut_lineage

from .words import n_words


def random_key(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """32 hexadecimal digits from seed, id and text; equal for repeated rows only, the same in every run."""
    return F.md5(F.concat_ws(
        ":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")))))


def _numbered(sources: DataFrame) -> DataFrame:
    """Sources by code point, null last, with ``place`` from 1. The table has one row per source.

    Rows are range-sorted and written once, so that their places can be made from counts per range.
    """
    spark = sources.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut_lineage(
        sources.repartitionByRange(ranges, F.col("source").isNull(), F.col("source"))
        .withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("range").agg(F.count("*").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # one row per range
    inside = Window.partitionBy("range").orderBy(F.col("source").isNull(), "source")
    return ordered.join(starts, "range").withColumn(
        "place", F.col("start") + F.row_number().over(inside)).drop("range", "start")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``source, source_size, target``: shares of the sum of all sizes, by weights that repeat in source order.

    A source's target stops at ``most`` times its size; what is above goes to the others by weight, until none is
    above. The result does not depend on the order of the rounds: a source is capped if its cap per weight lies below
    the level that the uncapped ones reach. Each round is one aggregation that returns three sums.

    :param sizes: one row per source, ``source`` and ``source_size``
    """
    placed = cut_lineage(_numbered(sizes).withColumn("weight", F.element_at(
        F.array(*map(F.lit, weights)), (F.col("place") - 1).cast("int") % len(weights) + 1)))
    cap = most * F.col("source_size")
    level = None
    while True:
        # A cap below level times weight, compared without rounding: cap * divisor < amount * weight.
        capped = F.lit(False) if level is None else (
            cap.cast("decimal(38,0)") * level[1] <= F.lit(level[0]).cast("decimal(38,0)") * F.col("weight"))
        sums = placed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(capped, cap)).alias("capped"),
            F.sum(F.when(~capped, F.col("weight"))).alias("weight"),
        ).first()
        left, weight = (sums["all"] or 0) - (sums["capped"] or 0), sums["weight"] or 0
        if not weight or level == (left, weight):
            break
        level = (left, weight)
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(weight or 1))
    return placed.select("source", "source_size", F.when(capped, cap.cast("double")).otherwise(share).alias("target"))


def cuts(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The plan of a mix, one row per source: ``source, source_size, target, epochs, cut, rest, ties``.

    Documents whose key is smaller than ``cut`` are taken once more than ``epochs`` times. The ``ties`` rows at the
    cut itself, copies of one row, share the ``rest`` of the budget.

    :param sized: ``source, size, key`` of all documents
    """
    spark = sized.sparkSession
    budgets = targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most
    ).withColumn("budget", F.round("target").cast("long")).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    ).withColumn("last", F.col("budget") - F.col("epochs") * F.col("source_size"))
    budgets = cut_lineage(budgets)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_key = sized.groupBy("source", "key").agg(F.sum("size").alias("size"), F.count("*").alias("ties"))
    ordered = cut_lineage(
        by_key.repartitionByRange(ranges, F.col("source"), F.col("key"))
        .withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("source", "range").agg(F.sum("size").alias("sum")).select(
        F.col("source").alias("s"), F.col("range").alias("r"),
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"), "sum")
    # Only the range that holds a source's cut is looked at row by row.
    holding = starts.join(budgets, F.col("s").eqNullSafe(F.col("source"))).filter(
        (F.col("start") <= F.col("last")) & (F.col("last") < F.col("start") + F.col("sum"))
    ).select("s", "r", "start", "last")
    inside = Window.partitionBy("source", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    summed = ordered.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at = summed.join(holding, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).withColumn(
        "rest", F.col("last") - F.col("start") - F.col("inside")
    ).filter((F.col("rest") >= 0) & (F.col("rest") < F.col("size"))).select(
        F.col("s"), F.col("key").alias("cut"), "rest", "ties")
    return budgets.join(at, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "epochs", "cut", F.coalesce("rest", F.lit(0)).alias("rest"),
        F.coalesce("ties", F.lit(1)).alias("ties"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, text: str = "text",
        doc_id: str = "doc_id", source: str = "source", seed: str = "mix") -> DataFrame:
    """All rows and columns, and ``mix``: a struct of ``size, source_size, target, taken`` and ``copies``.

    ``size`` is the number of words, ``taken`` the number of words that the mix takes from the row over all epochs;
    the sum over a source is its target to the nearest word. ``copies`` is ``taken / size``, the epochs of this row;
    the row at a cut has a broken number. A null or empty text has size 0 and nothing is taken. Sources of size 0
    have target 0. Rows without a source form a source of their own. Repeated rows at a cut share its rest, rounded
    down, so that equal rows get equal results. An empty table gives an empty result. A column of the input named
    ``mix`` is replaced.
    """
    key = random_key(F.col(doc_id), F.col(text), seed)
    slim = cut_lineage(docs.select(
        F.col(source).alias("source"), n_words(F.col(text)).alias("size"), key.alias("key")))
    return taken(docs.withColumn("__size", n_words(F.col(text))).withColumn("__key", key),
                 cut_lineage(cuts(slim, weights, most)), source)


def taken(sized: DataFrame, plan: DataFrame, source: str = "source") -> DataFrame:
    """Apply a plan to rows with ``__size`` and ``__key``.

    The plan is a written table of one row per source. Spark sees its size and broadcasts it below its own threshold;
    beyond that the join is a sort-merge join, whose hot sources adaptive execution splits.
    """
    plan = plan.withColumnRenamed("source", "__source")
    size, cut = F.col("__size"), F.col("cut")
    last = F.when(F.col("__key") < cut, size).when(
        F.col("__key") == cut, F.floor(F.col("rest") / F.col("ties"))).otherwise(0)
    words_taken = (F.col("epochs") * size + last).cast("long")
    return sized.join(plan, F.col(source).eqNullSafe(F.col("__source"))).withColumn("mix", F.struct(
        size.alias("size"), F.col("source_size").cast("long").alias("source_size"), "target",
        words_taken.alias("taken"),
        F.when(size > 0, words_taken / size).otherwise(0.0).alias("copies"),
    )).drop("__size", "__key", *plan.columns)
