"""Joins of a large table with a keyed one, safe when one key holds much of the large table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquorum.session import cut_lineage

# Rows of one key that one task may get; a key with more is hot and spread over as many tasks as it fills.
HOT_ROWS = 1_000_000


def hot_keys(big: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, salts) of every key above `hot_rows` rows, with the number of tasks it is spread over."""
    counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= hot_rows)
    return counts.select(key, F.ceil(F.col("rows") / F.lit(hot_rows) + 1).cast("int").alias("salts"))


def spread_join(
    big: DataFrame, keyed: DataFrame, key: str, spread_by: str, how: str = "inner", hot: DataFrame | bool = True,
) -> DataFrame:
    """Join on `key`, unique in `keyed`, with the rows of hot keys spread over tasks.

    Only hot rows of `keyed` are copied, once per salt. Spark broadcasts the list of hot keys if it is small, which
    it is by nature: there are at most as many as the table has rows over `hot_rows`. Pass False when it is known
    that no key is hot.
    """
    if hot is False:
        return big.join(keyed, key, how)
    hot = hot_keys(big, key) if hot is True else hot
    last = F.coalesce("salts", F.lit(1)) - 1
    copied = keyed.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), last))).drop("salts")
    spread = F.pmod(F.xxhash64(spread_by), F.coalesce("salts", F.lit(1))).cast("int")
    salted = big.join(hot, key, "left").withColumn("salt", spread)
    return salted.drop("salts").join(copied, [key, "salt"], how).drop("salt")


def known_hot_keys(big: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | bool:
    """The hot keys of a table that is joined repeatedly, or False when there are none."""
    found = cut_lineage(hot_keys(big, key, hot_rows))
    return False if found.isEmpty() else found
