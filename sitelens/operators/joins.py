"""Joins of rows with a side that has one row per key."""

from pyspark.sql import DataFrame, functions as F


def join_unique(
    rows: DataFrame, unique: DataFrame, on: str, how: str = "inner"
) -> DataFrame:
    """``rows`` joined with ``unique`` (one row per ``on``), ready for hot keys.

    A side that was just reduced per key is already partitioned by that key, so the
    join would read it without a shuffle of its own, and adaptive execution splits a
    hot key only between two plain shuffles.  The hash as a second join column makes
    the (small) reduced side shuffle again, and hot keys of ``rows`` can be split.
    """
    tag = F.xxhash64(on)
    keyed = unique.withColumn("_hash", tag)
    return rows.withColumn("_hash", tag).join(keyed, [on, "_hash"], how).drop("_hash")
