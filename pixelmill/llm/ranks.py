"""Gapless ranks inside keys of any size, without a task that holds a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.session import work_table


def dealt(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` range-partitioned by (key, order) and stored, with ``part``, the number of the range, and ``tie``.

    A range never holds more than its share of rows: rows alike in key and order are told apart by ``tie``. The rows
    are read twice (splitters are sampled), so hand in a stored table of narrow rows. The key must not be null.
    """
    told = rows.withColumn("tie", F.monotonically_increasing_id())
    return work_table(told.repartitionByRange(key, *order, "tie").withColumn("part", F.spark_partition_id()), name)


def starts(stored: DataFrame, key: str) -> DataFrame:
    """Per key and range: ``start``, the rows of the key in earlier ranges, and ``key_rows``, those in all."""
    held = stored.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"))
    of_key = Window.partitionBy(key)
    return held.select(
        key,
        "part",
        (F.sum("n").over(of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"),
        F.sum("n").over(of_key).alias("key_rows"),
    )


def numbered(stored: DataFrame, begun: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rank`` (from 0) of every stored row inside its key, beside the columns of ``begun``."""
    inside = Window.partitionBy(key, "part").orderBy(*order, "tie")
    return (
        stored.withColumn("place", F.row_number().over(inside))
        .join(begun, [key, "part"])
        .withColumn("rank", F.col("start") + F.col("place") - 1)
        .drop("place", "start", "part", "tie")
    )


def ranked(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``rank`` inside the key, in ascending order (nulls first), and ``key_rows``."""
    stored = dealt(rows, key, order, name)
    return numbered(stored, starts(stored, key), key, order)
