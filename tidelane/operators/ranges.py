"""Ordered work over series of any length: rows in ranges of (keys, order), and what one range hands to the next.

A window over a series is one task's work, however long the series is. Here rows are range-partitioned by sampled
splitters, so that a series lies in as many ranges as it needs; windows run inside a range, every range sums itself
up in one row, and what a range has before it is a window over those rows. Ranges are written, so that every reader
sees the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import stage

RANGE = "_range"


def ranged(rows: DataFrame, keys: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """The rows with the number of their range, which rises with the order inside each key. Rows of equal order are in
    one range."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(rows.repartitionByRange(n, *keys, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def inside(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys, RANGE).orderBy(*order)


def so_far(keys: list[str], order: list[str]) -> WindowSpec:
    return inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def earlier(keys: list[str]) -> WindowSpec:
    """Over one row for each range: all ranges of the key before it."""
    return Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def joined(parts: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what is known of their range. Keys may be null."""
    s = summary.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, RANGE])], *[c for c in summary.columns if c not in (*keys, RANGE)])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, RANGE])]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return parts.join(s, condition, "left").drop(*[f"_k{i}" for i in range(len(keys) + 1)])


def with_previous(parts: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """Adds, under new names, columns of the row before, in whichever range that is."""
    value = F.struct(*columns.values())
    at = F.struct(*order)
    ends = parts.groupBy(*keys, RANGE).agg(F.max_by(value, at).alias("_range_end"))
    before = ends.select(*keys, RANGE, F.last("_range_end", ignorenulls=True).over(earlier(keys)).alias("_range_before"))
    rows = joined(parts.withColumn("_range_lag", F.lag(value).over(inside(keys, order))), before, keys)
    return rows.withColumns({new: F.coalesce(F.col("_range_lag"), F.col("_range_before"))[old] for new, old in columns.items()}).drop("_range_lag", "_range_before")


def running_count(parts: DataFrame, keys: list[str], order: list[str], flag: Column, name: str) -> DataFrame:
    """Adds how many rows of the key, up to this one, have the flag."""
    marked = parts.withColumn("_range_flag", flag)
    before = marked.groupBy(*keys, RANGE).agg(F.count_if("_range_flag").alias("_range_n"))
    before = before.select(*keys, RANGE, F.coalesce(F.sum("_range_n").over(earlier(keys)), F.lit(0)).alias("_range_below"))
    rows = joined(marked.withColumn("_range_here", F.count_if("_range_flag").over(so_far(keys, order))), before, keys)
    return rows.withColumn(name, F.col("_range_here") + F.col("_range_below")).drop("_range_flag", "_range_here", "_range_below")


def carried(parts: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the last known value up to this row. The order has to tell the rows of a key apart."""
    ends = parts.where(F.col(value).isNotNull()).groupBy(*keys, RANGE).agg(F.max_by(value, F.struct(*order)).alias("_range_end"))
    every = joined(parts.select(*keys, RANGE).distinct(), ends, keys)
    before = every.select(*keys, RANGE, F.last("_range_end", ignorenulls=True).over(earlier(keys)).alias("_range_before"))
    rows = joined(parts.withColumn("_range_here", F.last(value, ignorenulls=True).over(so_far(keys, order))), before, keys)
    return rows.withColumn(name, F.coalesce("_range_here", "_range_before")).drop("_range_here", "_range_before")
