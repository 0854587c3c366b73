"""As-of joins: for each left row, the last right row at or before its time. No staleness limit, never nearest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import carried, ranged


def asof_backward(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], keep_unmatched: bool = True, long_series: bool = True,
) -> DataFrame:
    """Left columns, plus ``right_time`` as matched and ``values``; NULL where nothing precedes.

    Both sides are stacked and the last right row is carried forward by (keys, time): a right row whose values are NULL
    is still found, because the row is carried as a struct. Several right rows at one time are resolved to the greatest.
    Rows lie in ranges of (keys, time) by sampled splitters, and a range hands its last right row on, so a series is
    carried by as many tasks as it needs, and no key may be named at all. Where many short series are known
    (``long_series`` false) each is carried by one task in one sort, and nothing is written.
    """
    name = "_match"
    r_row = F.struct(F.col(right_time).alias("_at"), *[F.col(c) for c in values])
    stacked = left.select(*keys, F.col(left_time).alias("t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(r_row).schema[0].dataType).alias("_right")).unionByName(
        right.select(*keys, F.col(right_time).alias("t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"), r_row.alias("_right"))
    )
    order = ["t", "_side", "_right"]
    if long_series:
        found = carried(ranged(stacked, keys, ["t", "_side"]), keys, order, "_right", name).where("_side = 1")
    else:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = stacked.withColumn(name, F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    if not keep_unmatched:
        found = found.where(F.col(name).isNotNull())
    matched = right_time if right_time not in left.columns else f"matched_{right_time}"
    return found.select("_left.*", F.col(f"{name}._at").alias(matched), *[F.col(f"{name}.{c}").alias(c) for c in values])


def asof_lagged(weeks: DataFrame, series: DataFrame, keys: list[str], week: str, date: str, value: str, lags: list[int]) -> DataFrame:
    """The series as of ``week - lag_days`` for every week and lag; a negative lag reads after the week.

    Lags multiply the weeks, the smaller side, before the join (as ``lag_days``). Rows of the
    series without a value are no candidates, and weeks without a match are dropped.
    """
    anchored = weeks.withColumn("lag_days", F.explode(F.array(*map(F.lit, lags)))).withColumn("_anchor", F.date_sub(F.col(week), F.col("lag_days").cast("int")))
    known = series.where(F.col(value).isNotNull())
    return asof_backward(anchored, known, keys, "_anchor", date, [value], keep_unmatched=False).drop("_anchor")
