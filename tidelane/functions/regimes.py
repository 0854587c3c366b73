"""Regimes of a feature from its own day-over-day direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REGIMES, MAX_STEP_DAYS = ("onset", "recovery", "all"), 1


def direction(rows: DataFrame, keys: list[str], date: str = "date", value: str = "value", max_step: int = MAX_STEP_DAYS) -> DataFrame:
    """Adds ``regime``: onset where the value rose since the day before, recovery where it fell, else NULL (flat,
    unknown, or across a gap)."""
    w = Window.partitionBy(*keys).orderBy(date)
    change = F.col(value) - F.lag(value).over(w)
    step = F.datediff(F.col(date), F.lag(date).over(w))
    return rows.withColumn("regime", F.when(step <= max_step, F.when(change > 0, "onset").when(change < 0, "recovery")))


def members(rows: DataFrame, keys: list[str], date: str = "date", value: str = "value") -> DataFrame:
    """keys, date, regime: one row for each regime a date belongs to; 'all' holds every date with a value."""
    marked = direction(rows, keys, date, value)
    both = F.array_compact(F.array(F.col("regime"), F.when(F.col(value).isNotNull(), F.lit("all"))))
    return marked.select(*keys, date, F.explode(both).alias("regime"))
