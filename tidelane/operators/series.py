"""Daily series from two sources, roll-ups, and joins on calendar offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAILY_MEAN = "00003"


def daily_stats(readings: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean, minimum, maximum and count of each key and UTC day, in one pass."""
    return readings.groupBy(*keys, F.to_date(ts).alias("date")).agg(
        F.avg(value).alias("value_mean"), F.min(value).alias("value_min"), F.max(value).alias("value_max"), F.count(value).cast("int").alias("n_observations")
    )


def published_means(daily: DataFrame, stat: str = DAILY_MEAN) -> DataFrame:
    return daily.where(F.col("stat_cd") == stat)


def with_precedence(first: DataFrame, second: DataFrame, keys: list[str], columns: list[str], labels: tuple[str, str] = ("iv", "dv")) -> DataFrame:
    """Rows of ``first``, and those of ``second`` whose keys it lacks, with their source."""
    rest = second.join(first.select(*keys), keys, "left_anti")
    return first.select(*keys, *columns, F.lit(labels[0]).alias("source")).unionByName(rest.select(*keys, *columns, F.lit(labels[1]).alias("source")))


def gauge_series(readings: DataFrame, daily: DataFrame, keys: list[str]) -> DataFrame:
    """keys, date, value, source: the mean of a day's readings where there are any, else the published mean."""
    iv = daily_stats(readings, keys).select(*keys, "date", F.col("value_mean").alias("value"))
    return with_precedence(iv, published_means(daily), [*keys, "date"], ["value"])


def rollup(readings: DataFrame, daily: DataFrame, keys: list[str]) -> DataFrame:
    """The series with its dispersion; a day known only by its published mean has that as min and max, and n = 1."""
    stats = daily_stats(readings, keys)
    published = published_means(daily).select(*keys, "date", F.col("value").alias("value_mean"), F.col("value").alias("value_min"), F.col("value").alias("value_max"), F.lit(1).alias("n_observations"))
    return with_precedence(stats, published, [*keys, "date"], ["value_mean", "value_min", "value_max", "n_observations"])


def at_offset(rows: DataFrame, keys: list[str], date: str, value: str, days: int, name: str) -> DataFrame:
    """Adds ``name``: the value exactly ``days`` later (earlier if negative), NULL where that date has no row."""
    other = rows.select(*keys, F.date_sub(F.col(date), days).alias(date), F.col(value).alias(name))
    return rows.join(other, [*keys, date], "left")


def trailing_mean(weeks: DataFrame, daily: DataFrame, on: list[str], week: str, date: str, value: str, days: int = 6, name: str = "trailing_mean") -> DataFrame:
    """Mean of the values from ``days`` before each week to the week; weeks without any stay, with NULL.

    Each week is expanded to its days, so the join is a hash join on equal dates; the means are rounded half to even.
    Values are added up as decimals of six digits: a sum of doubles depends on the order of its rows, and a mean that
    lies halfway would then round either way.
    """
    spread = weeks.withColumn(date, F.explode(F.sequence(F.date_sub(F.col(week), days), F.col(week))))
    joined = spread.join(daily.select(*on, date, F.col(value).alias("_v")), [*on, date], "left")
    return joined.groupBy(*weeks.columns).agg(F.bround(F.sum(F.col("_v").cast("decimal(28,6)")).cast("double") / F.nullif(F.count("_v"), F.lit(0)), 0).alias(name))


def change_over(rows: DataFrame, keys: list[str], date: str, value: str, days: int, name: str = "change") -> DataFrame:
    """value minus the value exactly ``days`` earlier; NULL unless both dates have one."""
    return at_offset(rows, keys, date, value, -days, "_past").withColumn(name, F.col(value) - F.col("_past")).drop("_past")


def coverage(registry: DataFrame, rows: DataFrame, key: str, date: str) -> DataFrame:
    """Registry rows with first and last date and number of days observed; sites without data stay."""
    seen = rows.groupBy(key).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.countDistinct(date).alias("n_days"))
    return registry.join(seen, key, "left").withColumn("n_days", F.coalesce("n_days", F.lit(0).cast("long")))


def unregistered(names: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Distinct names that the registry lacks. Both sides are reduced before they meet: a name may repeat in either."""
    return names.select(key).distinct().join(registry.select(key).distinct(), key, "left_anti")


def histogram(rows: DataFrame, value: str, low: float, high: float, buckets: int, extra: dict[str, Column] | None = None, by: list[str] | None = None) -> DataFrame:
    """Rows by equal-width bucket: 0 below the range, buckets + 1 at or above its end."""
    bucket = F.expr(f"width_bucket({value}, cast({low} as double), cast({high} as double), {buckets})")
    return rows.where(F.col(value).isNotNull()).groupBy(*(by or []), bucket.alias("bucket")).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in (extra or {}).items()])


def with_targets(features: DataFrame, targets: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Feature rows and targets of the same exact date, both values known: date, value and target among the columns.
    Unlike an as-of join it has only weeks on whose own date the feature was measured."""
    known = targets.where(F.col("value").isNotNull()).select(*(on or []), F.col("week_ending").alias("date"), "horizon_days", F.col("value").alias("target"))
    return features.where(F.col("value").isNotNull()).join(known, [*(on or []), "date"])
