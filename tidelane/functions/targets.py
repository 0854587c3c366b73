"""Forward log returns on exact calendar offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HORIZONS = (7, 14, 21)


def log_return(now: Column, later: Column) -> Column:
    """ln(later / now); NULL if either is NULL or not positive."""
    return F.when((now > 0) & (later > 0), F.ln(later / now))


def forward_returns(weekly: DataFrame, keys: list[str], week: str, value: str, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """keys, week, horizon_days, value: every week and horizon, NULL where the exact later week is missing.

    Later rows are shifted back by each horizon, so one hash join serves all horizons.
    """
    h = F.explode(F.array(*map(F.lit, horizons)))
    base = weekly.select(*keys, F.col(week), F.col(value).cast("double").alias("_now"), h.alias("horizon_days"))
    later = weekly.select(*keys, F.col(week).alias("_w"), F.col(value).cast("double").alias("_later"), h.alias("horizon_days"))
    later = later.withColumn(week, F.date_sub("_w", F.col("horizon_days"))).drop("_w")
    out = base.join(later, [*keys, week, "horizon_days"], "left")
    return out.select(*keys, week, "horizon_days", log_return(F.col("_now"), F.col("_later")).alias("value"))


def resolvable_weeks(weekly: DataFrame, keys: list[str], week: str, value: str, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """keys, horizon_days, n_weeks: weeks whose own value and later value are both published."""
    h = F.explode(F.array(*map(F.lit, horizons)))
    known = weekly.where(F.col(value).isNotNull())
    later = known.select(*keys, h.alias("horizon_days"), F.col(week).alias("_w")).select(*keys, "horizon_days", F.date_sub("_w", F.col("horizon_days")).alias(week))
    pairs = weekly.select(*keys, F.col(week), F.col(value), h.alias("horizon_days")).join(later.withColumn("_ok", F.lit(True)), [*keys, week, "horizon_days"], "left")
    return pairs.groupBy(*keys, "horizon_days").agg(F.count_if(F.col(value).isNotNull() & F.coalesce("_ok", F.lit(False))).alias("n_weeks"))
