"""Load reports, completeness and table readers."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import reads
from ..operators.incremental import truncation
from ..operators.series import coverage, trailing_mean


def completeness(rows: DataFrame, key: str, value: str, zeros: bool = False) -> DataFrame:
    """Rows and NULLs of each key with their percentage; with ``zeros`` also explicit zeros, a third count."""
    counts = [F.count("*").alias("n_rows"), F.count_if(F.col(value).isNull()).alias("n_null")]
    if zeros:
        counts.append(F.count_if(F.col(value) == 0).alias("n_zero"))
    return rows.groupBy(key).agg(*counts).withColumn("pct_null", F.col("n_null") * 100.0 / F.col("n_rows"))


def load_report(registry: DataFrame, rows: DataFrame, key: str, date: str, seeded: str, value: str) -> DataFrame:
    """Received rows, period, truncation and NULLs of each dataset."""
    nulls = completeness(rows, key, value).select(key, "n_null", "pct_null")
    return truncation(registry, rows, key, date, seeded).join(nulls, key, "left")


def raw_coverage(rows: DataFrame, key: str, time: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(time).alias("first"), F.max(time).alias("last"))


def publication_lag(rows: DataFrame, date: str, today: Column) -> DataFrame:
    """Newest period and the days since."""
    return rows.agg(F.max(date).alias("newest")).withColumn("days_since", F.datediff(today, F.col("newest")))


def page_completeness(shown: DataFrame, everything: DataFrame, value: str) -> DataFrame:
    """One row: NULLs and rows on a page against the rows there are."""
    a = shown.agg(F.count("*").alias("n_shown"), F.count_if(F.col(value).isNull()).alias("n_null"))
    b = everything.agg(F.count("*").alias("n_total"))
    return a.join(b).withColumn("truncated", F.col("n_shown") < F.col("n_total"))


def read_gauges(registry: DataFrame, daily: DataFrame, key: str = "site_id", date: str = "date") -> DataFrame:
    return coverage(registry, daily, key, date).orderBy(key)


def read_series(series: DataFrame, registry: DataFrame, site: str, start: Date, end: Date, param: str | None = None, limit: int = 500, offset: int = 0) -> DataFrame:
    """A page of one site's series; an unknown site is an error."""
    reads.require_known(series.sparkSession.createDataFrame([(site,)], "site_id string"), registry, "site_id")
    rows = reads.equal_where_given(reads.date_range(series, "date", start, end), site_id=site, param_code=param)
    return reads.page(rows, ["date", *[c for c in ("param_code",) if c in rows.columns]], limit, offset)


def read_rates(rates: DataFrame, start: Date, end: Date, location: str | None = None, segment: str | None = None, horizon: str | None = None, limit: int = 500, offset: int = 0) -> DataFrame:
    """A page of weekly rates as doubles, NULLs as they are; ``segment`` is another name for ``location``."""
    rows = reads.equal_where_given(reads.date_range(rates, "week_ending", start, end), location=reads.alias_value(location, segment), horizon=horizon)
    return reads.page(rows.withColumn("pct_of_tariff", F.col("pct_of_tariff").cast("double")), ["week_ending", "location", "horizon"], limit, offset)


def read_movements(movements: DataFrame, start: Date, end: Date, lock: str | None = None, commodity: str | None = None, limit: int = 500, offset: int = 0) -> DataFrame:
    """A page of lock movements, never summed."""
    rows = reads.equal_where_given(reads.date_range(movements, "week_ending", start, end), lock=lock, commodity=commodity)
    return reads.page(rows.withColumn("tons", F.col("tons").cast("double")), ["week_ending", "lock", "commodity"], limit, offset)


def read_signals(signals: DataFrame, run_id: int, passing_only: bool = False, feature: str | None = None, limit: int = 500, offset: int = 0, order: tuple[str, ...] = ("feature_name", "site_id", "horizon_days", "lag_days", "regime")) -> DataFrame:
    """A page of one run, smallest q first and unknown q last, ties by ``order``."""
    rows = reads.glob(reads.passing(reads.equal_where_given(signals, run_id=run_id), passing_only), "feature_name", feature)
    return reads.page(rows, [F.col("q_value").asc_nulls_last(), *order], limit, offset)


def weekly_extract(rates: DataFrame, daily: DataFrame, start: Date, end: Date, value: str, name: str, days: int = 6) -> DataFrame:
    """week_ending, rate and the trailing mean of a daily series over the same weeks."""
    weeks = reads.date_range(rates, "week_ending", start, end).select("week_ending", "pct_of_tariff")
    return trailing_mean(weeks, daily, [], "week_ending", "date", value, days, name).orderBy("week_ending")


def extracts(rates: DataFrame, raw: DataFrame, deseasonalized: DataFrame, years: tuple[int, ...] = (2022, 2023)) -> dict[str, DataFrame]:
    """Raw and deseasonalized weekly extracts of each year, by file name."""
    out = {}
    for y in years:
        span = (Date(y, 1, 1), Date(y, 12, 31))
        out[f"{y}_raw.csv"] = weekly_extract(rates, raw, *span, "value", "discharge")
        out[f"{y}_deseasonalized.csv"] = weekly_extract(rates, deseasonalized, *span, "anomaly", "discharge_anomaly")
    return out
