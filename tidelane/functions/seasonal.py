"""Day-of-year climatology and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS, WINDOW, MIN_YEARS = 365, 15, 8


def folded_day(date: Column | str) -> Column:
    """Day of the year from 1 to 365: 29 February shares 59 with the 28th, later days of leap years move up one."""
    d = F.col(date) if isinstance(date, str) else date
    n = F.dayofyear(d)
    leap = F.day(F.last_day(F.make_date(F.year(d), F.lit(2), F.lit(1)))) == 29
    return F.when(leap & (n >= 60), n - 1).otherwise(n)


def _plain_mean(values: Column) -> Column:
    """Mean of an array of (offset, median), added up one after the other in the order of the offsets."""
    return F.aggregate(F.array_sort(values), F.lit(0.0), lambda t, x: t + x["_median"]) / F.size(values)


def _mean(values: Column) -> Column:
    """Mean of an array of known doubles, the same in whatever order they were collected: summed in ascending order with
    what each addition rounds off, which is added last (Neumaier). A difference that is near a half would else be
    rounded by the order of a shuffle."""

    def add(t: Column, x: Column) -> Column:
        s = t["sum"] + x
        lost = F.when(F.abs(t["sum"]) >= F.abs(x), (t["sum"] - s) + x).otherwise((x - s) + t["sum"])
        return F.struct(s.alias("sum"), (t["lost"] + lost).alias("lost"))

    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("lost"))
    return F.aggregate(F.array_sort(values), zero, add, lambda t: t["sum"] + F.nanvl(t["lost"], F.lit(0.0))) / F.size(values)


def climatology(rows: DataFrame, keys: list[str], date: str = "date", value: str = "value", window: int = WINDOW, exact: bool = True) -> DataFrame:
    """keys, doy, baseline, n_years: mean of the medians of the days present in a circular window, and the distinct
    years with a value in it. After the first aggregation a series is at most 365 rows, each spread to its window.

    ``exact``: the mean does not depend on which day of the window holds which median. Otherwise doubles are added from
    the window's last day to its first, as SQL does that spreads each day by ``generate_series`` and takes an ``avg``:
    the same in any shuffle too, and equal to it to the last bit, which decides how a figure at a half is rounded."""
    half = window // 2
    days = rows.where(F.col(value).isNotNull()).groupBy(*keys, folded_day(date).alias("_day")).agg(F.median(value).alias("_median"), F.collect_set(F.year(date)).alias("_years"))
    near = F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda k: F.pmod(F.col("_day") - 1 + k, F.lit(DAYS)) + 1)
    baseline = _mean(F.collect_list("_median")) if exact else _plain_mean(F.collect_list(F.struct("_offset", "_median")))
    return days.select("*", F.posexplode(near).alias("_offset", "doy")).groupBy(*keys, "doy").agg(
        baseline.alias("baseline"), F.size(F.array_distinct(F.flatten(F.collect_list("_years")))).alias("n_years")
    )


def anomalies(rows: DataFrame, keys: list[str], date: str = "date", value: str = "value", min_years: int = MIN_YEARS, window: int = WINDOW, exact: bool = True) -> DataFrame:
    """keys, date, value, anomaly, climatology_n_years. The anomaly is NULL below ``min_years``; the count of years
    always stands, 0 where the window holds no value at all."""
    base = climatology(rows, keys, date, value, window, exact)
    joined = rows.select(*keys, F.col(date).alias("date"), F.col(value).alias("value"), folded_day(date).alias("doy")).join(base, [*keys, "doy"], "left")
    years = F.coalesce("n_years", F.lit(0))
    return joined.select(*keys, "date", "value", F.when(years >= min_years, F.col("value") - F.col("baseline")).alias("anomaly"), years.alias("climatology_n_years"))
