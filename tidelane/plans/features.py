"""The feature registry and the long feature table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seasonal import MIN_YEARS, anomalies
from ..functions.targets import HORIZONS, forward_returns
from ..functions.thresholds import LEVELS, run_lengths, thresholds
from ..sources.sinks import rebuild_window, union_all

#: builder(rows with keys, date, value; keys) -> keys, date, value, anomaly, climatology_n_years
Builder = Callable[[DataFrame, list[str]], DataFrame]


@dataclass(frozen=True)
class Feature:
    name: str
    builder: Builder | None  # None: days below the ``level`` percentile, built together for all levels of a column
    column: str  # of the daily roll-up
    param: str = "00060"
    group: str = ""  # features of one group differ only in the column they read
    level: int = 0


def deseasonalized(rows: DataFrame, keys: list[str], min_years: int = MIN_YEARS, exact: bool = True) -> DataFrame:
    return anomalies(rows, keys, min_years=min_years, exact=exact)


def days_below(rows: DataFrame, keys: list[str], levels: dict[str, int]) -> DataFrame:
    """keys, date, feature_name, value, anomaly, climatology_n_years: run lengths below percentiles of the full record,
    which includes days outside any build window. All levels are selected at once and scanned in one pass."""
    limits = thresholds(rows, keys, levels=tuple(sorted(set(levels.values()))))
    runs = run_lengths(rows.join(limits, keys), keys, {name: f"p{level:02d}" for name, level in levels.items()})
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("feature_name"), F.col(name).cast("double").alias("value")) for name in levels]))
    return runs.select(*keys, "date", each).withColumns({"anomaly": F.lit(None).cast("double"), "climatology_n_years": F.lit(None).cast("int")})


def registry(min_years: int = MIN_YEARS, exact: bool = True) -> tuple[Feature, ...]:
    """``exact`` as in ``climatology``."""
    seasonal = partial(deseasonalized, min_years=min_years, exact=exact)
    return (
        Feature("discharge_mean", seasonal, "value_mean", group="discharge"),
        Feature("discharge_min", seasonal, "value_min", group="discharge"),
        *[Feature(f"days_below_p{level:02d}", None, "value_min", level=level) for level in LEVELS],
    )


def checked(features: tuple[Feature, ...], columns: list[str]) -> tuple[Feature, ...]:
    names = [f.name for f in features]
    if len(set(names)) < len(names):
        raise ValueError("feature names are not unique")
    unknown = {f.column for f in features} - set(columns)
    if unknown:
        raise ValueError(f"unknown source columns: {sorted(unknown)}")
    return features


def build_features(daily: DataFrame, keys: list[str], features: tuple[Feature, ...] | None = None) -> DataFrame:
    """keys, date, feature_name, value, anomaly, climatology_n_years for every registered feature and all series."""
    parts, runs = [], {}
    rows_of = lambda f: (daily.where(F.col("param_code") == f.param) if "param_code" in daily.columns else daily).select(*keys, "date", F.col(f.column).alias("value"))
    for f in checked(features or registry(), daily.columns):
        if f.builder is None:
            runs.setdefault((f.param, f.column), []).append(f)
        else:
            parts.append(f.builder(rows_of(f), keys).select(*keys, "date", F.lit(f.name).alias("feature_name"), "value", "anomaly", "climatology_n_years"))
    parts += [days_below(rows_of(same[0]), keys, {f.name: f.level for f in same}) for same in runs.values()]
    return union_all(parts)


def collapsing(features: tuple[Feature, ...]) -> list[tuple[str, str, str]]:
    """(param, kept feature, duplicate): features that are one series where every day has a single observation."""
    out, groups = [], {}
    for f in features:
        if f.group:
            groups.setdefault((f.param, f.group), []).append(f)
    for (param, _), group in groups.items():
        if len({f.column for f in group}) > 1:
            kept, *rest = sorted(f.name for f in group)
            out += [(param, kept, name) for name in rest]
    return out


def write_features(spark: SparkSession, path: str, daily: DataFrame, keys: list[str], start: str, end: str, features: tuple[Feature, ...] | None = None) -> int:
    """Builds all features from full history and merges those of [start, end]; how many rows changed."""
    rows = build_features(daily, keys, features).withColumn("year", F.year("date"))
    return rebuild_window(spark, path, rows, "date", start, end, ["date", *keys, "feature_name"], ["value", "anomaly", "climatology_n_years"], "year")


def write_targets(spark: SparkSession, path: str, weekly: DataFrame, week: str, value: str, name: str, start: str, end: str, horizons: tuple[int, ...] = HORIZONS) -> int:
    """Forward returns from full history, merged for the weeks of [start, end]; how many rows changed."""
    rows = forward_returns(weekly, [], week, value, horizons).select(F.col(week).alias("week_ending"), F.lit(name).alias("target_name"), "horizon_days", "value", F.year(week).alias("year"))
    return rebuild_window(spark, path, rows, "week_ending", start, end, ["week_ending", "target_name", "horizon_days"], ["value"], "year")
