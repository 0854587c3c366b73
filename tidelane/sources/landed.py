"""Landed JSON bodies to typed rows. What cannot be parsed becomes a reject with a reason, never a guess.

Every parser returns ``Parsed(rows, rejects)``; both come from one lazy scan. NULL (not published) and 0 stay
apart: an absent or null optional field is NULL, a blank or malformed one is a reject.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

HORIZONS = {"nearby": "nearby", "forward_1_month": "1_month", "forward_3_month": "3_month"}
OFFSET = r"([+-]\d\d:?\d\d|Z)$"


@dataclass
class Parsed:
    rows: DataFrame
    rejects: DataFrame


def _split(df: DataFrame, reasons: list[Column], columns: list[str]) -> Parsed:
    """Rows without a reason against rows with all of theirs."""
    marked = df.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return Parsed(marked.where(F.size("reasons") == 0).select(*columns), marked.where(F.size("reasons") > 0))


def _reason(name: str, condition: Column) -> Column:
    return F.when(condition, F.lit(name))


# --- scalar parsing -------------------------------------------------------------------------------------------


def instant(raw: Column) -> Column:
    """Text with an offset to a UTC instant; without an offset NULL."""
    return F.when(raw.rlike(OFFSET), F.try_to_timestamp(raw))


def calendar_date(raw: Column) -> Column:
    """The date before 'T', as published; an offset in the text is an error (NULL), no zone arithmetic."""
    return F.when(~raw.rlike(OFFSET) | ~raw.contains("T"), F.substring_index(raw, "T", 1).try_cast("date"))


def optional(raw: Column, kind: str) -> tuple[Column, Column]:
    """(value, malformed): absent or null is NULL; blank or unparseable is malformed; 0 is 0."""
    value = F.trim(raw).try_cast(kind)
    return value, raw.isNotNull() & value.isNull()


def missing(raw: Column) -> Column:
    return raw.isNull() | (F.trim(raw) == "")


# --- time-series bodies ---------------------------------------------------------------------------------------


def _bodies(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """Landed JSON, a body a file, or a body a line: files of lines are split among tasks."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def series_points(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row for each published point, raw, with its series header and its place in the file."""
    body = _bodies(spark, path, schemas.SERIES_BODY, lines)
    series = body.select(F.col("_metadata.file_path").alias("file"), F.posexplode("value.timeSeries").alias("series_at", "s"))
    blocks = series.select("file", "series_at", "s", F.posexplode("s.values").alias("block_at", "b"))
    points = blocks.select("file", "series_at", "block_at", "s", F.posexplode("b.value").alias("point_at", "p"))
    options = F.filter("s.variable.options.option", lambda o: F.lower(F.trim(o["name"])) == "statistic")
    return points.select(
        F.get("s.sourceInfo.siteCode", F.lit(0))["value"].alias("site_id"),
        F.get("s.variable.variableCode", F.lit(0))["value"].alias("param_code"),
        F.get(options, F.lit(0))["optionCode"].alias("stat_cd"),
        F.col("s.variable.noDataValue").try_cast("double").alias("no_data"),
        F.col("p.value").alias("raw_value"), F.col("p.dateTime").alias("raw_time"), F.col("p.qualifiers").alias("qualifiers"),
        F.struct("file", "series_at", "block_at", "point_at").alias("seq"),
    )


def _measured(points: DataFrame) -> DataFrame:
    """Typed values without the series' own sentinel; a sentinel that is no number filters nothing."""
    value = F.col("raw_value").try_cast("double")
    return points.withColumn("value", value).where(F.col("no_data").isNull() | value.isNull() | (value != F.col("no_data")))


def instantaneous_readings(points: DataFrame) -> Parsed:
    """site_id, ts, param_code, value, qualifiers, seq; provisional readings are kept."""
    df = _measured(points).withColumn("ts", instant(F.col("raw_time")))
    reasons = [_reason("no_site", missing(F.col("site_id"))), _reason("no_param", missing(F.col("param_code"))), _reason("bad_value", F.col("value").isNull()), _reason("time_without_offset", F.col("ts").isNull())]
    return _split(df, reasons, ["site_id", "ts", "param_code", "value", "qualifiers", "seq"])


def daily_readings(points: DataFrame) -> Parsed:
    """site_id, date, param_code, stat_cd, value, qualifiers, seq; the statistic comes from the body, never assumed."""
    df = _measured(points).withColumn("date", calendar_date(F.col("raw_time")))
    reasons = [_reason("no_site", missing(F.col("site_id"))), _reason("no_param", missing(F.col("param_code"))), _reason("no_statistic", missing(F.col("stat_cd"))), _reason("bad_value", F.col("value").isNull()), _reason("date_with_offset", F.col("date").isNull())]
    return _split(df, reasons, ["site_id", "date", "param_code", "stat_cd", "value", "qualifiers", "seq"])


def absent_series(requested: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Requested keys that the bodies do not hold; has to be empty."""
    return requested.select(*keys).distinct().join(points.select(*keys).distinct(), keys, "left_anti")


def only_requested(readings: DataFrame, requested: DataFrame, keys: list[str]) -> DataFrame:
    return readings.join(requested.select(*keys).distinct(), keys, "left_semi")


# --- weekly records -------------------------------------------------------------------------------------------


def rate_records(spark: SparkSession, paths: dict[str, str], horizons: dict[str, str] = HORIZONS, lines: bool = False) -> Parsed:
    """Weekly rates; the horizon is a property of the dataset a record came in, never of the record."""
    unknown = set(paths) - set(horizons)
    if unknown:
        raise ValueError(f"datasets without a horizon: {sorted(unknown)}")
    parts = []
    for dataset, path in paths.items():
        body = _bodies(spark, path, schemas.RATE_BODY, lines)
        parts.append(body.withColumn("seq", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))).withColumn("horizon", F.lit(horizons[dataset])))
    df = parts[0]
    for more in parts[1:]:
        df = df.unionByName(more)
    pct, bad_pct = optional(F.col("rate"), "decimal(18,6)")
    month, bad_month = optional(F.col("rate_month"), "int")
    nearby = F.col("horizon") == "nearby"
    df = df.withColumns({"week_ending": calendar_date(F.col("date")), "pct_of_tariff": pct, "month": F.when(~nearby, month)})
    reasons = [
        _reason("no_location", missing(F.col("location"))),
        _reason("bad_date", F.col("week_ending").isNull()),
        _reason("bad_rate", bad_pct),
        _reason("no_rate_month", ~nearby & missing(F.col("rate_month"))),
        _reason("bad_rate_month", ~nearby & ~missing(F.col("rate_month")) & (bad_month | ~month.between(1, 12))),
    ]
    out = _split(df, reasons, ["location", "week_ending", "horizon", "pct_of_tariff", "month", "seq"])
    return Parsed(out.rows.withColumnRenamed("month", "rate_month"), out.rejects)


def movement_records(spark: SparkSession, path: str, lines: bool = False) -> Parsed:
    """Weekly lock movements; keys are required, tons are not."""
    body = _bodies(spark, path, schemas.MOVEMENT_BODY, lines)
    tons, bad = optional(F.col("tons"), "decimal(18,6)")
    df = body.withColumn("seq", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))).withColumns({"week_ending": calendar_date(F.col("date")), "parsed": tons})
    reasons = [_reason("no_lock", missing(F.col("lock"))), _reason("no_commodity", missing(F.col("commodity"))), _reason("bad_date", F.col("week_ending").isNull()), _reason("bad_tons", bad)]
    out = _split(df, reasons, ["lock", "week_ending", "commodity", "parsed", "seq"])
    return Parsed(out.rows.withColumnRenamed("parsed", "tons"), out.rejects)


def classify_bodies(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file, outcome): rows, empty_page, error_object, other_json, or outside_record for a body that is no JSON."""
    body = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    outcome = (
        F.when(F.col("v").isNull(), "outside_record")
        .when(kind.startswith("ARRAY"), F.when(F.try_variant_get("v", "$[0]", "variant").isNull(), "empty_page").otherwise("rows"))
        .when(F.try_variant_get("v", "$.error", "variant").isNotNull(), "error_object")
        .otherwise("other_json")
    )
    return body.select("file", outcome.alias("outcome"))


# --- registry and narrow reads --------------------------------------------------------------------------------


def load_gauges(registry: DataFrame, site_ids: list[str] | None = None) -> DataFrame:
    """Registry rows, all or those asked for; an empty registry or an unknown id is an error."""
    if site_ids is None:
        if registry.isEmpty():
            raise ValueError("the registry is empty")
        return registry
    wanted = registry.sparkSession.createDataFrame([(s,) for s in site_ids], "site_id string")
    unknown = [r[0] for r in wanted.join(registry.select("site_id"), "site_id", "left_anti").orderBy("site_id").collect()]
    if unknown:
        raise ValueError(f"unknown sites: {unknown}")
    return registry.join(wanted, "site_id", "left_semi")


def requested_pairs(registry: DataFrame) -> DataFrame:
    return registry.select("site_id", F.explode("available_params").alias("param_code"))


def series_values(df: DataFrame, keys: list[str], column: str, allowed: tuple[str, ...]) -> DataFrame:
    """(keys, value) of one allowed column, for all series at once."""
    if column not in allowed:
        raise ValueError(f"{column!r} is not one of {allowed}")
    return df.select(*keys, F.col(column).alias("value"))
