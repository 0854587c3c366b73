"""Freshness of tables, overdue jobs and their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..sources.sinks import union_all


def newest_rows(tables: dict[str, tuple[DataFrame | None, str]]) -> DataFrame:
    """table, newest, error: the newest time of each table (a date counts from midnight UTC). A table that cannot be
    read (None, or a missing column) is reported with an error, never skipped."""
    spark = SparkSession.getActiveSession()
    parts = []
    for name, (df, column) in tables.items():
        try:
            if df is None:
                raise ValueError("the table cannot be read")
            parts.append(df.agg(F.max(F.col(column).cast("timestamp")).alias("newest")).select(F.lit(name).alias("table"), "newest", F.lit(None).cast("string").alias("error")))
        except (AnalysisException, ValueError) as e:
            parts.append(spark.createDataFrame([(name, None, f"{type(e).__name__}: {str(e).splitlines()[0]}")], "table string, newest timestamp, error string"))
    return union_all(parts)


def freshness(newest: DataFrame, limits: DataFrame, now: Column) -> DataFrame:
    """Adds job_name, max_staleness_s, age_s and stale. An empty or uncheckable table is stale. Where the limits say how
    often a table is published (cycle_s) and how late (lag_s), ``below_floor`` tells those that are too tight to let one
    publication be missed, which alarm while all is well."""
    age = F.unix_timestamp(now) - F.unix_timestamp("newest")
    rows = limits.join(newest, "table", "left").withColumn("age_s", age)
    if {"cycle_s", "lag_s"} <= set(limits.columns):
        rows = rows.withColumn("below_floor", F.col("max_staleness_s") < staleness_limit(F.col("cycle_s"), F.col("lag_s")))
    return rows.withColumn("stale", F.col("error").isNotNull() | F.col("age_s").isNull() | (F.col("age_s") > F.col("max_staleness_s")))


def staleness_limit(cycle: Column, lag: Column) -> Column:
    """The least threshold that lets one publication be missed: cycle + lag + cycle."""
    return cycle + lag + cycle


def overdue(runs: DataFrame, cadences: DataFrame, now: Column) -> DataFrame:
    """job_name, last_success, overdue: judged on the last success only; a job that never succeeded is overdue."""
    done = runs.where("status = 'success'").groupBy("job_name").agg(F.max("finished_at").alias("last_success"))
    late = F.unix_timestamp(now) - F.unix_timestamp("last_success") > F.col("max_gap_s")
    return cadences.join(done, "job_name", "left").withColumn("overdue", F.coalesce(late, F.lit(True)))


def health(overdue_: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row: degraded if any job is overdue or any table stale, with both counts."""
    a = overdue_.agg(F.count_if("overdue").alias("n_overdue"))
    b = fresh.agg(F.count_if("stale").alias("n_stale"))
    return a.join(b).select("n_overdue", "n_stale", ((F.col("n_overdue") > 0) | (F.col("n_stale") > 0)).alias("degraded"))


def overdue_but_fresh(overdue_: DataFrame, fresh: DataFrame) -> DataFrame:
    """Overdue jobs all of whose tables are fresh: the run log and the data disagree."""
    tables = fresh.groupBy("job_name").agg(F.bool_or("stale").alias("any_stale"))
    return overdue_.where("overdue").join(tables.where("NOT any_stale").select("job_name"), "job_name", "left_semi")
