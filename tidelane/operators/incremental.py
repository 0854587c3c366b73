"""Resume points, backfill tiles, window coverage and known gaps. All state is in the data; there are no checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resume_points(registry: DataFrame, data: DataFrame, key: str, time: str) -> DataFrame:
    """Registry keys with the newest time in the data, NULL where there is none."""
    return registry.join(data.groupBy(key).agg(F.max(time).alias("newest")), key, "left")


def poll_starts(points: DataFrame, now: Column, overlap: str, cold_start: str) -> DataFrame:
    """start = newest - overlap, or now - cold start for a key without data (intervals as SQL text)."""
    return points.withColumn("start", F.coalesce(F.col("newest") - F.expr(f"INTERVAL {overlap}"), now - F.expr(f"INTERVAL {cold_start}")))


def since_start(rows: DataFrame, starts: DataFrame, key: str, time: str) -> DataFrame:
    """Rows at or after the start of their key."""
    return rows.join(starts.select(key, "start"), key).where(F.col(time) >= F.col("start")).drop("start")


def backfill_starts(points: DataFrame, floor: str) -> DataFrame:
    """start = newest, else the registry's floor; without either the key is refused."""
    start = F.coalesce("newest", F.col(floor))
    return points.withColumn("start", start).withColumn("status", F.when(start.isNull(), "refused").when(F.col("newest").isNotNull(), "resume").otherwise("from_floor"))


def tiles(ranges: DataFrame, key: str, start: str, end: str, days: int, half_open: bool) -> DataFrame:
    """Windows of ``days`` that tile each range: half-open [a, b), or inclusive dates [a, b]."""
    step = F.expr(f"INTERVAL {days} DAYS")
    until = F.col(end) - F.expr("INTERVAL 1 MICROSECOND") if half_open else F.col(end)
    rows = ranges.where(F.col(start) < F.col(end) if half_open else F.col(start) <= F.col(end))
    rows = rows.withColumn("w_start", F.explode(F.sequence(F.col(start), until.cast(ranges.schema[start].dataType) if half_open else until, step)))
    last = F.col("w_start") + step if half_open else F.date_add("w_start", days - 1)
    return rows.select(key, "w_start", F.least(last, F.col(end)).alias("w_end"))


def window_coverage(windows: DataFrame, rows: DataFrame, key: str, time: str, days: int, half_open: bool = False) -> DataFrame:
    """Readings and first time in each window, inclusive dates or half-open instants; empty windows stay with 0.

    Windows of a key tile its range, so a reading's window follows from its distance to the key's first window:
    the range condition becomes an equi-join on (key, window start).
    """
    span = windows.groupBy(key).agg(F.min("w_start").alias("_origin"), F.max("w_end").alias("_until"))
    placed = rows.join(span, key)
    if half_open:
        placed = placed.where((F.col(time) >= F.col("_origin")) & (F.col(time) < F.col("_until")))
        step = F.floor((F.unix_micros(time) - F.unix_micros("_origin")) / (days * 86400 * 1_000_000))
        placed = placed.withColumn("w_start", F.expr("_origin") + F.make_dt_interval(step.cast("int") * days))
    else:
        placed = placed.where(F.col(time).between(F.col("_origin"), F.col("_until")))
        placed = placed.withColumn("w_start", F.date_add("_origin", (F.floor(F.datediff(F.col(time), "_origin") / days) * days).cast("int")))
    counts = placed.groupBy(key, "w_start").agg(F.count("*").alias("n_readings"), F.min(time).alias("first_date"))
    return windows.join(counts, [key, "w_start"], "left").withColumn("n_readings", F.coalesce("n_readings", F.lit(0).cast("long")))


def site_results(coverage: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Windows, empty windows, readings and first date of each key, and ``walked_from_seed``: whether its walk began at
    the registry's floor (``starts`` as ``backfill_starts`` gives them). Only then the first date is that of the record;
    a resumed walk's is where it resumed, and ``record_start`` is NULL."""
    out = coverage.groupBy(key).agg(
        F.count("*").alias("n_windows"), F.count_if(F.col("n_readings") == 0).alias("n_empty"), F.sum("n_readings").alias("n_readings"), F.min("first_date").alias("first_date")
    )
    walked = starts.select(key, (F.col("status") == "from_floor").alias("walked_from_seed"))
    return out.join(walked, key, "left").withColumn("record_start", F.when(F.col("walked_from_seed"), F.col("first_date")))


def explain_empty(windows: DataFrame, gaps: DataFrame, key: str, source: str) -> DataFrame:
    """Empty windows with the note of the earliest single known gap that holds them whole; else unexplained.

    Gaps are few (a curated list), each joined to the windows of its own site.
    """
    g = gaps.where(F.col("source") == source).select(key, "gap_start", "gap_end", "note")
    empty = windows.where(F.col("n_readings") == 0)
    hit = empty.join(g, key).where((F.col("gap_start") <= F.col("w_start")) & (F.col("w_end") <= F.col("gap_end")))
    notes = hit.groupBy(key, "w_start", "w_end").agg(F.min_by("note", "gap_start").alias("note"))
    return empty.join(notes, [key, "w_start", "w_end"], "left").withColumn("explained", F.col("note").isNotNull())


def truncation(registry: DataFrame, rows: DataFrame, key: str, date: str, seeded: str) -> DataFrame:
    """Received rows and period bounds of each dataset, and whether fewer came than were announced."""
    got = rows.groupBy(key).agg(F.count("*").alias("received"), F.min(date).alias("first_period"), F.max(date).alias("last_period"))
    out = registry.join(got, key, "left").withColumn("received", F.coalesce("received", F.lit(0).cast("long")))
    return out.withColumn("truncated", F.coalesce(F.col("received") < F.col(seeded), F.lit(False)))
