"""Predicates and ordered, paged reads of the table readers."""

from __future__ import annotations

import re
from datetime import date as Date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SPAN_DAYS, MAX_LIMIT, DEFAULT_LIMIT = 5 * 366, 5000, 500


def date_range(rows: DataFrame, column: str, start: Date | None, end: Date | None, max_days: int = MAX_SPAN_DAYS) -> DataFrame:
    """Rows of [start, end]; both ends are required, in order, and at most ``max_days`` apart."""
    if start is None or end is None:
        raise ValueError("both ends of the range are required")
    if start > end:
        raise ValueError("the range ends before it starts")
    if (end - start).days > max_days:
        raise ValueError(f"the range is longer than {max_days} days")
    return rows.where(F.col(column).between(F.lit(start), F.lit(end)))


def equal_where_given(rows: DataFrame, **filters: object) -> DataFrame:
    """Equality predicates; None means no filter."""
    for column, value in filters.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows


def alias_value(first: str | None, second: str | None) -> str | None:
    """One value given under either of two names; disagreement is an error."""
    if first is not None and second is not None and first != second:
        raise ValueError(f"two names of one filter disagree: {first!r} and {second!r}")
    return first if first is not None else second


def passing(rows: DataFrame, passing_only: bool = False, column: str = "passes_gate") -> DataFrame:
    return rows.where(F.col(column)) if passing_only else rows


def glob(rows: DataFrame, column: str, pattern: str | None) -> DataFrame:
    """Case-sensitive shell pattern (* ? [...]) on a column, as one regular expression in the scan's filter."""
    if pattern is None:
        return rows
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = pattern[i + 1 : close]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return rows.where(F.col(column).rlike(f"(?s)^{out}$"))


def through(rows: DataFrame, column: str, as_of: object) -> DataFrame:
    """What was known on a day."""
    return rows.where(F.col(column) <= F.lit(as_of))


def require_known(requested: DataFrame, registry: DataFrame, key: str) -> None:
    """An unknown key is an error, not an empty result."""
    unknown = [r[0] for r in requested.select(key).distinct().join(registry.select(key), key, "left_anti").limit(20).collect()]
    if unknown:
        raise ValueError(f"unknown {key}: {sorted(unknown)}")


def page(rows: DataFrame, order: list, limit: int = DEFAULT_LIMIT, offset: int = 0, max_limit: int = MAX_LIMIT) -> DataFrame:
    """A page of a total order; a limit out of 1..max is refused, not clamped. The total is ``rows.count()``."""
    if not 1 <= limit <= max_limit:
        raise ValueError(f"limit must be between 1 and {max_limit}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return rows.orderBy(*order).offset(offset).limit(limit)


def best_rows(rows: DataFrame, run: str, q: str, order: list[str], k: int) -> DataFrame:
    """For each run its passing rows with the smallest q, or the smallest q of all when none passes; k at most."""
    from pyspark.sql import Window

    known = rows.where(F.col(q).isNotNull())
    some = known.groupBy(run).agg(F.bool_or("passes_gate").alias("_any"))
    chosen = known.join(some, run).where(F.col("passes_gate") | ~F.col("_any")).drop("_any")
    return chosen.withColumn("rank", F.row_number().over(Window.partitionBy(run).orderBy(q, *order))).where(F.col("rank") <= k)
