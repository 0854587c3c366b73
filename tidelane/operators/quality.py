"""Row rules, vocabularies, uniqueness and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, rule) for every rule a row breaks, in one pass. As in a CHECK, a rule that is NULL holds."""
    broken = F.array_compact(F.array(*[F.when(~c, F.lit(name)) for name, c in rules.items()]))
    return rows.select(*keys, F.explode(broken).alias("rule"))


def unseen(rows: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """Distinct values outside a fixed vocabulary, with how often they occur."""
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(vocabulary)).groupBy(column).agg(F.count("*").alias("n"))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def fingerprint(rows: DataFrame, time: str, value: str, extra: str) -> DataFrame:
    """One row: count, first and last time, non-null ``extra`` and an exact decimal sum (free of summation order)."""
    return rows.agg(
        F.count("*").alias("n_rows"), F.min(time).alias("first"), F.max(time).alias("last"), F.count(extra).alias("n_extra"),
        F.sum(F.col(value).cast("decimal(28,6)")).alias("total"),
    )


def same_copy(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two fingerprints agree in every column, NULLs equal."""
    columns = a.columns
    return a.select(F.struct(*columns).alias("a")).join(b.select(F.struct(*columns).alias("b"))).select(F.col("a").eqNullSafe(F.col("b")).alias("same"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, t in tables.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def compare_counts(recorded: DataFrame, restored: DataFrame) -> DataFrame:
    """Every table whose counts differ, in either direction, with what was found."""
    both = recorded.select("table", F.col("n").alias("recorded")).join(restored.select("table", F.col("n").alias("restored")), "table", "full_outer")
    status = F.when(F.col("restored").isNull(), "missing").when(F.col("recorded").isNull(), "unexpected").when(F.col("recorded") != F.col("restored"), "differs")
    return both.withColumn("status", status).where("status is not null")
