"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BYTES = 1 << 26  # of texts of a class that are learned from


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id, as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, max_bytes: int = MAX_BYTES) -> tuple[pa.Table, dict[int, int]]:
    """(doc_id, text, label) of at most ``per_class`` rows and ``max_bytes`` of text of each class, and how many rows
    each class has.

    The rows are those with the smallest hashed ids, so the sample is the same on every run and does not follow
    the order of the table; a text that does not fit in the bytes that are left is passed over. An id that has
    several texts gives its least one. Only the sample reaches the driver, bounded by both parameters.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(usable & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = rows.where("label = 0").orderBy(*order).limit(per_class).unionByName(rows.where("label = 1").orderBy(*order).limit(per_class))
    picked = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("label").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    fits = picked.where(F.octet_length("text") <= max_bytes).withColumn("_sum", so_far).where(F.col("_sum") <= max_bytes)
    return fits.select("doc_id", "text", "label").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")]), {k: sizes.get(k, 0) for k in (0, 1)}
