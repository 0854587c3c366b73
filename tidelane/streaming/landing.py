"""Landed files as a stream: each micro-batch is merged change-only, so late and revised rows need no watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import last_wins, write_merge


def merge_stream(
    spark: SparkSession, landing: str, schema: str, table: str, keys: list[str], values: list[str], partition: str, seq: str, checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> StreamingQuery:
    """Reads what has landed since the last run as JSON lines, keeps the last row of each key and merges it.

    ``checkpoint`` holds the list of files seen; merging a batch twice changes nothing, so a restart is safe.
    """

    def merge(batch: DataFrame, _: int) -> None:
        rows = last_wins(prepare(batch), keys, seq)
        write_merge(batch.sparkSession, table, rows, keys, values, partition)

    stream = spark.readStream.schema(schema).json(landing)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
