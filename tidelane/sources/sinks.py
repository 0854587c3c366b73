"""Change-only merges, window-bounded rewrites, append-only run logs and extracts."""

from __future__ import annotations

import uuid
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row of each key: the last in arrival order. Aggregates map-side, so a hot key costs one row a task."""
    values = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(values, F.col(seq)).alias("_row")).select(*keys, "_row.*")


def changes(target: DataFrame, source: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Source rows that insert or change a target row (NULL against 0 is a change), with ``change``."""
    t = target.select(*keys, F.struct(*values).alias("_old"), F.lit(True).alias("_known"))
    joined = source.select(*keys, *values).join(t, keys, "left")
    change = F.when(F.col("_known").isNull(), "insert").when(~F.struct(*values).eqNullSafe(F.col("_old")), "update")
    return joined.withColumn("change", change).where("change is not null").select(*keys, *values, "change")


def merged(target: DataFrame, source: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The target after the merge: a full outer join on the keys; source values win where a source row exists."""
    t = target.select(*keys, F.struct(*values).alias("_t"))
    s = source.select(*keys, F.struct(*values).alias("_s"))
    both = t.join(s, keys, "full_outer")
    return both.select(*keys, F.coalesce("_s", "_t").alias("_r")).select(*keys, "_r.*")


class Conflict(RuntimeError):
    """Another writer has committed in between; nothing of this write is visible."""


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _hadoop(spark, f"{path.rstrip('/')}/_versions")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[str, str]]:
    """(version, {partition folder: data folder that holds it}) of the newest version, or of a stated one."""
    version = version or max(_versions(spark, path), default=0)
    if not version:
        return 0, {}
    text = spark.read.text(f"{path.rstrip('/')}/_versions/{version}", wholetext=True).first()
    return version, dict(line.split("\t", 1)[::-1] for line in text.value.splitlines()) if text else {}


def read_table(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """A table that ``write_merge`` keeps: one committed version, whatever is being written or was left behind."""
    base, held = path.rstrip("/"), _manifest(spark, path, version)[1]
    by_write: dict[str, list[str]] = {}
    for partition, write in held.items():
        by_write.setdefault(write, []).append(f"{base}/{write}/{partition}")
    parts = [spark.read.schema(schema).option("basePath", f"{base}/{write}").parquet(*paths) for write, paths in sorted(by_write.items())]
    return union_all(parts) if parts else spark.createDataFrame([], schema)


def _commit(spark: SparkSession, path: str, version: int, held: dict[str, str]) -> None:
    """Makes a version visible by one rename of its complete list of partitions."""
    base = path.rstrip("/")
    fs, final = _hadoop(spark, f"{base}/_versions/{version}")
    _, written = _hadoop(spark, f"{base}/_versions/.{uuid.uuid4().hex}")
    out = fs.create(written, False)
    out.write(bytearray("".join(f"{write}\t{partition}\n" for partition, write in sorted(held.items())), "utf-8"))
    out.close()
    if fs.exists(final) or not fs.rename(written, final):
        fs.delete(written, False)
        raise Conflict(f"version {version} of {path} was written by another job")


def expire(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes versions but the newest ``keep`` and all data folders that those do not hold (what crashed or lost a
    conflict left behind too); how many folders went. Not while another writer is at work."""
    base, versions = path.rstrip("/"), _versions(spark, path)
    kept = {w for v in versions[-keep:] for w in _manifest(spark, path, v)[1].values()}
    for v in versions[:-keep]:
        _delete(spark, f"{base}/_versions/{v}")
    fs, p = _hadoop(spark, base)
    gone = [s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("write-") and s.getPath().getName() not in kept]
    for name in gone:
        _delete(spark, f"{base}/{name}")
    return len(gone)


def write_merge(spark: SparkSession, path: str, source: DataFrame, keys: list[str], values: list[str], partition: str) -> int:
    """Merges into a versioned Parquet table partitioned by ``partition`` and returns how many rows changed.

    Only partitions with a change are rewritten, into a data folder of this write; then a new version, the list of
    which folder holds which partition, replaces the last in one step. Readers (``read_table``) see the version before
    or the one after, a crash in between leaves the one before, and of two writers at once one gets a Conflict. A key
    that moves to another partition leaves its old one. A rerun changes 0 rows and writes nothing. A source with
    several rows of one key is an error.
    """
    carried = [c for c in dict.fromkeys([*values, partition]) if c not in keys]
    source = source.select(*keys, *carried)
    version, held = _manifest(spark, path)
    target = read_table(spark, path, source.schema, version) if version else source.limit(0)
    delta = changes(target, source, keys, carried).persist()
    try:
        n = delta.count()
        if n:
            twice = delta.groupBy(*keys).count().where("count > 1").limit(5).collect()
            if twice:
                raise ValueError(f"several source rows of one key: {[tuple(r)[:-1] for r in twice]}")
            left = target.join(delta.where("change = 'update'").select(*keys), keys, "left_semi")
            touched = delta.select(partition).unionByName(left.select(partition)).distinct()
            # rows of a touched partition whose own key did not change stay as they are
            stays = target.join(touched, target[partition].eqNullSafe(touched[partition]), "left_semi").join(delta.select(*keys), keys, "left_anti")
            write = f"write-{uuid.uuid4().hex}"
            folder = f"{path.rstrip('/')}/{write}"
            stays.select(*keys, *carried).unionByName(delta.select(*keys, *carried)).repartition(partition).write.partitionBy(partition).parquet(folder)
            # the names of partitions, a folder each, are all that the driver sees
            gone = {_partition_folder(spark, partition, r[0]) for r in touched.collect()}
            fs, p = _hadoop(spark, folder)
            new = {s.getPath().getName(): write for s in fs.listStatus(p) if s.isDirectory()}
            _commit(spark, path, version + 1, {k: w for k, w in held.items() if k not in gone} | new)
        return n
    finally:
        delta.unpersist()


def rebuild_window(spark: SparkSession, path: str, rows: DataFrame, column: str, start: str, end: str, keys: list[str], values: list[str], partition: str) -> int:
    """Writes the rows of [start, end] of a result that was computed from full history: changed rows are merged,
    rows outside the window are neither read for changes nor deleted. Returns how many rows changed."""
    return write_merge(spark, path, window_of(rows, column, start, end), keys, values, partition)


def _partition_folder(spark: SparkSession, column: str, value: object) -> str:
    text = None if value is None else str(value)
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(column, text)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def window_of(rows: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows of [start, end] of a result computed from full history; an inverted window is an error."""
    if start > end:
        raise ValueError(f"window ends before it starts: {start} > {end}")
    return rows.where(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def append_batch(spark: SparkSession, log: str, batch: str, tables: dict[str, DataFrame], check=None) -> dict[str, int]:
    """Appends a batch to the tables of a log, once: how many rows each got, 0 for a batch that is committed already.

    Each table gets a folder for the batch; the batch counts when its name stands in the log, which is the last step
    and a single one. Until then a repeated call writes its folders anew, so a crash or a retry never doubles rows, and
    readers (``read_batches``) never see part of a batch. ``check`` of the counts may refuse the batch before that.
    """
    name = quote(str(batch), safe="")
    fs, done = _hadoop(spark, f"{log.rstrip('/')}/_batches/{name}")
    if fs.exists(done):
        return dict.fromkeys(tables, 0)
    counts = {}
    for path, rows in tables.items():
        folder = f"{path.rstrip('/')}/batch={name}"
        rows.write.mode("overwrite").parquet(folder)
        counts[path] = spark.read.schema(rows.schema).parquet(folder).count()
    if check:
        check(counts)
    fs.create(done, False).close()
    return counts


def read_batches(spark: SparkSession, log: str, path: str, schema) -> DataFrame:
    """The rows of a log's table that belong to committed batches."""
    fs, p = _hadoop(spark, f"{log.rstrip('/')}/_batches")
    names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/batch={n}" for n in names]) if names else spark.createDataFrame([], schema)


def append_run(runs_path: str, rows_path: str, run: DataFrame, rows: DataFrame, grid_size: int) -> int:
    """Logs a run before its rows, then all rows, null results included, and commits both if the counts agree; how
    many rows were added, 0 for a run that is logged already. A run over an empty grid is refused before anything is
    logged."""
    if grid_size < 1:
        raise ValueError("the grid is empty: there is nothing to scan, and no run is logged")

    def check(counts: dict[str, int]) -> None:
        if counts[rows_path] != grid_size:
            raise ValueError(f"{counts[rows_path]} rows for a grid of {grid_size}: the run is not logged")

    return append_batch(run.sparkSession, runs_path, run.select("run_id").distinct().first()[0], {runs_path: run, rows_path: rows}, check)[rows_path]


def append_analogs(queries_path: str, matches_path: str, queries: DataFrame, matches: DataFrame, batch: str) -> int:
    """Logs a batch of queries, refusals included, and the matches of each, once; how many queries were added."""
    return append_batch(queries.sparkSession, queries_path, batch, {queries_path: queries, matches_path: matches})[queries_path]


def write_extract(rows: DataFrame, path: str) -> None:
    """CSV with a header from the columns and NULL as the empty field."""
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
