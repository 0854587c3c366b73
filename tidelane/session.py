"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tidelane", **more: str) -> SparkSession:
    """A session in UTC with ANSI and adaptive execution on; cluster sizes are left to the submitter."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession | None) -> None:
    """Let Python workers import this package from where the driver has it."""
    if spark is None:
        return
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session without that setting gets a
    temporary folder; on a cluster its absence is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidelane-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


_cleared: set[str] = set()


def _staging(spark: SparkSession) -> str:
    """This application's folder for intermediate tables; it goes when the driver ends with its session alive."""
    path = f"{shared_dir(spark)}/tidelane/{spark.sparkContext.applicationId}"
    if path not in _cleared:
        _cleared.add(path)
        atexit.register(clear_staged, spark, path)
    return path


def clear_staged(spark: SparkSession, path: str | None = None) -> None:
    """Deletes the intermediate tables of this application; results that still read them are lost."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    p = context._jvm.org.apache.hadoop.fs.Path(path or _staging(spark))
    p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes with the staged tables; for what is written by other means."""
    return f"{_staging(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends there, any executor can be lost,
    and what several later steps read is computed once."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
