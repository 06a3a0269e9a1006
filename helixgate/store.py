"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder per application, on one machine
    only: executors elsewhere would not see it, so a cluster without the setting is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="helixgate-")
    return _local[app]


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _short_shuffles(spark: SparkSession):
    """Shuffle files of the jobs inside go when their query ends: the table is written by then."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def store(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once and read it again: what is used several times is computed once, and lost
    executors cost no more than reading a file again."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    with _short_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete tables of ``store`` that nothing reads any more."""
    for df in stored:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
