"""Files as they arrive: a folder of FASTA-like tables or files watched by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.records import features
from ..plans.report import Config, reports
from ..sources.fasta import RECORDS


def stream_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features of records as Parquet files with the schema RECORDS arrive; append mode, no state."""
    return features(spark.readStream.schema(RECORDS).parquet(folder))


def stream_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Running totals of each sample over all files so far; for complete or update mode."""
    return stream_features(spark, folder).groupBy("sample_id").agg(
        F.count("*").alias("sequence_count"), F.sum("length").alias("total_length"), F.sum("n_count").alias("n_count"), F.max("max_gap_run").alias("max_gap_run")
    )


def watch(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[dict, int], None], config: Config = Config(), once: bool = False) -> StreamingQuery:
    """Full reports of each batch of arriving records, given to ``sink(reports, batch number)``."""
    stream = spark.readStream.schema(RECORDS).parquet(folder)

    def batch(df: DataFrame, number: int) -> None:
        sink(reports(df, config), number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
