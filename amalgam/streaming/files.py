"""New bibliographic files as a stream of normalized records. All stages are stateless up to here, so the batch functions serve as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from amalgam.operators.normalize import normalize
from amalgam.sources.files import bibliographic_files, parse_files


def stream_records(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Normalized records of the files of a folder as they arrive."""
    return normalize(parse_files(bibliographic_files(spark, path, recursive, streaming=True)))


def append_records(records: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends a stream of records to Parquet files, each file once; ``once`` takes what is there and stops."""
    writer = records.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
