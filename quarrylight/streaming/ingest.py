"""Resumable ingestion: new files once, rows once per key within a watermark, the batch form by anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_new(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """Files of a folder as a stream; which ones are done is kept in the checkpoint of the query that reads it."""
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_per_batch).load(path)


def once_per_key(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """First row of each key; state is dropped once the watermark has passed."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new since the last call and stops; a failed call is repeated as a whole by the next."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
