"""Event streams: windowed counts with late data, and incremental delivery of results."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, size: str, late: str = "10 minutes", time: str = "ts", keys: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Count and sum by window and keys; works on streams (with a watermark) and tables alike."""
    df = events.withColumn(time, F.col(time).cast("timestamp"))  # event time has a zone
    df = df.withWatermark(time, late) if events.isStreaming else df
    return df.groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def deliver(df: DataFrame) -> Iterator[Row]:
    """Rows partition by partition, the next one fetched ahead: no more than two are on the driver."""
    return df.toLocalIterator(prefetchPartitions=True)
