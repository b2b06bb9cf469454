"""Incremental deduplication and windowed coverage: one definition for tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import text_hash


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order) of the first row of each key."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def coverage(rows: DataFrame, ts: str, width: str) -> DataFrame:
    """Events of each type in each window of event time; a stream needs a watermark on ``ts`` first."""
    return rows.groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def dedup_stream(stream: DataFrame, ts: str, lateness: str, text: str = "text") -> DataFrame:
    """Rows whose normal text was not seen before; state older than the lateness is dropped."""
    return stream.withColumn("text_norm_hash", text_hash(F.col(text))).withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["text_norm_hash"])


def coverage_stream(stream: DataFrame, ts: str, width: str, lateness: str) -> DataFrame:
    """Windowed counts that are final once the watermark has passed; timestamps without zone count as UTC."""
    return coverage(stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness), ts, width)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is final to a Parquet table, taking all that is there and then stopping."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
