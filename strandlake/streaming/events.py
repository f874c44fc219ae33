"""Structured Streaming over event-time data: tumbling, sliding and session windows and de-duplication with watermarks.

Each builder takes any DataFrame, streaming or not; ``run_to_table`` drives a bounded stream to its end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandlake.sources.shared import new_folder


def tumbling(events: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events and their value sum per window and type."""
    return _stats(events.withWatermark("ts", late), F.window("ts", width))


def sliding(events: DataFrame, width: str = "6 hours", step: str = "2 hours", late: str = "1 hour") -> DataFrame:
    return _stats(events.withWatermark("ts", late), F.window("ts", width, step))


def _stats(events: DataFrame, window) -> DataFrame:
    grouped = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("value_x100"))
    return grouped.select(F.col("w.start").alias("win_start"), "event_type", "n", "value_x100")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: events less than ``gap`` apart."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_of_each(events: DataFrame, keys: list[str], late: str = "40 days") -> DataFrame:
    """One event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A bounded file stream over one Parquet table of a folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything there is now and return what it has written, as Parquet in the shared folder.

    In complete mode each micro-batch replaces the result; in append mode it is one more part of it."""
    spark = stream.sparkSession
    base = new_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        # a batch that runs again replaces its own part
        batch.write.mode("overwrite").parquet(f"{base}/rows" if mode == "complete" else f"{base}/rows/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def arrivals(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], schema: str | StructType) -> DataFrame:
    """Parts that arrive one after the other: each is added to a folder, and the stream that ``build`` makes of the folder runs on from its checkpoint over
    what is new. Returns all that was written. A run that starts anew behind a failure repeats its last micro-batch only."""
    spark = parts[0].sparkSession
    base = new_folder(spark, "arrivals")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    for part in parts:
        part.write.mode("append").parquet(f"{base}/inbox")
        stream = build(spark.readStream.schema(schema).parquet(f"{base}/inbox"))
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
