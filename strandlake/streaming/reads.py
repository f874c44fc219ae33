"""Reads as a stream: FASTQ text that arrives in numbered chunks, cut anywhere between lines.

A chunk is a folder ``stream=NAME/chunk=NUMBER`` of one text file with at least one line; chunks count from 0 and may arrive in any order. State
between micro-batches: for each stream how far it has been read, the lines of its unfinished record, and chunks that came before their turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.sources.formats import fastq_records, with_line_numbers, with_ordinals

LINES = "stream string, chunk long, line long, value string"
DONE = "stream string, chunk long, lines long, shift long"


def read_chunks(spark: SparkSession, inbox: str) -> DataFrame:
    """The lines of a folder of chunks as a stream, with the start of the file's split that they are in."""
    lines = spark.readStream.schema("value string, stream string, chunk long").text(inbox)
    return lines.select("stream", "chunk", F.col("_metadata.file_block_start").alias("block"), "value")


def stream_fastq(spark: SparkSession, inbox: str, out: str) -> DataFrame:
    """Read all chunks that are in ``inbox`` now, from where the last run into ``out`` ended; returns all reads so far: stream, ordinal, header, seq, qual.

    A micro-batch reads the state that the one before has written and writes its own beside it, so that one that runs again gives the same rows. A
    record comes out once its four lines are there: one that a stream's end leaves unfinished doesn't. Ordinals go on from the last stated one."""

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        read = lambda name, schema: session.read.schema(schema).parquet(f"{out}/{name}/{number - 1}") if number else session.createDataFrame([], schema)
        done = read("done", DONE)
        fresh = with_line_numbers(batch.withColumn("at", F.monotonically_increasing_id()), ["stream", "chunk"]).select("stream", "chunk", "line", "value")
        # written once: what follows reads it several times
        fresh.unionByName(read("waiting", LINES)).write.mode("overwrite").parquet(f"{out}/lines/{number}")
        lines = session.read.schema(LINES).parquet(f"{out}/lines/{number}")
        # a chunk's turn has come if all before it are there; lines without a chunk are of an unfinished record and have their number in the stream
        order = Window.partitionBy("stream").orderBy("chunk")
        sizes = lines.where("chunk is not null").groupBy("stream", "chunk").agg(F.count("*").alias("n")).join(done.withColumnRenamed("chunk", "next"), "stream", "left").na.fill(0, ["next", "lines"])
        turns = sizes.withColumn("k", F.row_number().over(order) - 1 + F.col("next")).withColumn("before", F.sum("n").over(order) - F.col("n") + F.col("lines")).where("k = chunk")
        now = turns.groupBy("stream").agg((F.max("chunk") + 1).alias("chunk"), F.max(F.col("before") + F.col("n")).alias("lines"))
        reached = done.select("stream", F.col("chunk").alias("c"), F.col("lines").alias("l"), "shift").join(now, "stream", "full").select("stream", F.coalesce("chunk", "c").alias("chunk"), F.coalesce("lines", "l").alias("lines"), F.coalesce("shift", F.lit(0)).alias("shift"))
        reached.write.mode("overwrite").parquet(f"{out}/reached/{number}")
        reached = session.read.schema(DONE).parquet(f"{out}/reached/{number}")
        # a row for each stream: sent to the tasks, as a shuffle by stream would put all lines of one in one task
        placed = lines.join(turns.select("stream", "chunk", "before"), ["stream", "chunk"], "left").join(F.broadcast(reached.selectExpr("stream", "lines div 4 * 4 as whole", "shift as was")), "stream", "left")
        placed = placed.withColumn("own", F.when(F.col("chunk").isNull(), F.col("line")).otherwise(F.col("before") + F.col("line")))
        waits = F.col("own").isNull() | (F.col("own") >= F.col("whole"))
        left = placed.where(waits).select("stream", F.when(F.col("own").isNull(), F.col("chunk")).alias("chunk"), F.coalesce("own", "line").alias("line"), "value")
        left.write.mode("overwrite").parquet(f"{out}/waiting/{number}")
        records = fastq_records(placed.where(~waits).select("stream", "was", F.col("own").alias("line"), "value"), ["stream", "was"])
        with_ordinals(records, ["stream"], "was").select("stream", "ordinal", "header", "seq", "qual", "record", "shift").write.mode("overwrite").parquet(f"{out}/reads/batch={number}")
        last = session.read.parquet(f"{out}/reads/batch={number}").groupBy("stream").agg(F.max_by("shift", "record").alias("last"))
        reached.join(last, "stream", "left").select("stream", "chunk", "lines", F.coalesce("last", "shift").alias("shift")).write.mode("overwrite").parquet(f"{out}/done/{number}")

    read_chunks(spark, inbox).writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("stream string, ordinal long, header string, seq string, qual string").parquet(f"{out}/reads").drop("batch")


def write_chunks(lines: DataFrame, inbox: str) -> None:
    """Chunks of (stream, chunk, line, value), each a file."""
    lines.repartition("stream", "chunk").sortWithinPartitions("stream", "chunk", "line").select("stream", "chunk", "value").write.mode("append").partitionBy("stream", "chunk").text(inbox)
