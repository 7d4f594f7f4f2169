"""Structured Streaming counterparts of the event-log views."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The event table as a stream of its files, with an event time that watermarks accept."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rpartition("/")
    is_folder = len(spark.read.parquet(path).inputFiles()) > 1
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(path) if is_folder else reader.option("pathGlobFilter", file).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark, so state stays bounded."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def hourly_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Heartbeat runs of each user; a late gap closes one."""
    return events.withWatermark("ts", gap).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("beats"))


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors see; a local one only where the master is local."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{own or 'file://' + tempfile.mkdtemp(prefix='folio-')}/stream-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, mode: str = "update") -> DataFrame:
    """Drive a stream over all that is there; its updates with the number of the ``batch`` that wrote them.

    Each batch overwrites its own files, so one that is run again after a failure counts once.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)
    schema = stream.schema
    spark.createDataFrame([], schema).write.parquet(f"{folder}/out/batch=-1")
    query = (
        stream.writeStream.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
        .option("checkpointLocation", f"{folder}/state")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/out")


def hourly_counts_by_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour and type of the distinct events, state bounded by the watermark; the last update of each counts."""
    got = run_to_table(hourly_counts(deduplicated(read_events(spark, sf_dir))))
    return got.groupBy(F.col("w.start").cast("string").alias("hour"), "event_type").agg(F.max_by("n", "batch").alias("n"))
