"""Resumable scoring: a file stream of events into running rates, with late rows and repeats dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def daily_rates(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events, users and mean value per day and type, closed once the watermark has passed."""
    once = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", "1 day").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("day.start").alias("day"), "event_type", "n", "total")


def append_new(done: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key), key, "left_anti")


def run(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
