"""Progress over arriving artifacts, for batch frames and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_counts(events: DataFrame) -> DataFrame:
    """Events and users per day and type."""
    return events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events with less than ``gap`` between them."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


def watch(spark: SparkSession, path: str, schema: str, late: str = "10 minutes", every: str = "1 minute") -> DataFrame:
    """A stream of finished artifacts counted per minute; rows later than ``late`` are not waited for."""
    stream = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("minute"), "n", "users")


def run_once(counts: DataFrame, out: str, checkpoint: str) -> None:
    """Counts all that has arrived and appends the closed windows, from where the last run ended."""
    counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
