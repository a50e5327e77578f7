"""Detection metrics over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Event files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_metrics(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts by class and the largest value of each unit and day; later than the watermark is dropped by Spark."""
    kind = F.when(F.col("event_type") == "error", "l").when(F.col("event_type").isin("view", "click"), "n").when(F.col("event_type").isin("purchase", "signup"), "h")
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 25).alias("unit_id"), kind.alias("conf"), F.col("value").alias("frp"))
    got = rows.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "unit_id").agg(*[F.count_if(F.col("conf") == c).alias(f"det_{n}") for c, n in (("l", "low"), ("n", "nominal"), ("h", "high"))], F.max("frp").alias("daily_max"))
    return got.select(F.to_date("w.start").alias("day"), "unit_id", "det_low", "det_nominal", "det_high", "daily_max")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs what is available into an in-memory table and returns it; for tests and small results."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
