"""The question log and a document folder as streams: extensions beyond the batch reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_outcomes(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts and sums of (ts, event_type, value) by day and type; days close once the watermark has passed them."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
        .select(F.col("window.start").cast("date").alias("day"), "event_type", "n", "value")
    )


def file_stream(spark: SparkSession, path: str, schema, files_each: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and gives the result as a table in memory: for reports of bounded size."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def sync_stream(files: DataFrame, apply, checkpoint: str):
    """Hands each micro-batch of files to `apply(batch, batch_id)`, for instance a sync of the index."""
    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
