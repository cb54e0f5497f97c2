"""Streaming twins of the calendar series: event-time windows with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_folder


def event_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files: int = 1) -> DataFrame:
    """A stream of a folder's Parquet files, with ts as a timestamp (watermarks need one with a time zone)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, by: str, late: str = "1 hour") -> DataFrame:
    """Sums and counts by window and key; rows later than the watermark are dropped in streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sliding(events: DataFrame, width: str, step: str, by: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str, by: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), by, "n", "total")


def run_to_end(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Runs an aggregating stream over what is there and gives each key's last state.

    Batches send the rows that changed, each under its number, to Parquet under `path` (a new folder in the shared folder if
    not given); a batch that is run again writes its number again. Of a key, the row of the last batch stands. Nothing passes
    through the driver.
    """
    spark = df.sparkSession
    path = path or fresh_folder(spark, name)
    values = [c for c, t in df.dtypes if c in ("n", "total")]
    keys = [c for c in df.columns if c not in values]

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    q = df.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = df.schema.add("batch", "long") if "batch" not in df.columns else df.schema
    rows = spark.read.option("basePath", f"{path}/rows").schema(schema).parquet(f"{path}/rows")
    return rows.groupBy(*keys).agg(*(F.max_by(v, "batch").alias(v) for v in values))
