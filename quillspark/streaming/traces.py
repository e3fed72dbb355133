"""Step summaries of a trace log, in batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def summarize(rows: DataFrame, window: str = "1 day") -> DataFrame:
    """Rows (day, step, n, total_ms) per event-time window."""
    return rows.groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("step")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("day"), "step", "n", F.round("total", 4).alias("total_ms")
    )


def stream_summary(spark: SparkSession, path: str, out: str, lateness: str = "1 day") -> DataFrame:
    """The same over files as a stream, run until what is there has been read.

    Windows leave the state when the watermark has passed them and are appended to Parquet files under `out`, a shared folder, with the
    query's checkpoint beside them; the windows still open at the end are added from the rows that the stream could not close yet.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).parquet(path)
    # Watermarks want a time-zone timestamp; the result goes back to the log's own type.
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    query = summarize(rows.withWatermark("ts", lateness)).writeStream.format("parquet").option("path", f"{out}/closed").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    closed = spark.read.schema("day timestamp, step string, n long, total_ms double").parquet(f"{out}/closed").withColumn("day", F.col("day").cast(schema["ts"].dataType))
    left = summarize(spark.read.parquet(path)).join(F.broadcast(closed.agg(F.max("day").alias("_last"))), F.col("_last").isNull() | (F.col("day") > F.col("_last"))).drop("_last")
    return closed.unionByName(left)
