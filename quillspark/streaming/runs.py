"""Summaries of runs: what one actor did without a pause longer than a gap, in batch and as a keyed stream.

The stream keeps one session for each actor. Repeated events, by their id, and events later than the watermark are dropped; a session leaves
the state when the watermark has passed its end. Batch and stream share one plan, so their results are the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GAP, LATE = "12 hours", "1 day"
#: A step with this much latency or more is slow.
SLOW = 80.0
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def summaries(events: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """Rows (user_id, started, ended, n, agents, statuses, total_ms, errors, slow, last_step) of events (event_id, ts, user_id, event_type, value).

    agents and statuses are distinct, in order of their first appearance by time and id. started and ended are the first event's time and the
    last one's. Events without an actor or a time belong to no run; of events with one id one counts. A run is one array, as long as its events.
    """
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value").where("user_id is not null and ts is not null")
    rows = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if rows.isStreaming else rows.dropDuplicates(["event_id"])
    status = F.when(F.col("event_type") == "error", "error").when(F.col("value") >= SLOW, "slow").otherwise("ok")
    step = F.struct("ts", "event_id", F.col("event_type").alias("step"), status.alias("status"), "value")
    per = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.sort_array(F.collect_list(step)).alias("s"))
    distinct = lambda c: F.array_join(F.array_distinct(F.transform("s", lambda x: x[c])), ",")
    count = lambda name: F.size(F.filter("s", lambda x: x["status"] == name)).cast("long")
    return per.select(
        "user_id", F.col("s")[0]["ts"].alias("started"), F.element_at("s", -1)["ts"].alias("ended"), F.size("s").cast("long").alias("n"), distinct("step").alias("agents"), distinct("status").alias("statuses"),
        F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + F.coalesce(x["value"], F.lit(0.0))), 4).alias("total_ms"), count("error").alias("errors"), count("slow").alias("slow"), F.element_at("s", -1)["step"].alias("last_step"),
    )


def deal(events: DataFrame, path: str, files: int) -> None:
    """Append events to a folder in `files` files in order of time, as a feed does, then one with a lone heartbeat a year on: it moves the watermark past every run.

    A file is one task's work, so a long log wants many.
    """
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    cuts = rows.select(F.percentile_approx("ts", F.array(*(F.lit(i / files) for i in range(1, files))), 10_000)).first()[0] or [] if files > 1 else []
    nth = sum(((F.col("ts") > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    for i in range(files):
        rows.where(F.coalesce(nth, F.lit(0)) == i).coalesce(1).write.mode("append").parquet(path)
    last = rows.agg((F.max("ts") + F.expr("interval 366 days")).alias("ts")).where("ts is not null")
    last.select(F.lit(None).cast("long").alias("event_id"), "ts", F.lit(-1).cast("long").alias("user_id"), F.lit("heartbeat").alias("event_type"), F.lit(0.0).alias("value")).coalesce(1).write.mode("append").parquet(path)


def stream(spark: SparkSession, path: str, out: str, files_at_once: int = 1, gap: str = GAP, late: str = LATE) -> DataFrame:
    """summaries() over a folder of files as a stream, a few files a batch, until what is there has been read.

    Closed runs are appended under `out`, a shared folder, with the query's checkpoint beside them, so a restarted stream goes on where it was.
    """
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).option("latestFirst", "false").parquet(path)
    closed = summaries(rows, gap, late)
    query = closed.writeStream.format("parquet").option("path", f"{out}/runs").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(closed.schema).parquet(f"{out}/runs").where("user_id >= 0")


def totals(runs: DataFrame) -> DataFrame:
    """One row for the log: runs, steps, runs with errors, distinct paths of agents, mean and longest run."""
    seconds = F.col("ended").cast("double") - F.col("started").cast("double")
    return runs.agg(
        F.count("*").alias("runs"), F.sum("n").alias("steps"), F.count_if(F.col("errors") > 0).alias("failed"), F.count_distinct("agents").alias("paths"),
        F.round(F.avg("n"), 4).alias("mean_steps"), F.round(F.max(seconds), 3).alias("longest"),
    )
