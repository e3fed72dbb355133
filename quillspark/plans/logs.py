"""Log plans: snapshot hashes, trace streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions
from ..session import scratch_path, table
from ..streaming import runs, traces


def snapshot_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each logged snapshot as stored, and whether the snapshot as found later still has it: every tenth was altered."""
    names = ["event_id", "event_type", "props", "user_id"]
    stored = table(spark, sf_dir, "events").select(*names).withColumn("hash", versions.snapshot(versions.canonical(names, [F.col(n) for n in names])))
    found = stored.withColumn("props", F.when(F.col("event_id") % 10 == 0, F.concat(F.coalesce("props", F.lit("")), F.lit("!"))).otherwise(F.col("props")))
    return found.select("event_id", "hash", (versions.snapshot(versions.canonical(names, [F.col(n) for n in names])) == F.col("hash")).alias("verified"))


def trace_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.summarize(table(spark, sf_dir, "events"))


def trace_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.stream_summary(spark, f"{sf_dir}/events.parquet", scratch_path(spark, "trace"))


def run_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the log as a stream over eight files, one a batch."""
    root = scratch_path(spark, "runs")
    runs.deal(table(spark, sf_dir, "events"), f"{root}/in", 8)
    rows = runs.stream(spark, f"{root}/in", f"{root}/out")
    return rows.withColumns({c: F.col(c).cast(table(spark, sf_dir, "events").schema["ts"].dataType) for c in ("started", "ended")})


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = table(spark, sf_dir, "events").schema["ts"].dataType
    return runs.summaries(table(spark, sf_dir, "events")).withColumns({c: F.col(c).cast(kind) for c in ("started", "ended")})


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.totals(runs.summaries(table(spark, sf_dir, "events")))


_RUNS = f"""WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 'error' WHEN value >= {runs.SLOW} THEN 'slow' ELSE 'ok' END AS status FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM b),
  l AS (SELECT user_id, run, list(event_type ORDER BY ts, event_id) AS ss, list(status ORDER BY ts, event_id) AS ts_, min(ts) AS started, max(ts) AS ended, count(*) AS n, round(sum(coalesce(value, 0)), 4) AS total_ms,
    count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status = 'slow') AS slow FROM s GROUP BY user_id, run),
  r AS (SELECT user_id, started, ended, n, array_to_string(list_filter(ss, lambda x, i: list_position(ss, x) = i), ',') AS agents, array_to_string(list_filter(ts_, lambda x, i: list_position(ts_, x) = i), ',') AS statuses, total_ms, errors, slow, ss[-1] AS last_step FROM l)"""
_DAYS = "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type AS step, count(*) AS n, round(sum(value), 4) AS total_ms FROM events GROUP BY ALL"
QUERIES = {"snapshot_hash": snapshot_hash, "trace_days": trace_days, "trace_stream": trace_stream, "run_summaries": run_summaries, "run_stream": run_stream, "run_totals": run_totals}
ORACLE_SQL = {
    "snapshot_hash": """SELECT event_id, left(sha256('{"event_id":' || event_id || ',"event_type":' || coalesce(to_json(event_type)::VARCHAR, 'null') || ',"props":' || coalesce(to_json(props)::VARCHAR, 'null') || ',"user_id":' || coalesce(user_id::VARCHAR, 'null') || '}'), 32) AS hash,
      event_id % 10 <> 0 AS verified FROM events""",
    "trace_days": _DAYS,
    "trace_stream": _DAYS,
    "run_summaries": f"{_RUNS} SELECT * FROM r",
    "run_stream": f"{_RUNS} SELECT * FROM r",
    "run_totals": f"{_RUNS} SELECT count(*) AS runs, CAST(sum(n) AS BIGINT) AS steps, count(*) FILTER (WHERE errors > 0) AS failed, count(DISTINCT agents) AS paths, round(avg(n), 4) AS mean_steps, round(max(epoch_us(ended) - epoch_us(started)) / 1e6, 3) AS longest FROM r",
}
