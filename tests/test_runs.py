"""Runs as a stream: repeated and late events, several files, and the same rows as in batch; diffs of snapshots."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillspark.operators import versions
from quillspark.session import scratch_path
from quillspark.streaming import runs

BEGIN = datetime(2024, 1, 1)


def rows_of(df):
    return sorted((r["user_id"], str(r["started"]), str(r["ended"]), r["n"], r["agents"], r["statuses"], r["total_ms"], r["errors"], r["slow"], r["last_step"]) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")


def test_stream_equals_batch_over_files_with_repeats(spark):
    draw = random.Random(3)
    rows = [(i, BEGIN + timedelta(hours=i * 0.7 + draw.random()), draw.randint(0, 6), draw.choice(["view", "error", "buy"]), draw.choice([1.5, 90.0, None])) for i in range(300)]
    rows += draw.sample(rows, 40)  # repeated within the watermark
    rows += [(900, None, 1, "view", 1.0), (901, BEGIN, None, "view", 1.0)]
    events = frame(spark, rows).repartition(3)
    want = rows_of(runs.summaries(events))
    assert len(want) > 20 and sum(r[3] for r in want) == 300
    root = scratch_path(spark, "runs")
    runs.deal(events.where("ts is not null"), f"{root}/in", 5)
    assert rows_of(runs.stream(spark, f"{root}/in", f"{root}/out")) == want
    # A second start finds nothing new and changes nothing.
    assert rows_of(runs.stream(spark, f"{root}/in", f"{root}/out")) == want


def test_events_later_than_the_watermark_are_dropped(spark):
    root = scratch_path(spark, "late")
    one = lambda i, hours, user: (i, BEGIN + timedelta(hours=hours), user, "view", 1.0)
    for i, part in enumerate([[one(1, 0, 5), one(2, 1, 5)], [one(3, 200, 6)], [one(4, 2, 5), one(5, 199, 6)], [one(6, 9_000, -1)]]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{root}/in")
        if i:
            runs.stream(spark, f"{root}/in", f"{root}/out")
    got = {(r[0], r[3]) for r in rows_of(runs.stream(spark, f"{root}/in", f"{root}/out"))}
    assert got == {(5, 2), (6, 2)}  # event 4 came after its run had left the state


def test_a_run_in_order(spark):
    rows = [(2, BEGIN + timedelta(hours=1), 1, "b", 90.0), (1, BEGIN, 1, "a", 2.0), (3, BEGIN + timedelta(hours=1), 1, "error", None), (4, BEGIN + timedelta(hours=14), 1, "a", 1.0)]
    got = rows_of(runs.summaries(frame(spark, rows)))
    assert [(r[3], r[4], r[5], r[6], r[7], r[8], r[9]) for r in got] == [(3, "a,b,error", "ok,slow,error", 92.0, 1, 1, "error"), (1, "a", "ok", 1.0, 0, 0, "a")]
    assert runs.totals(runs.summaries(frame(spark, rows))).first()["steps"] == 4


def test_maps_of_versions_differ_on_both_sides(spark):
    rows = [(1, 1, {"a": 0.5, "b": 0.5}, ["r"]), (1, 2, {"a": 0.5 + 1e-12, "c": 0.5}, ["s"]), (1, 3, None, None), (2, 1, {"a": 1.0}, [])]
    df = spark.createDataFrame(rows, "k int, version int, w map<string,double>, rules array<string>")
    got = {(r["version"], r["part"], r["name"]): (r["before"], r["after"]) for r in versions.map_changes(df, "k", ["w"], ("rules",)).collect()}
    want = {(2, "w", "b"): (0.5, None), (2, "w", "c"): (None, 0.5), (2, "rules", "r"): (1.0, None), (2, "rules", "s"): (None, 1.0), (3, "w", "a"): (0.5 + 1e-12, None), (3, "w", "c"): (0.5, None), (3, "rules", "s"): (1.0, None)}
    assert got == want
    assert versions.map_changes(df.where(F.lit(False)), "k", ["w"]).count() == 0
