"""Readers and stores on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import versions
import literal_cases
from quillspark.sources import documents, stores


def test_folder_is_read_with_bad_and_odd_files(spark, tmp_path):
    for name, text in literal_cases.FILES:
        (tmp_path / name.rsplit("/", 1)[1]).write_text(text, encoding="utf-8-sig" if name.endswith("csv") else "utf-8")
    (tmp_path / "空 名.md").write_bytes("# 标题\n好".encode() + b"\xff")
    (tmp_path / "nothing.txt").write_text("")
    (tmp_path / "image.png").write_bytes(b"\x00\x01")
    files = documents.read_folder(spark, str(tmp_path))
    docs, blocks = documents.documents(files)
    found = {r["doc_id"]: r for r in docs.collect()}
    assert set(found) == {"R-1", "scan", "T-9", "empty", "records", "none", "plain", "空 名"}
    assert found["空 名"]["title"] == "标题" and found["none"]["issues"]
    assert documents.faq(files).count() == 3
    assert [r["text"] for r in documents.section_text(blocks, "节").collect()] == ["只有一段"]
    assert documents.locate(docs, "scan", "正文二").first()["at"] > 0 and documents.locate(docs, "scan", "没有").count() == 0
    images = spark.createDataFrame([(r["path"].replace("scan.txt", "scan.png"),) for r in files.collect()] + [("/x/none.png",)], "path string").where("path like '%png'")
    assert [tuple(r)[2:] for r in documents.sidecar_text(images, files).collect()] == [(1, 0.99)]
    assert documents.documents(files.limit(0))[1].count() == 0


def test_lines_are_appended_and_read_with_bad_ones_left_out(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("run-1", "plan", "ok", 1.5), ("run-1", "summary", "ok", 2.0)], "run_id string, step string, status string, latency_ms double")
    stores.append_lines(rows, log)
    stores.append_lines(rows.withColumn("run_id", F.lit("run-2")), log)
    (tmp_path / "log" / "more.json").write_text("{broken\n\n[1]\n{\"run_id\": \"run-2\", \"step\": \"x\", \"status\": \"error\", \"latency_ms\": 3}\n")
    steps, summaries = stores.read_trace(spark, log)
    assert steps.count() == 3 and summaries.count() == 2
    assert stores.read_trace(spark, log, "2")[0].count() == 2
    assert {r["run_id"]: (r["steps"], r["errors"]) for r in stores.runs(steps).collect()} == {"run-1": (1, 0), "run-2": (2, 1)}


def test_keys_and_dimensions_are_checked(spark, tmp_path):
    for name, ids in (("good", ["C1", "C2"]), ("bad", ["C1", "C1"])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"clients": [{"client_id": i, "age": 40, "prohibited_categories": ["x"], "eval_sample": i == "C1"} for i in ids]}))
    clients = stores.records(spark, str(tmp_path / "good.json"), "clients", stores.CLIENT, "client_id")
    assert clients.count() == 2 and stores.eval_clients(clients).count() == 1
    with pytest.raises(Exception, match="client_id is not unique: C1"):
        stores.records(spark, str(tmp_path / "bad.json"), "clients", stores.CLIENT, "client_id").collect()
    old = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0])], "id int, v array<double>")
    fresh = spark.createDataFrame([(2, [9.0, 9.0]), (3, [1.0, 1.0])], "id int, v array<double>")
    assert sorted((r["id"], r["v"][0]) for r in stores.upsert(old, fresh, "id", "v", 2).collect()) == [(1, 1.0), (2, 9.0), (3, 1.0)]
    with pytest.raises(Exception, match="dimensions"):
        stores.upsert(old, fresh, "id", "v", 3).collect()
    assert stores.delete(old, F.lit(None).cast("boolean")).count() == 2 and stores.delete(old).count() == 0


def test_canonical_text_has_sorted_keys_and_keeps_nulls(spark):
    row = spark.createDataFrame([(2, 'a"b', None)], "b int, a string, c string").select(versions.canonical(["b", "a", "c"], [F.col("b"), F.col("a"), F.col("c")]).alias("t")).first()
    assert json.loads(row["t"]) == {"a": 'a"b', "b": 2, "c": None} and row["t"].startswith('{"a":')


def test_blocks_come_from_one_parsing_of_each_kind_of_file(spark):
    files = spark.createDataFrame([("/a.json", '{"id": "A", "records": [{"k": 1}, {"k": ""}]}'), ("/b.csv", "k,v\n1,2\n"), ("/c.md", "# T\ntext\n")], "path string, raw string")
    docs, blocks = documents.documents(files)
    parsed = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("from_json")
    assert parsed(blocks) <= 2 * parsed(docs)
    assert sorted((r["doc_id"], r["block_order"], r["kind"]) for r in blocks.collect()) == [("A", 0, "table"), ("A", 1, "paragraph"), ("b", 0, "table"), ("c", 0, "paragraph")]
