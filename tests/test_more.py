"""Operators without SQL, on literal rows and against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as fx
from quillspark.operators import advice, allocation, chunking, fusion, questions, vectors
from quillspark.operators import facts as facts_ops
from quillspark.operators.answers import verbatim


def test_hash_embeddings(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha 2024"), (2, None), (3, "")], "k long, text string")
    got = {r["k"]: np.array(r["embedding"]) for r in vectors.hash_embeddings(docs, "k", dimension=32).collect()}
    tokens = docs.where("k = 1").select(fx.tokenize(F.col("text")).alias("t")).first()["t"]
    want = np.zeros(32)
    for token, n in Counter(tokens).items():
        raw = hashlib.blake2b(token.encode(), digest_size=16).digest()
        want[int.from_bytes(raw[:8], "big") % 32] += (1 if raw[8] & 1 else -1) * (1 + math.log(n))
    assert np.allclose(got[1], want / np.linalg.norm(want)) and not got[2].any() and not got[3].any()


@pytest.mark.parametrize("metric", ["COSINE", "IP", "L2"])
def test_dense_search_by_blocks_is_that_by_join(spark, metric, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(90)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    q = v.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    blocks = sorted(tuple(r) for r in vectors.dense_top(q, v, metric, 7).collect())
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    assert blocks == sorted(tuple(r) for r in vectors.dense_top(q, v, metric, 7).collect())


def test_texts_are_embedded_where_they_are_multiplied(spark):
    """One Python step over the documents; rows are those of vectors made before. A text of null or without tokens counts as a zero vector."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 40)))) for i in range(600)] + [(600, None), (601, "")]
    docs = spark.createDataFrame(rows, "vec_id long, text string").repartition(2)
    asked = vectors.hash_embeddings(docs.where("vec_id % 50 = 0"), "vec_id", dimension=64).withColumnRenamed("vec_id", "query_id")
    want = sorted(tuple(r) for r in vectors.dense_top(asked, vectors.hash_embeddings(docs, "vec_id", dimension=64), "COSINE", 5).collect())
    got = vectors.dense_top(asked, docs, "COSINE", 5, text="text")
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 65


def test_parents_and_children(spark):
    row = lambda i: [f"n{i}", "v" * 20]
    big = [["name", "value"], *map(row, range(10))]
    blocks = [("d", 0, "s", 0, "paragraph", "a" * 60, None), ("d", 0, "s", 1, "paragraph", "b" * 60, None), ("d", 0, "s", 2, "table", "x" * 200, big), ("d", 0, "s", 3, "paragraph", "c。d。", None), ("d", 1, "t", 0, "table", "", [["h"], ["1"], ["2"], ["3"]]), ("d", 2, "u", 0, "paragraph", " ", None)]
    df = spark.createDataFrame(blocks, "doc_id string, section_order int, section_title string, block_order int, kind string, text string, rows array<array<string>>")
    packed = chunking.parents(df, 100)
    got = {r["parent_id"]: r for r in packed.collect()}
    assert got["d#s0-p0"]["text"] == "a" * 60 and got["d#s0-p1"]["text"] == "b" * 60
    tables = [r for k, r in sorted(got.items()) if r["kind"] == "table" and k.startswith("d#s0")]
    assert sum(r["text"].count("name: ") for r in tables) == 10 and len(tables) > 1 and all(len(r["pieces"]) == 1 for r in tables)
    assert got["d#s1"]["text"] == "h: 1。\nh: 2。\nh: 3。" and "d#s2" not in got
    parts = {r["child_id"]: r["text"] for r in chunking.children(packed).collect()}
    assert parts["d#s1-c0"] == "h: 1。\nh: 2。" and parts["d#s1-c1"] == "h: 3。"
    found = spark.createDataFrame([("d#s1", "x"), ("none", "own")], "parent_id string, text string")
    assert {r["text"]: r["context"] for r in chunking.with_context(found, packed).collect()} == {"x": got["d#s1"]["text"], "own": "own"}


def test_weighted_fusion(spark):
    rows = spark.createDataFrame([(1, 10, 4.0, 1.0, 0.5, 1.0), (1, 11, 2.0, 0.5, 0.9, 0.0), (1, 12, 0.0, 0.0, 0.1, 1.0), (2, 10, 3.0, 1.0, 0.2, 0.0)], "q int, k int, bm25 double, hit_ratio double, cosine double, metadata double")
    got = {(r["q"], r["k"]): (r["score"], r["rank"]) for r in fusion.weighted(rows, "q", "k", 2).collect()}
    assert got[1, 10] == (pytest.approx(0.45 + 0.4 * 0.5 + 0.15), 1) and got[1, 11] == (pytest.approx(0.45 * (0.35 + 0.15) + 0.4), 2)
    assert (1, 12) not in got and got[2, 10][0] == pytest.approx(0.45 * 0.3)


def test_verbatim_parts(spark):
    docs = spark.createDataFrame([(1, "x one two  three four five y"), (2, "one two three four five"), (3, "tone two three four fivefold"), (4, "short bit here")], "d int, text string")
    parts = spark.createDataFrame([(1, "one two three four five"), (2, "bit"), (3, "one two  three four five")], "p int, part string")
    assert sorted((r["d"], r["p"]) for r in verbatim(docs, parts, "d", "text", "part").collect()) == [(1, 3), (2, 1), (3, 1), (4, 2)]


@pytest.mark.parametrize("metric", ["COSINE", "IP", "L2"])
def test_nearest_vectors_in_blocks_and_parts(spark, metric, monkeypatch):
    """Few different values, so many ties; small blocks and parts give what all pairs give."""
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.integers(-1, 2, 3)]) for i in range(60)] + [(99, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    q = v.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), "embedding")

    def score(a, b):
        a, b = np.array(a), np.array(b)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float({"IP": a @ b, "L2": -np.linalg.norm(a - b), "COSINE": a @ b / n if n else 0.0}[metric]), 9) + 0.0

    want = {(i, j, rank) for i, a in rows if a and i % 7 == 0 for rank, (_, j) in enumerate(sorted((-score(a, b), j) for j, b in rows if b)[:4], 1)}
    for block, size in ((512, 64 << 20), (2, 100)):
        monkeypatch.setattr(vectors, "BLOCK", block)
        monkeypatch.setattr(vectors, "BROADCAST_BYTES", size)
        assert {(r["query_id"], r["vec_id"], r["rank"]) for r in vectors.dense_top(q, v, metric, 4).collect()} == want


def client(**changed):
    return dict(client_id=1, risk_capacity=3, qualified=True, experienced=True, single_cap=0.4, class_cap=0.7, issuer_cap=0.5, liquidity_floor=0.1, amount=100_000.0) | changed


def book(people, products):
    rows = [dict(**people, product_id=f"p{i}", asset_class=k, issuer=f"i{i % 3}", expected_return=0.03 + i / 100, volatility=0.02 * i, fee=0.001, liquidity=q, min_investment=m) for i, (k, q, m) in enumerate(products)]
    return allocation.Book(pd.Series(rows[0]), pd.DataFrame(rows))


def test_allocation_keeps_every_limit():
    rng = random.Random(9)
    for _ in range(60):
        b = book(client(single_cap=rng.choice([0.1, 0.3]), liquidity_floor=rng.choice([0.0, 0.3, 0.6])), [(rng.choice(allocation.CLASSES[:4]), rng.random(), rng.choice([0.0, 5_000.0, 30_000.0])) for _ in range(rng.randint(1, 8))])
        cash = b.solve()
        assert abs(b.w.sum() + cash - 1) < 1e-6 and not b.broken(cash)


def test_allocation_goes_to_cash_when_limits_cannot_be_kept(monkeypatch):
    monkeypatch.setattr(allocation.Book, "repair", lambda self: max(0.0, 1 - self.w.sum()))
    b = book(client(single_cap=0.01), [("bond", 0.0, 0.0)])
    assert b.solve() == 1.0 and not b.w.any()


def test_changes_are_seen_from_both_sides(spark):
    rows = [(1, "base", "a", 0.5), (1, "base", "cash", 0.5), (1, "cap_down", "b", 0.4), (1, "cap_down", "cash", 0.6)]
    got = {(r["variant"], r["product_id"]): r["delta"] for r in advice.weight_changes(spark.createDataFrame(rows, "client_id int, variant string, product_id string, weight double")).collect()}
    assert got["cap_down", "a"] == -0.5 and got["cap_down", "b"] == 0.4 and got["cap_down", "cash"] == 0.1
    assert got["risk_down", "a"] == -0.5 and ("base", "a") not in got  # a variant without rows holds nothing


def test_tightening_only_narrows(spark):
    people = spark.createDataFrame([(1, 3, 2.0, 0.4, 0.6, 0.5, 0.1), (2, 2, 1.0, 0.3, 0.6, 0.5, 0.1)], "client_id int, risk_capacity int, horizon double, single_cap double, class_cap double, issuer_cap double, liquidity_floor double")
    specs = spark.createDataFrame([(1, 2, None, 0.5, None, None, 0.05, ["x"])], "client_id int, risk_cap int, horizon_cap double, single_cap double, class_cap double, issuer_cap double, liquidity_floor double, excluded array<string>").withColumn("excluded_classes", F.array().cast("array<string>"))
    got = {r["client_id"]: r for r in advice.tightened_clients(people, specs).collect()}
    assert got[1]["risk_capacity"] == 2 and got[1]["single_cap"] == 0.4 and got[1]["liquidity_floor"] == 0.1 and got[1]["excluded"] == ["x"] and got[2]["excluded"] == []


def test_periods_years_and_codes(spark):
    row = spark.createDataFrame([("示例2023年前三季度与2024年 A12-34 77",)], "q string").select(questions.year_of(F.col("q"), 1).alias("y"), questions.period_of(F.col("q")).alias("p"), questions.identifiers(F.col("q")).alias("i")).first()
    assert (row["y"], row["p"], row["i"]) == (2023, "三季度", ["2023", "2024", "A12-34", "77"])
    assert questions.word_weight("多少") == 0.4 and questions.word_weight("适当性") == pytest.approx(1.1)


@pytest.mark.parametrize(("cell", "value"), [("1,234.5", 1234.5), ("-3%", -3.0), ("1.5％", 1.5), ("—", None), ("N/A", None), ("12a", None), ("", None), ("不适用", None)])
def test_numbers_of_cells(spark, cell, value):
    assert spark.createDataFrame([(cell,)], "c string").select(facts_ops.parse_number(F.col("c")).alias("v")).first()["v"] == value


def test_screening_makes_plain_columns_and_counts_alike(spark):
    from quillspark.operators import advice
    from quillspark.plans import advisory

    clients, products = advisory.clients(spark, "/root/testdata/sf0.001"), advisory.products(spark, "/root/testdata/sf0.001")
    pairs = advice.screen(clients, products)
    # A pair is judged once and makes no array.
    assert "lambda" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    want = {r["client_id"]: (r["n"], r["open"]) for r in pairs.groupBy("client_id").agg(F.count("*").alias("n"), F.count_if(F.col("reasons") == "").alias("open")).collect()}
    assert {r["client_id"]: (r["n_products"], r["n_included"]) for r in advice.screen_counts(clients, products).collect()} == want
    # An attribute that is missing closes nothing.
    blank = products.limit(1).withColumns({c: F.lit(None).cast(t) for c, t in products.drop("product_id").dtypes})
    assert {r["reasons"] for r in advice.screen(clients, blank).collect()} == {""}


def test_portfolios_deal_order_lines_once(spark):
    from quillspark.plans import advisory

    plan = advisory.books(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(client_id" in line]
    assert dealt and not any(", product_id" in line.split("),")[0] for line in dealt)


def test_query_vectors_of_no_share_take_a_pass_each_and_batches_are_cut(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = sorted(tuple(r) for r in vectors.dense_top(q, v, "L2", 4).collect())
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vectors, "VECTORS", 7)
    assert sorted(tuple(r) for r in vectors.dense_top(q, v, "L2", 4).collect()) == want
    texts = spark.createDataFrame([(i, "a b c"[: i % 6]) for i in range(20)], "k int, text string").coalesce(1)
    whole = sorted((r["k"], r["embedding"]) for r in vectors.hash_embeddings(texts, "k", dimension=8).collect())
    monkeypatch.setattr(vectors, "TEXTS", 3)
    assert sorted((r["k"], r["embedding"]) for r in vectors.hash_embeddings(texts, "k", dimension=8).collect()) == whole


def test_best_child_is_found_without_grouping_children(spark):
    from quillspark.operators import assembly

    rows = spark.createDataFrame([(1, "p", "b", 2.0), (1, "p", "a", 2.0), (1, "p", "a", 1.0), (1, "p", "0", None), (1, "r", "c", 3.0), (2, "s", "d", None)], "q int, p string, c string, s double")
    merged = assembly.merged_evidence(rows, "q", "c", "p", "s", tasks=3)
    assert sorted(map(tuple, merged.select("q", "p", "c", "s", "evidence_no").collect())) == [(1, "p", "a", 2.0, "E2"), (1, "r", "c", 3.0, "E1"), (2, "s", "d", None, "E1")]
