"""Text functions on literal rows, CJK included."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as fx
from quillspark.functions import filters
from quillspark.operators import answers, chunking


def one(spark, text, use):
    return spark.createDataFrame([(text,)], "t string").select(use(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        (None, []),
        ("", []),
        ("净利润 ROE", ["净", "利", "润", "净利", "利润", "roe"]),
        ("1,286.50", ["1", "286.50", "1286.50", "1286"]),
        ("rate 3.5", ["rate", "3.5"]),
        ("第 四十二 条", ["第", "四", "十", "二", "四十", "十二", "条", "第四十二条"]),
        ("WY2024-01 x", ["wy2024-01", "x", "2024", "01"]),
    ],
)
def test_tokens(spark, text, tokens):
    assert one(spark, text, fx.tokenize) == tokens


def test_sentences_and_paragraphs(spark):
    assert one(spark, "一。二！three? four. five\n six ;", fx.split_sentences) == ["一。", "二！", "three?", "four. five", "six ;"]
    assert one(spark, None, fx.split_sentences) == []


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ("id 11010519491231002X end", "id [ID:****002X] end"),
        ("call 13812345678.", "call [PHONE:****5678]."),
        ("card 6222021234567890123", "card [BANK:****0123]"),
        ("mail a.b@x-y.com now", "mail [EMAIL:****.com] now"), ("a@b.io, c@d.museum.", "[EMAIL:****b.io], [EMAIL:****seum]."), ("no@.com x@y.c", "no@.com x@y.c"), ("u@a.com.cn-", "[EMAIL:****m.cn]-"),
        ("\x01 call 13812345678\x01", "\x01 call [PHONE:****5678]\x01"),
        (None, ""),
    ],
)
def test_masking(spark, text, masked):
    assert one(spark, text, fx.mask_sensitive) == masked


def test_repair_scan(spark):
    assert one(spark, "1O0 2l3 4S5 6B7 SOB", fx.repair_scan) == "100 213 455 687 SOB"


def test_quality_score_counts_suspects_as_its_sql(spark, tmp_path):
    import duckdb

    from quillspark.plans import retrieval

    rows = [(1, "1O2O3 4S5S6S7"), (2, "1O2 3O4"), (3, ""), (4, None), (5, "a 2l3l4 5B6O7")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in retrieval.quality_score(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(retrieval.ORACLE_SQL["quality_score"]).fetchall())
    assert dict((r[0], r[2]) for r in got)[1] == 0.94  # one O, and two S that share no digit


def test_jaccard_and_f1(spark):
    row = spark.range(1).select(fx.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))).alias("j"), fx.token_f1(F.array(F.lit("a")), F.array(F.lit("b"))).alias("f")).first()
    assert row["j"] == 0.5 and row["f"] == 0.0


@pytest.fixture(scope="module")
def meta(spark):
    rows = [(1, "policy", 2023, None), (2, "case", 2021, "v1"), (3, None, None, "v2")]
    return spark.createDataFrame(rows, "id int, kind string, year int, version string")


@pytest.mark.parametrize(
    ("predicate", "ids"),
    [
        (lambda f: f.eq("kind", "policy"), [1]), (lambda f: f.ne("kind", "policy"), [2]), (lambda f: ~f.eq("kind", "policy"), [2, 3]), (lambda f: ~f.among("kind", ["policy", "case"]), [3]),
        (lambda f: f.ge("year", 2022) | f.eq("version", "v1"), [1, 2]), (lambda f: f.ge("year", 2020) & ~f.eq("kind", "case"), [1]), (lambda f: f.contains("version", "v"), [2, 3]), (lambda f: f.ne("absent", 1), []),
        (lambda f: f.among("year", [2021, 2023]) & f.eq("kind", "case"), [2]), (lambda f: f.gt("year", "abc"), []), (lambda f: f.gt("kind", "d"), [1]), (lambda f: f.eq("kind", None), []), (lambda f: f.lt("year", "2022.5"), [2]),
        (lambda f: f.eq("year", "2021"), [2]), (lambda f: f.le("version", "v1"), [2]), (lambda f: filters.soft_score(f, {"kind": "policy 7", "version": ""}) == 1, [1]), (lambda f: filters.soft_score(f, {}) == 1, [1, 2, 3]),
    ],
)
def test_filters(meta, predicate, ids):
    assert sorted(r["id"] for r in meta.where(predicate(filters.Fields(meta.schema))).collect()) == ids


def test_child_chunks_hold_all_sentences(spark):
    rng = random.Random(5)
    text = "".join("".join(rng.choices("abcdef", k=rng.randint(1, 90))) + rng.choice("。;!") for _ in range(40))
    chunks = one(spark, text, chunking.child_chunks)
    assert all(len(c) <= chunking.MOST + chunking.OVERLAP for c in chunks)
    assert all(s in "".join(chunks) for s in one(spark, text, fx.split_sentences))
    assert one(spark, "", chunking.child_chunks) == []
    assert "".join(one(spark, "x" * 400, chunking.child_chunks)).count("x") >= 400


def test_markdown_sections(spark):
    df = spark.createDataFrame([(1, "lead\n# A\ntext\n## B\n# C\nmore\nlines")], "id int, text string")
    rows = [tuple(r) for r in chunking.markdown_sections(df, "id").orderBy("section").collect()]
    assert rows == [(1, 1, "", 0, "lead"), (1, 2, "A", 1, "text"), (1, 3, "C", 1, "more\nlines")]


def test_citations_and_numbers(spark):
    df = spark.createDataFrame([("see [1] and [9]", [1, 2], "about 1,234.50 and 300", "1234.5 13000")], "a string, k array<int>, n string, e string")
    row = answers.check_citations(df, "a", "k").select("used", "dangling", "unused", "clean", answers.number_check(F.col("n"), F.col("e")).alias("missing")).first()
    assert (row["used"], row["dangling"], row["unused"], row["clean"], row["missing"]) == ([1], [9], [2], "see [1] and ", [])


def test_small_text_functions(spark):
    import hashlib

    assert one(spark, "aé", lambda c: fx.stable_hash(c, 4)) == hashlib.blake2b("aé".encode(), digest_size=4).hexdigest()
    assert one(spark, None, fx.stable_hash) == hashlib.blake2b(b"", digest_size=8).hexdigest()
    assert one(spark, 'so: {"a": {"b": 1}} done', fx.json_object) == '{"a": {"b": 1}}'
    assert one(spark, "{broken", fx.json_object) is None and one(spark, "{a: }", fx.json_object) is None and one(spark, None, fx.json_object) is None
    assert one(spark, "a  b\n" + "c" * 300, lambda c: fx.preview(c, 10)) == '{"v":"a b\\'
    assert one(spark, " 第 3 页 ", fx.looks_like_header) and one(spark, "Annual report", fx.looks_like_header) and not one(spark, "It ends.", fx.looks_like_header)
    page = "Report\nfirst.\n Report \nsecond.\nReport\nsame.\nsame.\nsame.\n" + "L" * 50 + "\nx\nx"
    assert one(spark, page, fx.strip_boilerplate) == "first.\nsecond.\nsame.\nsame.\nsame.\n" + "L" * 50 + "\nx\nx"
