"""The pipeline's stages against brute force on the smallest documents, and on edge rows."""

from __future__ import annotations

import oracle
from pyspark.sql import functions as F
from test_operators import LONG, brute_groups, brute_quality, check_pieces, langs, texts

import corpus_pipeline
from quillspark.llm import common, language_id, queries
from quillspark.llm.segments import load


def test_stages_against_brute_force(spark):
    docs = texts(spark)
    good = {r["doc_id"] for r in common.read(spark, oracle.SMALL, "labels").where("quality = 1").collect()}
    kept = {k: docs[k] for k, v in brute_quality(sorted(docs.items()), good, langs(spark)).items() if v[6]}
    single = {k: kept[k] for k, _, component in brute_groups(sorted(kept.items())) if k == component}
    coder = load(queries.tokenizer_path("word_bpe_49k.json"))
    ids = {k: coder.encode(t, add_special_tokens=False).ids + [1] for k, t in single.items()}
    # Every document that is left has a language: the language stage removes none of these.
    assert check_pieces(corpus_pipeline.run(spark, oracle.SMALL).collect(), ids) == 0


def test_near_duplicates_by_text(spark):
    """Rows that share a doc_id, or have none, are judged by their texts; one of each group stays, repeated rows once."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(7, a), (7, a), (7, b), (3, a + " more"), (None, b), (None, c), (None, c), (None, c + " more"), (9, None), (9, None), (8, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _row string")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_removal(spark, docs, oracle.SMALL).collect()), key=repr)
    # Near copies of c share the null doc_id: either may stay. Texts without words are linked with nothing.
    assert [k for k, _ in got] == [3, 7, 8, 9, None] and {t for k, t in got if k in (3, 7)} == {a + " more", b}


def test_texts_stay_where_they_are(spark, monkeypatch):
    """Rows are chosen by bitmaps of their numbers: the larger table of a join is not shuffled, and the rows are those of a join."""
    rows = [(i, " ".join(f"w{i % 700}x{j}" for j in range(20)) if i % 50 else None) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(corpus_pipeline, "MOST_BITMAPS", 0)
    joined = sorted(map(tuple, corpus_pipeline.near_duplicate_removal(spark, docs, oracle.SMALL).collect()))
    monkeypatch.undo()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = corpus_pipeline.near_duplicate_removal(spark, docs, oracle.SMALL)
        assert "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, left.collect())) == joined
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(joined) == 706 and sum(t is None for _, t in joined) == 20


def test_rows_of_files_are_not_written_again(spark, monkeypatch, tmp_path):
    """Rows read from files are numbered by their places in them; rows that went or came twice since are written, with the same result."""
    rows = [(i % 300 if i % 7 else None, " ".join(f"w{i % 70}x{j}" for j in range(20)) if i % 50 else None) for i in range(1000)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    made.repartition(5).write.parquet(f"{tmp_path}/a b")
    read = spark.read.parquet(f"{tmp_path}/a b")
    labels, write = [], common.Scratch.write
    monkeypatch.setattr(common.Scratch, "write", lambda self, df, label: (labels.append(label), write(self, df, label))[1])

    def left(docs):
        labels.clear()
        return sorted(map(tuple, corpus_pipeline.near_duplicate_removal(spark, docs, oracle.SMALL).collect()), key=repr), "rows" in labels

    want, written = left(made)
    assert written and left(read) == (want, False)
    assert left(read.crossJoin(spark.range(2).select(F.lit("y").alias("twice"))).select("doc_id", "text")) == (want, True)
    some = F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0
    assert left(read.where(some)) == (left(made.where(some))[0], True)
    assert left(read.limit(0))[0] == []


def test_stages_on_edge_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in common.read(spark, oracle.SMALL, "labels").collect()}
    good = [k for k, q in sorted(labels.items()) if q == 1 and not language_id.is_held_out(k)]
    free = [k for k in range(max(labels) + 1, max(labels) + 9)]
    prose = "the quick brown fox jumps over the lazy dog while seven wise owls watch " * 2 + " ".join(f"unlike{i}" for i in range(60))
    rows = [(good[1], prose, "en"), (good[1], prose, "en"), (good[0], prose + " end", None), (None, prose + " end", "en"), (free[0], None, "en"), (free[1], "", None), (free[2], LONG, "en"), (free[3], "1 2 3 " * 30, None)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, lang string, kept string, score long")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, oracle.SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "kept", "score"]
        left.append(sorted((r["doc_id"] or 0) for r in docs.collect()))
    # Null, empty, long repetitive and letterless texts fail the counting rules; of the near copies the smallest doc_id stays.
    near = [0, good[0], good[1], good[1]]
    assert left == [near, near, [good[0]]]
    pieces = corpus_pipeline.packing(spark, docs, oracle.SMALL).collect()
    assert {r["doc_id"] for r in pieces} == {good[0]} and sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, oracle.SMALL)
        if "text" not in empty.columns:
            break
    assert empty.count() == 0
