"""Cleaning on literal rows: what the tables do not have."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.operators import cleaning


def test_clean_text_and_suspects(spark):
    text = "己经登陆 1O2l3\n机 密\n样 本 件\n 正文　 结束 \n\n\n\n尾"
    row = spark.createDataFrame([(text,), (None,)], "t string").select(cleaning.clean_text(F.col("t")).alias("c"), cleaning.suspects(F.col("t")).alias("n")).collect()
    assert row[0]["c"] == "已经登录 10213\n 正文 结束 \n\n尾" and row[0]["n"] == 4 and tuple(row[1]) == ("", 0)


def test_corpus_loses_templates_and_shared_lines(spark):
    shared = "Annual report"
    docs = [(i, f"{shared}\nbody {i}: text.\n", "s") for i in range(4)] + [
        (10, "# Head\n# Next\nx y\nx y\nx y\n内部资料 请勿外传\n内部资料：说明。\nlast", None), (11, None, "s"), (12, shared, ""), (13, "#  \nbody", "s"),
    ]
    df = spark.createDataFrame(docs, "k int, text string, source string").repartition(3)
    got = {r["k"]: r for r in cleaning.clean_corpus(df, "k", scanned=F.col("k") == 10, least=5).collect()}
    assert len(got) == len(docs)
    assert got[0]["cleaned"] == "body 0: text." and got[0]["n_shared"] == 1 and got[0]["score"] == 1.0
    odd = got[10]
    assert odd["cleaned"] == "# Head\n# Next\n内部资料：说明。\nlast" and odd["n_template"] == 4 and odd["n_empty"] == 1
    # Templates, an empty section, no source, a scan.
    assert odd["score_before"] == pytest.approx(1 - 0.04 - 0.02 - 0.05 - 0.05) and odd["score"] == pytest.approx(1 - 0.02 - 0.05 - 0.05)
    assert (got[11]["cleaned"], got[11]["score_before"], got[11]["score"]) == ("", 0.0, 0.0)
    assert got[12]["cleaned"] == "" and got[12]["n_shared"] == 1 and (got[12]["score_before"], got[12]["score"]) == (0.95, 0.0)
    assert [tuple(r) for r in cleaning.shared_lines(df, "k", least=5).collect()] == [(shared, 5)]
