"""The language stage removes text in a language that was not learned, and no clean text."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
import oracle
from quillspark.llm import common


def test_unlearned_language_goes(spark):
    docs = common.read(spark, oracle.SMALL, "documents").where(F.size(F.split("text", " ")) >= 50)
    hidden = docs.withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    left = {r["doc_id"] for r in corpus_pipeline.language(spark, hidden, oracle.SMALL).collect()}
    every = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert left == {k for k, lang in every.items() if lang != "de"}
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, oracle.SMALL).collect()} == set(every)
