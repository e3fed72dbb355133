"""Quality verdicts do not depend on a language's share of the trusted text."""

from __future__ import annotations

import random

from quillspark.llm import quality_rules


def _docs(spark):
    """Two languages of like documents, 300 each."""
    draw = random.Random(3)
    text = lambda lang: " ".join(f"{lang}{int(900 * draw.random() ** 2)}" for _ in range(400))
    return spark.createDataFrame([(i, text(x), x) for i, x in enumerate(["aa", "bb"] * 300)], "doc_id long, text string, lang string")


def test_language_with_fewer_trusted_documents_is_kept(spark):
    docs = _docs(spark)
    for most in (60, 0):  # aa (even keys) has 250 trusted documents, bb (odd keys) some or none
        trusted = [(i, 1) for i in range(600) if i < 500 and (i % 2 == 0 or i < 2 * most)]
        labels = spark.createDataFrame(trusted, "doc_id long, quality int")
        rows = quality_rules.quality_rules(docs, labels, lang="lang").collect()
        assert not any(r["plain_kept"] for r in rows if r["doc_id"] % 2)
        assert len(rows) == 600 and all(r["kept"] for r in rows)
        # Without trusted text only buckets that another language shares count.
        assert most or all(abs(r["balanced_score"]) < 0.02 for r in rows if r["doc_id"] % 2)
        kept = quality_rules.quality_rules(docs, labels, keep=["doc_id", "lang"], lang="lang")
        assert kept.columns == ["doc_id", "lang", "kept"] and kept.where("kept").count() == 600


def test_one_language_is_scored_as_without(spark):
    docs = _docs(spark).where("lang = 'aa'")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 100, 2)], "doc_id long, quality int")
    plain = {r["doc_id"]: r["score"] for r in quality_rules.quality_rules(docs, labels).collect()}
    for r in quality_rules.quality_rules(docs, labels, lang="lang").collect():
        assert r["score"] == plain[r["doc_id"]] and abs(r["balanced_score"] - r["score"]) < 2e-6
