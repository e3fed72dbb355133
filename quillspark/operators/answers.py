"""Checks of answers against evidence: citations, numbers, sentence support, relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from . import names

SUPPORT = 0.34


def cited(text: Column) -> Column:
    """Citation numbers [n] of a text, distinct and rising."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda x: x.cast("int"))))


def check_citations(answers: DataFrame, answer: str, known: str) -> DataFrame:
    """answers with used, dangling and unused numbers and the text without dangling marks."""
    used, have = cited(F.col(answer)), F.col(known)
    dangling = F.array_except(used, have)
    clean = F.aggregate(dangling, F.col(answer), lambda t, n: F.replace(t, F.concat(F.lit("["), n.cast("string"), F.lit("]")), F.lit("")))
    return answers.withColumns({"used": F.array_intersect(used, have), "dangling": dangling, "unused": F.array_sort(F.array_except(have, used)), "clean": clean})


def number_check(answer: Column, evidence: Column) -> Column:
    """Numbers of the answer that the evidence lacks; one- and two-digit numbers and years are not asked for."""
    wanted = F.filter(fx.amount_tokens(answer), lambda t: ~t.rlike(r"^\d{1,2}$") & ~t.rlike(r"^(19|20)\d{2}$"))
    bare = F.replace(evidence, F.lit(","), F.lit(""))
    short = lambda t: F.when(F.contains(t, F.lit(".")), F.rtrim(F.rtrim(t, F.lit("0")), F.lit("."))).otherwise(t)
    return F.filter(wanted, lambda t: ~(F.contains(bare, t) | F.contains(bare, short(t))))


def overlap(sentence: Column, evidence: Column) -> Column:
    """Share of the sentence's distinct tokens that the evidence has."""
    s = F.array_distinct(sentence)
    return F.when(F.size(s) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(s, evidence)) / F.size(s))


def sentence_support(answers: DataFrame, key: str, answer: str, evidence: str, threshold: float = SUPPORT) -> DataFrame:
    """Rows (key, n_sentences, n_supported, rate)."""
    rows = fx.exploded(answers, [key, fx.tokenize(F.col(evidence)).alias("e")], fx.split_sentences(F.col(answer)), "s").withColumn("t", fx.tokenize(F.col("s")))
    rows = rows.where(F.size("t") > 0)
    hit = (overlap(F.col("t"), F.col("e")) >= threshold).cast("int")
    return rows.groupBy(key).agg(F.count("*").alias("n_sentences"), F.sum(hit).alias("n_supported")).withColumn("rate", F.round(F.col("n_supported") / F.col("n_sentences"), 6))


def ranking_metrics(ranked: DataFrame, truth: DataFrame, query: str, key: str) -> DataFrame:
    """One row (queries, hit_rate, recall_at_1, mrr) over the queries of truth."""
    first = truth.join(ranked.select(query, key, "rank"), [query, key], "left").groupBy(query).agg(F.min("rank").alias("first"))
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    return first.agg(F.count("*").alias("queries"), share(F.col("first").isNotNull().cast("double")).alias("hit_rate"), share((F.col("first") == 1).cast("double")).alias("recall_at_1"), share(1.0 / F.col("first")).alias("mrr"))


def verbatim(docs: DataFrame, parts: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """Rows (key, the columns of parts) where a document's text holds the part as it stands; null and empty parts are held by none.

    The parts are one automaton (or a few), so each text is read once and only keys and parts leave it.
    """
    found = names.mentions(docs, parts, key, text, part).select(key, part).distinct()
    return found.join(parts, part).select(key, *parts.columns)
