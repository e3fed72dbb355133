"""Answers put together from evidence: sentences chosen and cited, reports of how faithful they are, summaries of evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fx
from . import answers
from .facts import stripped

#: Characters of a sentence that may answer, of a table kept whole, of a snippet; sentences beside the conclusion.
LEAST_SENTENCE, WHOLE_TABLE, SNIPPET, BULLETS = 10, 260, 160, 3
#: Headings of an answer's parts, where its claims end, and what is no claim inside a sentence.
HEADS = ("【结论】", "【依据】", "【出处与时效】")
SOURCES = ("【出处与时效】", "【引用明细】", "【出处】")
META = (r"\[\d{1,2}\]", "（[^（）]{0,80}）", r"\([^()]{0,80}\)", "【[^【】]{0,20}】", r"^[-•\s]+")
#: The share of supported sentences from which an answer is faithful, and characters of a sentence that is checked.
FAITHFUL, CHECKED = 0.8, 8


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def claim_body(answer: Column) -> Column:
    """The answer before its list of sources."""
    text = F.coalesce(answer, F.lit(""))
    return stripped(F.regexp_replace(text, f"(?s)(?:{'|'.join(SOURCES)}).*$", ""))


def without_meta(sentence: Column) -> Column:
    """A sentence without citation numbers, bracketed remarks and list marks."""
    out = sentence
    for pattern in META:
        out = F.regexp_replace(out, pattern, " ")
    return stripped(F.regexp_replace(out, r"\s{2,}", " "))


def best_sentence(text: Column, wanted: Column, most: int = SNIPPET) -> Column:
    """The sentence with most of the wanted tokens, the first of equal ones and a little ahead if it opens the text; without sentences, the text's begin.

    wanted: an array of tokens; with none, the first sentence.
    """
    sentences = fx.split_sentences(text)
    scored = F.transform(sentences, lambda s, i: F.struct((F.size(F.array_intersect(F.array_distinct(fx.tokenize(s)), wanted)) + F.when(i == 0, 0.05).otherwise(0.0)).alias("score"), (-i).alias("at"), s.alias("s")))
    best = F.when(F.size(wanted) == 0, F.get(sentences, F.lit(0))).otherwise(F.array_max(scored)["s"])
    return F.when(F.size(sentences) == 0, truncated(stripped(text), most)).otherwise(best)


def chosen_sentences(evidence: DataFrame, query: str) -> DataFrame:
    """Rows (query, place, evidence_id, kind, sentence): the sentences that answer, place 0 the conclusion, at most BULLETS more.

    evidence: rows (query, question, evidence_id, kind, text). Sentences of LEAST_SENTENCE characters and more that share a token with the
    question, tables of at most WHOLE_TABLE characters as one; a sentence that several pieces of evidence have counts for the first.
    By shared tokens, the shorter of equal ones first, then by evidence id.
    """
    parts = F.when((F.col("kind") == "table") & (F.length("text") <= WHOLE_TABLE), F.array(stripped(F.col("text")))).otherwise(fx.split_sentences(F.col("text")))
    rows = evidence.select(query, "question", "evidence_id", "kind", F.explode(F.transform(parts, lambda s: stripped(s))).alias("sentence")).where(F.length("sentence") >= LEAST_SENTENCE)
    shared = F.size(F.array_intersect(F.array_distinct(fx.tokenize(F.col("question"))), F.array_distinct(fx.tokenize(F.col("sentence")))))
    once = rows.withColumn("shared", shared).where("shared > 0").groupBy(query, "sentence").agg(F.min(F.struct("evidence_id", "kind")).alias("e"), F.max("shared").alias("shared"))
    order = Window.partitionBy(query).orderBy(F.desc("shared"), F.length("sentence"), "e.evidence_id", "sentence")
    return once.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") <= BULLETS).select(query, "place", "e.evidence_id", "e.kind", "sentence")


def citations(chosen: DataFrame, query: str) -> DataFrame:
    """chosen with citation_no: one number for each piece of evidence, from 1 on in the order of first use."""
    first = chosen.withColumn("_first", F.min("place").over(Window.partitionBy(query, "evidence_id")))
    return first.withColumn("citation_no", F.dense_rank().over(Window.partitionBy(query).orderBy("_first"))).drop("_first")


def extracted_answers(cited: DataFrame, sources: DataFrame, query: str) -> DataFrame:
    """Rows (query, answer, n_citations): conclusion, grounds and sources, from citations() and sources (evidence_id, label, source_id, updated_at, version)."""
    rows = cited.join(sources, "evidence_id", "left")
    mark = F.concat(F.lit(" ["), "citation_no", F.lit("]"))
    tag = F.when(F.col("kind") == "table", "条款/表格").otherwise("原文")
    line = F.when(F.col("place") == 0, F.concat("sentence", mark)).otherwise(F.concat(F.lit("- （"), tag, F.lit("｜"), F.coalesce("label", F.lit("")), F.lit("）"), "sentence", mark))
    version = F.when(F.coalesce("version", F.lit("")) != "", F.concat(F.lit("，版本 "), "version")).otherwise("")
    source = F.concat(F.lit("["), "citation_no", F.lit("] "), F.coalesce("label", F.lit("")), F.lit("（资料编号 "), F.coalesce("source_id", F.lit("")), F.lit("，更新/生效日期 "), F.coalesce("updated_at", F.lit("")), version, F.lit("）"))
    grouped = rows.groupBy(query).agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("l"), F.array_sort(F.collect_set(F.struct("citation_no", source.alias("source")))).alias("s"))
    grounds = F.when(F.size("l") > 1, F.concat_ws("\n", F.transform(F.slice("l", 2, BULLETS), lambda x: x["line"]))).otherwise("- （本次命中的证据内容与结论一致，未发现其他相互印证的条款）")
    body = F.concat_ws("\n", F.lit(HEADS[0]), F.col("l")[0]["line"], F.lit(""), F.lit(HEADS[1]), grounds, F.lit(""), F.lit(HEADS[2]), F.concat_ws("\n", F.transform("s", lambda x: x["source"])))
    return grouped.select(query, body.alias("answer"), F.size("s").alias("n_citations"))


def keyphrase_coverage(answer: Column, phrases: Column) -> Column:
    """The share of phrases that the answer holds word for word; 1 without phrases."""
    return F.when(F.coalesce(F.size(phrases), F.lit(0)) <= 0, 1.0).otherwise(F.size(F.filter(phrases, lambda p: (p != "") & F.contains(answer, p))) / F.size(phrases))


def faithfulness(rows: DataFrame, answer: str, question: str, evidence: str) -> DataFrame:
    """rows with unsupported_numbers, support_rate, relevance and faithful; evidence is an array of texts.

    A sentence of CHECKED characters and more is supported if one piece of evidence has answers.SUPPORT of its tokens; one without tokens is. Without
    sentences the rate is 1. Faithful: no number without support and a rate of at least FAITHFUL.
    """
    body = claim_body(F.col(answer))
    checked = F.filter(fx.split_sentences(body), lambda s: F.length(s) >= CHECKED)
    tokens = F.transform(F.filter(F.transform(F.coalesce(F.col(evidence), F.array().cast("array<string>")), lambda e: F.array_distinct(fx.tokenize(e))), lambda t: F.size(t) > 0), lambda t: t)

    def supported(s: Column) -> Column:
        own = F.array_distinct(fx.tokenize(without_meta(s)))
        return (F.size(own) == 0) | F.exists(F.col("_tokens"), lambda e: F.size(F.array_intersect(own, e)) >= answers.SUPPORT * F.size(own))

    made = rows.withColumn("_sentences", checked).withColumn("_tokens", tokens)
    rate = F.when(F.size("_sentences") == 0, 1.0).otherwise(F.size(F.filter("_sentences", supported)) / F.size("_sentences"))
    numbers = answers.number_check(claim_body(F.col(answer)), F.concat_ws("\n", evidence))
    out = made.select("*", numbers.alias("unsupported_numbers"), F.round(rate, 6).alias("support_rate"), F.round(fx.token_f1(fx.tokenize(body), fx.tokenize(F.coalesce(F.col(question), F.lit("")))), 6).alias("relevance"))
    return out.withColumn("faithful", (F.size("unsupported_numbers") == 0) & (F.col("support_rate") >= FAITHFUL)).drop("_sentences", "_tokens")


def traceable(known: Column, used: Column) -> Column:
    """Whether an answer cites something and nothing that is not there."""
    return (F.size(used) > 0) & (F.size(F.array_except(used, known)) == 0)


def merged_evidence(rows: DataFrame, query: str, child: str, parent: str, score: str, most: int = 8, tasks: int | None = None) -> DataFrame:
    """Rows (query, parent, child, score, evidence_no): the best score of each child over query variants, the best child of each parent, the first `most`.

    The best child of a parent has its best score, so children are not grouped before; scores that are missing come last. tasks: how many tasks the
    best children are dealt over, so that a task's share does not grow with the input; rows that are dealt by parent already stay where they are.
    """
    best = F.min(F.struct(F.col(score).isNull().alias("_none"), (-F.col(score)).alias("_minus"), F.col(child).alias("_child"), F.col(score).alias("_score"))).alias("b")
    top = rows.groupBy(query, parent).agg(best).select(query, parent, F.col("b._child").alias(child), F.col("b._score").alias(score))
    order = Window.partitionBy(query).orderBy(F.desc(score), child)
    dealt = top if tasks is None else top.repartition(tasks, query)
    return dealt.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).withColumn("evidence_no", F.concat(F.lit("E"), "_n")).drop("_n")


def sources_by_use(rows: DataFrame, query: str, source: str, rank: str) -> DataFrame:
    """Rows (query, source, uses, source_no): sources by how often they are cited, then by first rank."""
    counted = rows.groupBy(query, source).agg(F.count("*").alias("uses"), F.min(rank).alias("_first"))
    return counted.withColumn("source_no", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("uses"), "_first", source))).drop("_first")


def evaluation(cases: DataFrame, baseline: str, value: str, latency: str) -> DataFrame:
    """One row: cases, mean value and baseline, lift over the baseline (null where it is 0), least, mean and greatest latency."""
    mean = F.avg(value)
    return cases.agg(
        F.count("*").alias("n_cases"), F.round(mean, 4).alias("mean"), F.round(F.avg(baseline), 4).alias("baseline"), F.when(F.avg(baseline) != 0, F.round((mean - F.avg(baseline)) / F.avg(baseline), 4)).alias("lift"),
        F.min(latency).alias("least_ms"), F.round(F.avg(latency), 4).alias("mean_ms"), F.max(latency).alias("worst_ms"),
    )


def narrative(rows: DataFrame, key: str, sections: list[tuple[str, Column]]) -> DataFrame:
    """Rows (key, report, completeness): titled sections that have text, in order, and the share of all sections that they are."""
    parts = F.array(*(F.struct(F.lit(title).alias("title"), F.nullif(stripped(text), F.lit("")).alias("text")) for title, text in sections))
    there = F.filter(parts, lambda p: p["text"].isNotNull())
    return rows.select(key, F.concat_ws("\n\n", F.transform(there, lambda p: F.concat(F.lit("## "), p["title"], F.lit("\n"), p["text"]))).alias("report"), F.round(F.size(there) / len(sections), 4).alias("completeness"))


def percent(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", value * 100)
