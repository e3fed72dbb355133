"""Statistics of corpora and runs, displays of metrics, reasons for a human's review, agreement of expected and actual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .assembly import percent

#: Ratios shown as percentages, bounds from which a ratio is favourable or adverse (null: no such bound).
AS_PERCENT = ("net_margin", "gross_margin", "debt_to_asset", "roe", "roa", "expense_ratio", "rnd_intensity", "revenue_growth", "receivable_growth", "ar_gap", "npl_ratio", "provision_coverage", "capital_adequacy", "pledge_ratio", "guarantee_ratio", "litigation_ratio", "goodwill_ratio", "top5_customer_ratio")
LOW_QUALITY = 0.9


def corpus_stats(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: documents, documents with issues, blocks, tables, and the distinct formats, rising."""
    told = docs.agg(F.count("*").alias("n_documents"), F.count_if(F.size("issues") > 0).alias("n_issues"), F.sort_array(F.collect_set("fmt")).alias("formats"))
    return told.join(blocks.agg(F.count("*").alias("n_blocks"), F.count_if(F.col("kind") == "table").alias("n_tables")))


def tally_stats(tallies: DataFrame) -> DataFrame:
    """corpus_stats() of rows (fmt, issue, n_blocks, n_tables), one for each document."""
    sums = (F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("n_blocks", "n_tables"))
    return tallies.agg(F.count("*").alias("n_documents"), F.count_if("issue").alias("n_issues"), F.sort_array(F.collect_set("fmt")).alias("formats"), *sums)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks, tables among them and their share, least, mean and greatest length."""
    n, tables = F.length("text"), F.count_if(F.col("kind") == "table")
    return chunks.agg(F.count("*").alias("n"), tables.alias("n_tables"), F.round(tables / F.count("*"), 4).alias("table_share"), F.min(n).alias("shortest"), F.round(F.avg(n), 4).alias("mean"), F.max(n).alias("longest"))


def quality_stats(scored: DataFrame, key: str, score: str) -> DataFrame:
    """One row: mean score, documents under LOW_QUALITY and the hundred lowest of them, by score and key."""
    low = F.struct(F.col(score).alias("score"), F.col(key).alias("key"))
    worst = scored.where(F.col(score) < LOW_QUALITY).orderBy(score, key).limit(100).agg(F.transform(F.sort_array(F.collect_list(low)), lambda x: x["key"]).alias("lowest"))
    return scored.agg(F.round(F.avg(score), 4).alias("mean"), F.count_if(F.col(score) < LOW_QUALITY).alias("n_low")).join(worst)


def shown(metric: Column, value: Column) -> Column:
    """A metric as text: a percentage where it is one, else times."""
    return F.when(metric.isin(*AS_PERCENT), percent(value)).otherwise(F.format_string("%.2f", value))


def stress_coverage(impacts: DataFrame, key: str, scenarios: int = 3) -> DataFrame:
    """Rows (key, coverage): how many of the scenarios a portfolio was put through, 1 at most."""
    return impacts.groupBy(key).agg(F.least(F.lit(1.0), F.count_distinct("scenario") / scenarios).alias("coverage"))


def variant_coverage(changes: DataFrame, key: str, variants: int) -> DataFrame:
    """Rows (key, coverage): the share of variants that change something."""
    return changes.groupBy(key).agg(F.round(F.count_distinct("variant") / variants, 6).alias("coverage"))


def review_reasons(rows: DataFrame, key: str, reasons: dict[str, Column]) -> DataFrame:
    """Rows (key, reasons, needed): the named conditions that hold, in order, and whether any does; an unknown condition does not."""
    held = F.array_compact(F.array(*(F.when(F.coalesce(hit, F.lit(False)), F.lit(name)) for name, hit in reasons.items())))
    return rows.select(key, held.alias("reasons"), (F.size(held) > 0).alias("needed"))


def agreement(cases: DataFrame, expected: str, actual: str) -> DataFrame:
    """One row: cases and the share of them where both are alike, missing ones included."""
    return cases.agg(F.count("*").alias("n_cases"), F.round(F.avg(F.col(expected).eqNullSafe(F.col(actual)).cast("double")), 6).alias("share"))
