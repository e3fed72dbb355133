"""Corpus pipeline: quality rules, language identification, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir), calls one operator over all of docs and applies its decisions;
all but the last return the columns of docs. Null texts fail the counting rules. An empty table stays
empty. A row that repeats another leaves as its near duplicate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common, language_id, queries
from quillspark.llm.jaccard_join import near_duplicates
from quillspark.llm.packing import pack_documents
from quillspark.llm.quality_rules import quality_rules

#: A text whose nearest language is so far away is none of the learned languages, whatever least_score() learns from the documents.
LEAST_LANGUAGE_SCORE = 0.15
#: Bitmaps that go to every task at most, 4 KB for each 32,768 row numbers; more rows are joined by their numbers.
MOST_BITMAPS = 4096


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counting rules and the log-likelihood-ratio threshold, which is balanced by language."""
    judged = quality_rules(docs, common.read(spark, sf_dir, "labels"), keep=docs.columns, lang="lang")
    return judged.where(F.col(common.unused("kept", docs.columns))).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose nearest language is near enough, by a score learned from labelled documents."""
    profiles = language_id.learn(docs)
    least = language_id.least_score(docs, profiles, LEAST_LANGUAGE_SCORE)
    judged = language_id.identify(docs, profiles, keep=docs.columns)
    found, score = (F.col(common.unused(n, docs.columns)) for n in ("lang_pred", "score"))
    return judged.where((found != language_id.UNKNOWN) & (score >= least)).select(*docs.columns)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id (a null one comes last).

    Rows have numbers of their own, so rows that repeat a doc_id, or have none, are judged by their texts, and no two
    are taken for one another. Of rows alike in a text without words, which is near no other, one stays for each doc_id.
    """
    row, group, late, words = (common.unused(n, docs.columns) for n in ("_row", "_group", "_late", "_words"))
    held = _numbered(spark, docs, row)
    found = near_duplicates(held.select(row, "text"), key=row).select(row, F.col("component_id").alias(group), F.col("n_shingles").alias(words))
    keys = common.Scratch(spark, "near").write(held.select(row, "doc_id").join(found, row), "groups")
    least = F.min(F.struct(F.col("doc_id").isNull().alias(late), "doc_id", row)).alias("first")
    first = keys.where(F.col(words) > 0).groupBy(group).agg(least).select(F.col(f"first.{row}").alias(row))
    bare = keys.where(F.col(words) == 0).select(row)
    alone = _rows_of(held, bare, row).dropDuplicates(["doc_id", "text"])
    return _rows_of(held, first, row).unionByName(alone).select(*docs.columns)


def _numbered(spark: SparkSession, docs: DataFrame, row: str) -> DataFrame:
    """docs with a number of each row that is the same at each reading: its place in the files, if docs is all rows of its files, else docs is written."""
    file, at, base = (common.unused(n, docs.columns) for n in ("_file", "_at", "_base"))
    placed = _placed(docs, file, at)
    if placed is not None:
        bits = F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(at)))
        seen = placed.groupBy(file, F.bitmap_bucket_number(at)).agg(F.count("*").alias("n"), bits.alias("places"), F.max(at).alias("last"))
        files = sorted(seen.groupBy(file).agg(F.sum("n"), F.sum("places"), F.max("last")).collect(), key=repr)
        # As many rows as places, and no place left out: no row came twice or went.
        if all(n == places == (-1 if last is None else last) + 1 for _, n, places, last in files):
            starts, before = [], 0
            for name, n, *_ in files:
                starts.append((name, before))
                before += n
            starts = spark.createDataFrame(starts, f"{file} string, {base} long")
            return placed.join(F.broadcast(starts), file).select(*docs.columns, (F.col(base) + F.col(at)).alias(row))
    return common.Scratch(spark, "near").write(docs.withColumn(row, F.monotonically_increasing_id()), "rows")


def _placed(docs: DataFrame, file: str, at: str) -> DataFrame | None:
    """docs with the file and the place in it that each row is read from; None where rows have no such place."""
    if "_metadata" in (c.lower() for c in docs.columns):
        return None
    try:
        return docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
    except AnalysisException:
        return None


def _rows_of(held: DataFrame, chosen: DataFrame, row: str) -> DataFrame:
    """Rows of held whose number is among the chosen: a bit for each number goes to the tasks, so that no text is shuffled."""
    bucket, bits = (common.unused(n, held.columns) for n in ("_bucket", "_bits"))
    maps = chosen.groupBy(F.bitmap_bucket_number(row).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(row)).alias(bits))
    maps = common.Scratch(held.sparkSession, "near").write(maps, "bitmaps")
    if maps.count() > MOST_BITMAPS:
        return held.join(chosen, row, "left_semi")
    at = F.bitmap_bit_position(row)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    near = held.withColumn(bucket, F.bitmap_bucket_number(row)).join(F.broadcast(maps), bucket)
    return near.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*held.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as packed into sequences."""
    return pack_documents(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicate_removal),
    ("packing", packing),
]

#: The stages' models, components and packings are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's input."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
