"""Queries over the driver's tables, one for each operator, and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat_format, common, decontamination


def tokenizer_path(name: str) -> str:
    """A public vocabulary's place, as the installed package gives it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import extract

    return extract(common.read(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(common.read(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"), lang="lang")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(common.read(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(common.read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(common.read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(common.read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_chats

    return format_chats(common.read(spark, sf_dir, "conversations"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edited_fingerprints

    return edited_fingerprints(common.read(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_encoding import encode_pieces

    return encode_pieces(common.read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), digests=True)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(common.read(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(common.read(spark, sf_dir, "embeddings"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digests(decontamination.contamination(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_warc": op2_warc,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_fingerprints": op9_fingerprints,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_decontamination": op13_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op8_chat_formatting": chat_format.ORACLE_SQL,
    "op12_centroid_clustering": centroids.oracle_sql(),
    "op13_decontamination": decontamination.ORACLE_SQL,
}
