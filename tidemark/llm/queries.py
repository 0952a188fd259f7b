"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat_format, decontaminate, html_extract, importance, language_id, line_dedup, media_matroska, quality_classifier, ranked_search, sentence_pieces, simhash_dedup, substring_dedup, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(_table(spark, sf_dir, "documents"))


def op7_media_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_matroska.digest(media_matroska.store(_table(spark, sf_dir, "documents")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = chat_format.with_extra(_table(spark, sf_dir, "conversations"))
    return chat_format.digest(chat_format.format_conversations(conversations))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digest(_table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.digest(importance.importance(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_ALL = (
    op1_quality_classifier, op2_substring_dedup, op3_decontamination, op4_html_extract, op5_simhash_dedup, op6_line_dedup,
    op7_media_matroska, op8_url_filter, op9_chat_format, op10_sentence_pieces,
    op11_importance, op12_language_id, op13_ranked_search,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substring_dedup.ORACLE,
        "op3_decontamination": decontaminate.ORACLE,
        "op8_url_filter": url_filter.ORACLE,
        "op9_chat_format": chat_format.ORACLE,
        "op11_importance": importance.ORACLE,
        "op13_ranked_search": ranked_search.ORACLE,
    }
