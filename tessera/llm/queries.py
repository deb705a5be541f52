"""The registered queries of this subpackage: opN_<name> and pipeline, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tessera.llm import op10_chat, op1_sentencepiece, op2_langid, op3_secrets, op4_url_filter, op5_exact_dedup, op6_decontaminate, op7_simhash, op8_licenses, op9_warc
from tessera.llm.common import table


def op1_sentencepiece_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_sentencepiece.encode_documents(table(spark, sf_dir, "documents"))


def op2_langid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_langid.language_id(table(spark, sf_dir, "documents"))


def op3_secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op4_url_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_url_filter.judge(table(spark, sf_dir, "pages"))


def op5_exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_simhash.near_dedup(table(spark, sf_dir, "documents"))


def op8_licenses_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_licenses.licenses(table(spark, sf_dir, "documents"))


def op9_warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_warc.archive_and_read(table(spark, sf_dir, "pages"))


def op10_chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_chat.digests(op10_chat.format_conversations(op10_chat.with_probe(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece_query,
        "op2_langid": op2_langid_query,
        "op3_secrets": op3_secrets_query,
        "op4_url_filter": op4_url_filter_query,
        "op5_exact_dedup": op5_exact_dedup_query,
        "op6_decontaminate": op6_decontaminate_query,
        "op7_simhash": op7_simhash_query,
        "op8_licenses": op8_licenses_query,
        "op9_warc": op9_warc_query,
        "op10_chat": op10_chat_query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filter": op4_url_filter.sql(),
        "op5_exact_dedup": op5_exact_dedup.SQL,
        "op8_licenses": op8_licenses.sql(),
        "op9_warc": op9_warc.SQL,
        "op10_chat": op10_chat.SQL,
    }
