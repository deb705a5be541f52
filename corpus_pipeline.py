"""A training-data pipeline of five stages over documents.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet to the shared folder and read again as the next one's docs. Extra columns of documents are kept.

1. language_id: documents without a language (null texts, texts without a letter) go.
2. exact_dedup: of equal texts (white space runs count as one space) the row with the smallest doc_id stays.
3. near_dedup: of each group of linked texts (SimHash fingerprints within two bits, or a Jaccard similarity of 0.8
   over 5-word shingles) the row with the smallest doc_id stays.
4. decontaminate: documents that hold a benchmark item go.
5. sentencepiece: the rest is encoded; ids, n_ids and round_trip come behind the columns of documents.

Stages 2 and 3 number the rows and take rows out by that number, so doc_ids may repeat: of each group one row stays,
the one with the smallest doc_id (rows without a doc_id come last; of rows with one doc_id and equal texts any one),
and no other text goes with it. Columns of documents may have any names. Null columns, long texts and empty tables
are as each operator defines; an empty table passes all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import near_texts, op1_sentencepiece, op2_langid, op5_exact_dedup, op6_decontaminate, op7_simhash
from tessera.llm.common import fresh, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names, score = _apart(docs, "lang_pred"), _apart(docs, "score")
    kept = op2_langid.annotate(docs.withColumnsRenamed(names | score), op2_langid.train(docs)).where("lang_pred <> 'und'")
    return kept.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in (names | score).items()}).select(*docs.columns)


def _apart(docs: DataFrame, name: str) -> dict[str, str]:
    """The renaming that keeps a column of docs apart from one of this name that an operator adds."""
    return {c: fresh(docs.columns, f"in_{c}") for c in docs.columns if c.lower() == name}


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written with a number in each row, and the number's column."""
    row = fresh(docs.columns, "_row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows"), row


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = _numbered(docs)
    # the operator takes any ordered identifier: the smallest doc_id wins, then the smallest number
    ids = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")).alias("doc_id"), "text")
    gone = stored(op5_exact_dedup.exact_dedup(ids).where("NOT kept").select(F.col("doc_id.row").alias(row)), "pipeline-copies", compression="zstd")
    # only numbers meet here; adaptive execution broadcasts them while they are small
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, similarity: float = near_texts.SIMILARITY) -> DataFrame:
    rows, row = _numbered(docs)
    found = op7_simhash.near_dedup(rows.select(F.col(row).alias("doc_id"), "text"), similarity)
    found = found.select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row"))
    found = stored(rows.select(row, order.alias("order")).join(found, row), "pipeline-near", compression="zstd")
    least = stored(found.groupBy("component_id").agg(F.min("order").alias("least"), F.count("*").alias("n")).where("n > 1").select("component_id", F.col("least.row").alias("least")), "pipeline-least", compression="zstd")
    gone = stored(found.join(least, "component_id").where(F.col(row) != F.col("least")).select(row), "pipeline-gone", compression="zstd")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = _apart(docs, "contamination")
    kept = op6_decontaminate.annotate(docs.withColumnsRenamed(names), table(spark, sf_dir, "benchmark")).where(F.size("contamination") == 0).drop("contamination")
    return kept.withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_sentencepiece.annotate(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express training a network, fingerprints or alignment; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
