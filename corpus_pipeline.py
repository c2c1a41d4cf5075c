"""The corpus pipeline: language ID, exact dedup, near-dedup, sanitising and packing, each over what the one before kept.

Every stage takes (spark, docs, sf_dir), where docs is a table read from Parquet, and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the columns of docs, whatever their names are; doc_id and text
(and lang, where a model is learned) are read. Each stage takes tables without rows, which stay empty, and texts of any length, whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.exact_dedup import drop_copies
from textloom.llm.langid import keep_identified
from textloom.llm.packing import pack
from textloom.llm.pii import sanitise
from textloom.llm.scratch import written
from textloom.llm.simhash import drop_near_copies


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the model is learned from docs' own labels. Documents without a letter (null and empty ones too) go, as
    do those whose best language is too unlikely; repeated rows and rows without doc_id are judged each by its text. Without any label all go."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for blanks: the longest, then the smallest doc_id (null last), then the first row, so one of
    repeated rows stays. Null and empty texts are one group."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link: the smallest doc_id (null last), then the first row. Null and empty texts have fingerprint
    zero and link with each other."""
    return drop_near_copies(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data generalised and disclosing terms generalised or removed; no row goes, null texts stay null, and n_chars, where
    there is one, follows the text."""
    return sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences; null and empty texts are the end id alone, and rows with one doc_id, or none, are packed each by itself."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("pii", private), ("packing", packed)]

#: Trained models, SimHash and subword tokens are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
