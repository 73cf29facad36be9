"""A corpus pipeline of five of the text operators.

Each stage takes the documents that the stage before it left and returns the columns of documents;
the last returns packed pieces.

1. language ID: a document whose language can't be told, without text or without a letter, is rejected and goes; one without
   a label gets the predicted language.  The classifier learns from labels of the stage's own documents, outside the held-out fold;
   without any label it tells no language, but what has no letter goes all the same.
2. n-gram Jaccard join: of each group of near-duplicates the document of the smallest doc_id stays; documents without
   words are no duplicates of each other.
3. substring dedup: words covered by 13-word windows that an earlier document holds are removed.  A text that
   loses none stays as it is, white space included; in others the words left are joined by one space; a document
   that loses all its words goes.
4. secret scan: secrets are masked in the text.
5. packing: documents become pieces of token sequences.

``n_chars`` follows the text.  Rows without a doc_id are in no group and no order: they stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.llm import language_id, packing, secret_scan, set_join, substring_dedup
from stockroom.session import cut_lineage


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The documents' columns, with n_chars as their text is now."""
    return docs.select([F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, whose language is their label or else the one predicted."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    told = language_id.predict(docs.select(F.struct("*").alias("row"), "text"), model, keep=["row", "text"])
    told = told.where(F.col("lang_pred") != language_id.UNKNOWN if model.langs else F.col("text").rlike("\\p{L}"))
    lang = F.coalesce("row.lang", F.nullif("lang_pred", F.lit(language_id.UNKNOWN)))
    return told.select([lang.alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return set_join.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that earlier documents hold."""
    return _sized(substring_dedup.clean_texts(docs), docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked."""
    return _sized(secret_scan.redact_secrets(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", passages),
    ("secret_scan", secrets),
    ("packing", pack),
]

# Kernel ridge regression and tokenizer ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))  # the next stage reads it more than once
    return STAGES[-1][1](spark, docs, sf_dir)
