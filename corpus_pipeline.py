"""A training-data pipeline over `documents`.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept, and returns the
columns of documents, except the last, which returns the encoding of each document. A stage's result
is written as Parquet and read again as the next one's docs.

All stages: null and empty texts count as empty; columns beside doc_id and text are carried along
unread, whatever their names; an empty table gives an empty table; what a stage does with ties,
repeated rows and rows without an id its own docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import op1_quality, op2_decontaminate, op3_near_dedup, op4_exact_dedup, op10_sentencepiece, prefilter
from cairnspark.llm.shared import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the classifier scores 0.3 or more; it learns from `labels` and docs. Each row goes by its
    text alone: repeated rows and rows without an id are judged like any other."""
    return op1_quality.keep_good(docs, op1_quality.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, the one with the largest doc_id stays; of repeated rows of that id and text, one.
    Rows without an id stay."""
    return op4_exact_dedup.without_copies(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the row with the least doc_id stays. Rows are told apart by id and text; repeated
    rows stay or go together; rows without an id stay."""
    key = lambda i, md5: F.concat(i.cast("string"), F.lit(":"), md5)
    gone = op3_near_dedup.near_classes(docs).filter("NOT kept").select(key(F.col("doc_id"), F.lower(F.hex("text_md5"))))
    text = F.coalesce(F.col("text"), F.lit(""))
    return prefilter.without(docs, key(F.col("doc_id").cast("long"), F.md5(text.cast("binary"))), staged(gone.distinct(), "gone"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents contaminated with passages of `benchmark`; each row is judged by its text."""
    return op2_decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep_columns=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids and decoded text of every row, as counts and digests."""
    return op10_sentencepiece.encode_digest(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("sentencepiece", encode)]

#: The classifier, the sampling and the encoding can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
