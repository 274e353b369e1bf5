"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnspark.llm import op1_quality, op2_decontaminate, op3_near_dedup, op4_exact_dedup, op5_lm_score, op6_token_files, op7_token_counts, op8_chat_format, op9_pii, op10_sentencepiece, op11_line_dedup, op12_fill_middle, op13_periodic_runs
from cairnspark.llm.shared import table


def op1_quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op1_quality.score(docs, op1_quality.train(docs, table(spark, sf_dir, "labels")))


def op2_decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest", "longest_item", "longest_at", "longest_item_at")


def op3_near_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_near_dedup.near_classes(table(spark, sf_dir, "documents")).drop("text_md5")


def op4_exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op5_lm_score_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_lm_score.scores(table(spark, sf_dir, "documents"))


def op6_token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_token_files.round_trip(table(spark, sf_dir, "documents"))


def op7_token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_token_counts.token_counts(table(spark, sf_dir, "documents"))


def op8_chat_format_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return op8_chat_format.round_trip(rows.unionByName(own))


def op9_pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op9_pii.detect(docs, op9_pii.train(docs))


def op10_sentencepiece_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_sentencepiece.encode_digest(table(spark, sf_dir, "documents"))


def op11_line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_line_dedup.digests(table(spark, sf_dir, "documents"))


def op12_fill_middle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_periodic_runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_periodic_runs.digests(op13_periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), planted=True))


QUERIES = {
    "op1_quality": op1_quality_query,
    "op2_decontaminate": op2_decontaminate_query,
    "op3_near_dedup": op3_near_dedup_query,
    "op4_exact_dedup": op4_exact_dedup_query,
    "op5_lm_score": op5_lm_score_query,
    "op6_token_files": op6_token_files_query,
    "op7_token_counts": op7_token_counts_query,
    "op8_chat_format": op8_chat_format_query,
    "op9_pii": op9_pii_query,
    "op10_sentencepiece": op10_sentencepiece_query,
    "op11_line_dedup": op11_line_dedup_query,
    "op12_fill_middle": op12_fill_middle_query,
    "op13_periodic_runs": op13_periodic_runs_query,
}
ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": op2_decontaminate.SQL,
    "op4_exact_dedup": op4_exact_dedup.SQL,
    "op8_chat_format": op8_chat_format.SQL,
    "op11_line_dedup": op11_line_dedup.SQL,
    "op12_fill_middle": op12_fill_middle.SQL,
}
