"""The corpus pipeline: quality rules, near-duplicates, repeated substrings, benchmark decontamination, tokens.

Defined results of all stages: an empty table stays one; null and empty texts and those of fewer than 20 words fail the
quality rules and so never reach the later stages, which alone would keep them; texts are processed whole, whatever
their length; rows are told apart by doc_id and text, so texts of one doc_id are judged on their own, and of repeated rows
the near-duplicates keep one; rows without a doc_id are judged by their text, lose no substrings and keep none from others;
ties go to the smallest doc_id; other columns, whatever their names, stay with their row up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import dart_minhash, merge_dropout, quality_rules, string_tiling, suffix_dedup
from ledgerloom.llm._shared import new_folder, remove, share_code, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and boilerplate lines of the others; a line's smallest kept document keeps it."""
    share_code(spark)
    return quality_rules.apply_quality_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest doc_id."""
    share_code(spark)
    return dart_minhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings go from all but the document of the smallest doc_id that has them; documents that are nothing else go."""
    share_code(spark)
    return suffix_dedup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; an empty benchmark keeps all."""
    share_code(spark)
    return string_tiling.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, lossless of every document."""
    share_code(spark)
    return merge_dropout.encode_documents(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("suffix_dedup", repeats), ("decontamination", decontamination), ("tokens", tokens)]

#: Signatures, suffix arrays, tilings and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; what a stage has read is removed once its own output is whole."""
    docs, folder, before = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove(spark, before)
        before = at
    return docs
