"""From raw documents to packed training sequences: language ID, quality rules, near-duplicate removal, packing.

Each stage takes all rows that the one before it kept and returns the columns of ``documents``; the last returns a row per packed piece.
Rows with null or empty texts are rejected by the first stage (no language); every decision is the operator's own.
Rows with repeated ids are told apart by their text, rows repeated whole stay once; of near duplicates the smallest id stays, a null id comes last.
Very long texts are read whole by every stage, an empty table gives empty results, and extra columns travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import langid, minhash, packing, quality, shared
from tessitura.llm.registry import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the learned languages."""
    return langid.accept(docs, langid.train(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the production policy passes."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    return quality.verdicts(quality.ledger(rows, keep=("row",))).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return minhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), "word", end_id=1)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Naive Bayes and packing are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
