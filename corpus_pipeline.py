"""Corpus pipeline: language, quality, near copies, benchmark passages, token ids - each stage on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm import decontam, jaccard, language, outliers, pieces
from feedlake.llm.common import drop_ids, keep_ids, table
from feedlake.session import cut_lineage

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents without an identifiable language: no letters, or two languages equally near."""
    found = language.predict(docs, language.learn(docs))
    return keep_ids(docs, found.where((F.col("lang_pred") != "und") & (F.col("score") > 0)))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that fail the base rules or are outliers of their language and source."""
    return keep_ids(docs, outliers.judge(docs).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep the document with the smallest id of each class of similar texts."""
    return keep_ids(docs, jaccard.classes(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that hold a benchmark item, its parts in any order."""
    return drop_ids(docs, decontam.leaks(docs, table(spark, folder, "benchmark")))


def encode_pieces(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of what is left."""
    return pieces.encode(docs, pieces.Model.load(MODEL))


STAGES = [
    ("language", identify_language),
    ("quality", apply_quality_rules),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pieces", encode_pieces),
]

#: Rank-order profiles and greedy tilings have no SQL form; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, folder, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
