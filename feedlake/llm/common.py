"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def keep_ids(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id (null included) is in ``kept``; columns and repeated rows stay as they are."""
    ids = kept.select(F.col("doc_id").alias("_kept_id"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_kept_id"]), "left_semi")


def drop_ids(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id (null included) is not in ``dropped``."""
    ids = dropped.select(F.col("doc_id").alias("_dropped_id"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_dropped_id"]), "left_anti")


def let(value: Column, body) -> Column:
    """``body`` applied to ``value`` computed once: an expression used inside a lambda would run for each element."""
    return F.transform(F.array(value), body)[0]
