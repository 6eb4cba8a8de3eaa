"""Queries of the operators in this package: each applies one operator to its whole table.

``queries()`` and ``oracle_sql()`` have the driver's form: callables of (spark, folder), and DuckDB texts where SQL can
say the same.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm import chat, decontam, jaccard, language, lexical, outliers, pieces, repeats, sql, tokenids, toxicity, urls, warc, whitening
from feedlake.llm.common import fold, table
from feedlake.session import cut_lineage


END_ID = 2


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.where(F.coalesce(fold(F.col("doc_id"), 5) != 0, F.lit(False))))
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return model.score(docs).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return chat.digests(cut_lineage(chat.format_conversations(turns.unionByName(extra))))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.read(warc.archive(table(spark, folder, "pages"))).drop("url")


def op4_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    return tokenids.read(cut_lineage(tokenids.write(table(spark, folder, "documents"), tokenizer, END_ID)))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), URL_RULES)


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    found = language.predict(docs, language.learn(docs.where(~held_out)))
    return found.withColumn("held_out", held_out)


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(table(spark, folder, "documents"), pieces.Model.load(public_tokenizers.path("piece_bpe_32k.model")))


def op9_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes(table(spark, folder, "documents"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.judge(table(spark, folder, "documents"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen whitened components of every usable vector of ``embeddings``."""
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the passages of 400 bytes that ``documents`` repeats."""
    return repeats.remove(table(spark, folder, "documents")).drop("spans")


def op13_lexical(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty best documents of ``documents`` for every row of ``benchmark``."""
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_chat": op2_chat,
        "op3_warc": op3_warc,
        "op4_token_ids": op4_token_ids,
        "op5_url_filter": op5_url_filter,
        "op6_decontamination": op6_decontamination,
        "op7_language": op7_language,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_quality_rules": op10_quality_rules,
        "op11_whitening": op11_whitening,
        "op12_repeats": op12_repeats,
        "op13_lexical": op13_lexical,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": sql.CHAT, "op3_warc": sql.WARC, "op13_lexical": sql.SEARCH}
