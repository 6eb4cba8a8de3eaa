"""Literal search, embedding source text and fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.functions import expressions as E
from feedlake.functions.ordering import top_per_group
from feedlake.session import cut_lineage


def embedding_sources(contents: DataFrame, sections: DataFrame, content_tags: DataFrame) -> DataFrame:
    """Text that stands for a content: section, title, standfirst and its tags in alphabetical order.

    A content has a handful of tags, one per distinct word of an editorial vocabulary.
    """
    tags = content_tags.groupBy("contenido_id").agg(F.collect_set("etiqueta").alias("etiquetas"))
    s = sections.select(F.col("id").alias("seccion_id"), F.col("nombre").alias("seccion"))
    return contents.select(F.col("id").alias("contenido_id"), "titulo", "bajada", "seccion_id").join(s, "seccion_id").join(
        tags, "contenido_id", "left").select("contenido_id", E.embedding_text(
            F.col("seccion"), F.col("titulo"), F.col("bajada"),
            F.coalesce("etiquetas", F.array().cast("array<string>"))).alias("texto_fuente"))


# ---- literal search --------------------------------------------------------------------------------

def without_stop_words(words: DataFrame, column: str, language: str) -> DataFrame:
    """Rows whose word is not in Spark's own stop-word list of the language."""
    from pyspark.ml.feature import StopWordsRemover

    stop = StopWordsRemover.loadDefaultStopWords(language)
    return words.filter(~F.col(column).isin(stop))


def postings(docs: DataFrame, language: str | None = "spanish") -> DataFrame:
    """Inverted index (id, termino, tf) of whole texts ``id``, ``texto``."""
    words = docs.select("id", F.explode(E.tokens(F.col("texto"))).alias("palabra"))
    if language:
        words = without_stop_words(words, "palabra", language)
    return words.groupBy("id", E.stem(F.col("palabra")).alias("termino")).agg(F.count("*").alias("tf"))


def _hits(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, termino, tf) of the searched terms only."""
    stems = F.transform(E.tokens(F.col("texto")), E.stem)
    words = docs.select("id", F.explode(stems).alias("termino"))
    return words.join(wanted, "termino", "left_semi").groupBy("id", "termino").agg(F.count("*").alias("tf"))


def literal_search(docs: DataFrame, searches: DataFrame, k: int, language: str | None = "spanish",
                   index: DataFrame | None = None) -> DataFrame:
    """Top documents (q, j, score, puesto) of each search (q, texto).

    A document scores, for each term of the search, (1 + ln tf) * ln(1 + documents / documents with the term).
    The documents are read once: their postings for the searched terms are kept and used for both factors.
    """
    terms = searches.select("q", F.explode(E.tokens(F.col("texto"))).alias("palabra"))
    if language:
        terms = without_stop_words(terms, "palabra", language)
    terms = terms.select("q", E.stem(F.col("palabra")).alias("termino")).distinct()
    wanted = terms.select("termino").distinct()
    hits = cut_lineage(_hits(docs, wanted) if index is None else index.join(wanted, "termino", "left_semi"))
    total = docs.agg(F.count("*").alias("n")).scalar()
    idf = hits.groupBy("termino").agg(F.count("*").alias("df")).select(
        "termino", F.log(1.0 + total / F.col("df")).alias("idf"))
    weighted = terms.join(idf, "termino")
    scored = hits.join(weighted, "termino").groupBy("q", F.col("id").alias("j")).agg(
        F.round(F.sum((1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf")), 6).alias("score"))
    return top_per_group(scored, ["q"], [F.col("score").desc(), F.col("j").asc()], k, "puesto")
