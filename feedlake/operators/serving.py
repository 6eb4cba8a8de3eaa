"""Serving tables: keyed rows with the instant they were computed and the instant they expire.

A ranking or set is stored as one row per member, never as one array per key, so no key has a size limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions import expressions as E
from feedlake.operators.ranking import top_by_section, top_global

# Base lifetime in seconds and its multiple for each kind of key.
TTL_SECONDS = 900
TTL_FACTOR = {"ranking": 1, "vistos": 8, "features": 8, "meta": 4}


def _stamp(df: DataFrame, kind: str, as_of, ttl: int) -> DataFrame:
    at = E.literal_ts(as_of)
    return df.withColumn("calculado_en", at).withColumn(
        "expira_en", at + F.make_dt_interval(secs=F.lit(float(ttl * TTL_FACTOR[kind]))))


def _member() -> Column:
    return F.col("contenido_id").cast("string").alias("miembro")


def trending_global(trending: DataFrame, n: int, as_of, ttl: int = TTL_SECONDS) -> DataFrame:
    rows = top_global(trending, n).select(F.lit("rec:trending:global").alias("clave"), _member(), "score")
    return _stamp(rows, "ranking", as_of, ttl)


def trending_by_section(trending: DataFrame, n: int, as_of, ttl: int = TTL_SECONDS) -> DataFrame:
    rows = top_by_section(trending, n).select(
        F.concat(F.lit("rec:trending:seccion:"), "seccion_slug").alias("clave"), _member(), "score")
    return _stamp(rows, "ranking", as_of, ttl)


def user_top(feed: DataFrame, as_of, ttl: int = TTL_SECONDS) -> DataFrame:
    rows = feed.select(F.concat(F.lit("rec:usuario:"), "usuario_id", F.lit(":top")).alias("clave"), _member(), "score")
    return _stamp(rows, "ranking", as_of, ttl)


def user_seen(events: DataFrame, as_of, ttl: int = TTL_SECONDS) -> DataFrame:
    rows = events.select("usuario_id", "contenido_id").distinct().select(
        F.concat(F.lit("usuario:"), "usuario_id", F.lit(":vistos")).alias("clave"), _member())
    return _stamp(rows, "vistos", as_of, ttl)


def user_seen_since_last(events: DataFrame, ttl: int = TTL_SECONDS) -> DataFrame:
    """Seen set whose members expire a fixed time after they were last seen."""
    last = events.groupBy("usuario_id", "contenido_id").agg(F.max("ocurrido_en").alias("calculado_en"))
    return last.select(
        F.concat(F.lit("usuario:"), "usuario_id", F.lit(":vistos")).alias("clave"), _member(), "calculado_en",
        (F.col("calculado_en") + F.make_dt_interval(secs=F.lit(float(ttl * TTL_FACTOR["vistos"])))).alias("expira_en"))


def user_features(features: DataFrame, as_of, ttl: int = TTL_SECONDS) -> DataFrame:
    rows = features.withColumn("clave", F.concat(F.lit("usuario:"), "usuario_id", F.lit(":features"))).drop("usuario_id")
    return _stamp(rows, "features", as_of, ttl)


def content_metadata(publishable: DataFrame, as_of, ttl: int = TTL_SECONDS) -> DataFrame:
    """Only publishable contents are cached: what may not be shown never leaves the catalogue."""
    rows = publishable.select(F.concat(F.lit("contenido:"), "contenido_id", F.lit(":meta")).alias("clave"), "titulo",
                              "seccion", "tipo_contenido", "nivel_acceso")
    return _stamp(rows, "meta", as_of, ttl)


def live(rows: DataFrame, now) -> DataFrame:
    return rows.filter(F.col("expira_en") > E.literal_ts(now))


def publish(tables: dict[str, DataFrame], path: str) -> None:
    """A new version of each named serving table; readers keep the one before until it is listed."""
    from feedlake.sources.loading import publish_version

    for name, df in tables.items():
        publish_version(df, f"{path}/{name}")


def read_published(spark: SparkSession, path: str, tables: list[str]) -> DataFrame:
    """The current versions of the named tables, one below the other."""
    from feedlake.sources.loading import current_version

    parts = [spark.read.parquet(f"{path}/{name}/{current_version(spark, f'{path}/{name}')}").withColumn("tabla", F.lit(name)) for name in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
