"""Change log between two snapshots, append-only storage, replay.

A snapshot diff cannot see an update that left the row as it was; a row trigger would have logged it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.functions import expressions as E


def change_log(before: DataFrame, after: DataFrame, schema: str, table: str, at, key: str = "id",
               user_db: str = "feedlake", user_app: int | None = None, sequence: int = 0) -> DataFrame:
    """INSERT, UPDATE and DELETE rows with before and after images as JSON, each of its own table's columns.

    ``secuencia`` orders changes at one instant; give each snapshot taken at the same instant the next number.
    """
    b = before.select(F.col(key).alias("__b"), F.to_json(F.struct(*before.columns)).alias("datos_anteriores"))
    a = after.select(F.col(key).alias("__a"), F.to_json(F.struct(*after.columns)).alias("datos_nuevos"))
    joined = b.join(a, F.col("__b") == F.col("__a"), "full_outer")
    action = (F.when(F.col("__b").isNull(), "INSERT").when(F.col("__a").isNull(), "DELETE")
              .when(F.col("datos_anteriores") != F.col("datos_nuevos"), "UPDATE"))
    return joined.withColumn("accion", action).filter(F.col("accion").isNotNull()).select(
        E.literal_ts(at).alias("ocurrido_en"), F.lit(sequence).cast("long").alias("secuencia"), F.lit(user_db).alias("usuario_bd"),
        F.lit(user_app).cast("long").alias("usuario_app"), "accion", F.lit(schema).alias("esquema"),
        F.lit(table).alias("tabla"), F.coalesce("__a", "__b").cast("string").alias("registro_id"),
        "datos_anteriores", "datos_nuevos")


def append_log(log: DataFrame, path: str) -> None:
    """The log only grows: there is no other way to write it."""
    log.write.mode("append").partitionBy("tabla").parquet(path)


def log_of_table(log: DataFrame, table: str, since, until) -> DataFrame:
    return log.filter((F.col("tabla") == table) & (F.col("ocurrido_en") >= E.literal_ts(since))
                      & (F.col("ocurrido_en") < E.literal_ts(until))).orderBy(
        F.col("ocurrido_en").desc(), F.col("registro_id").asc())


def log_of_user(log: DataFrame, user_app: int) -> DataFrame:
    return log.filter(F.col("usuario_app") == user_app).orderBy(F.col("ocurrido_en").desc(), F.col("registro_id").asc())


def state_at(log: DataFrame, table: str, at) -> DataFrame:
    """Last image of every record at or before ``at``, by instant and sequence; deleted records drop out."""
    past = log.filter((F.col("tabla") == table) & (F.col("ocurrido_en") <= E.literal_ts(at)))
    return past.groupBy("registro_id").agg(
        F.max_by(F.struct("accion", "datos_nuevos"), F.struct("ocurrido_en", "secuencia")).alias("u")).select(
        "registro_id", F.col("u.accion").alias("accion"), F.col("u.datos_nuevos").alias("datos")).filter(
        F.col("accion") != "DELETE").select("registro_id", "datos")
