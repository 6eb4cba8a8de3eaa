"""Readers for entity CSV files, document JSON files, bronze lots and their manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from feedlake.sources.schemas import file_schema


def read_entity_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Quoted CSV with header and doubled quotes; an empty value is NULL in every column, text included."""
    shape = file_schema(schema) if isinstance(schema, str) else schema
    df = (spark.read.schema(shape).option("header", True).option("escape", '"').option("multiLine", False)
          .option("mode", "FAILFAST").csv(path))
    return df.select(*[
        F.nullif(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name)
        for f in shape.fields])


def write_entity_csv(df: DataFrame, path: str) -> None:
    """Counterpart of ``read_entity_csv``; timestamps keep their microseconds."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True)
     .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
     .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path))


def read_documents(spark: SparkSession, path: str, schema: StructType | str, one_array_per_file: bool = False) -> DataFrame:
    """Document files. One JSON array per file needs ``one_array_per_file``; JSON lines split and scale."""
    shape = file_schema(schema) if isinstance(schema, str) else schema
    return spark.read.schema(shape).option("multiLine", one_array_per_file).json(path)


def read_bronze_lot(spark: SparkSession, path: str) -> DataFrame:
    return read_entity_csv(spark, path, "bronze_eventos")


def read_expected_counts(spark: SparkSession, path: str, kind: str = "manifiesto") -> DataFrame:
    """(lote, entidad, esperadas) from a lot manifest or a dataset summary."""
    raw = spark.read.schema(file_schema(kind)).option("multiLine", True).json(path)
    counts, lot = ("archivos", F.col("lote")) if kind == "manifiesto" else ("conteos", F.lit("resumen"))
    return raw.select(lot.alias("lote"), F.explode(counts).alias("entidad", "esperadas"))


def compare_counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected against actual rows (``tabla``, ``filas``) with the difference; missing tables count as zero."""
    a = actual.select(F.col("tabla").alias("entidad"), F.col("filas").alias("encontradas"))
    found = F.coalesce("encontradas", F.lit(0))
    return expected.join(a, "entidad", "left").select(
        "entidad", "esperadas", found.alias("encontradas"), (found - F.col("esperadas")).alias("diferencia"))


def flatten_event(events: DataFrame, user_id: str = "usuario_id", salt: str | None = None) -> DataFrame:
    """Nested event to the flat lot row; the pseudonym takes the place of the user id."""
    from feedlake.functions.expressions import pseudonym

    who = pseudonym(F.col(user_id), salt) if salt else F.col("usuario_seudonimo")
    return events.select(
        "evento_id", who.alias("usuario_seudonimo"), "sesion_id", "contenido_id", "tipo_evento",
        F.col("ocurrido_en").cast("timestamp_ntz").alias("ocurrido_en"), "contexto.dispositivo", "contexto.canal",
        "contexto.pais", "contexto.superficie", "metricas.segundos_visibles", "metricas.porcentaje_scroll",
        "metricas.segundos_reproducidos", "metricas.porcentaje_reproducido",
        F.col("origen_recomendacion.estrategia").alias("estrategia_origen"),
        F.col("origen_recomendacion.posicion").alias("posicion_origen"),
        F.col("origen_recomendacion.variante_ab").alias("variante_ab"))
