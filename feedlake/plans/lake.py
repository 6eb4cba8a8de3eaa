"""Lakehouse jobs: bronze export, silver cleaning, gold star schema, incremental lots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions import expressions as E
from feedlake.operators import metrics as M
from feedlake.sources.schemas import gold_schema

# The contract of an event, and the order in which rejections are reported.
REQUIRED = ["evento_id", "usuario_id", "contenido_id", "tipo_evento", "ocurrido_en"]
OPTIONAL = ["segundos"]
BRONZE_COLUMNS = ["evento_id", "usuario_seudonimo", "sesion_id", "contenido_id", "tipo_evento", "ocurrido_en",
                  "dispositivo", "segundos", "lote"]


# ---- bronze ---------------------------------------------------------------------------------------------

def bronze_events(events: DataFrame, lot: str, salt: str) -> DataFrame:
    """Flat event rows without user ids: the pseudonym is the only link to a person."""
    return events.select(
        F.concat(F.lit("EV-"), F.format_string("%08d", "evento_id")).alias("evento_id"),
        E.pseudonym(F.col("usuario_id"), salt).alias("usuario_seudonimo"),
        E.session_key(F.col("usuario_id"), F.col("ocurrido_en")).alias("sesion_id"), "contenido_id", "tipo_evento",
        "ocurrido_en", "dispositivo", "segundos", F.lit(lot).alias("lote"))


def write_lot(df: DataFrame, path: str) -> None:
    """Write one or more lots; running a lot again replaces exactly that lot and nothing else."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lote").parquet(path)


# ---- silver ---------------------------------------------------------------------------------------------

def silver_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed, validated and de-duplicated events, and the quarantine with a reason.

    Rows without a required value and rows with one that does not parse go to the quarantine with the column's name.
    Of the copies of an event the one of the latest lot stays, of several in one lot the latest and then the one with the
    largest values; a partial aggregate picks it before any shuffle.
    """
    typed = raw.select(
        F.expr("try_cast(evento_id AS BIGINT)").alias("evento_id"),
        F.expr("try_cast(usuario_id AS BIGINT)").alias("usuario_id"),
        F.expr("try_cast(contenido_id AS BIGINT)").alias("contenido_id"), "tipo_evento",
        F.expr("try_cast(ocurrido_en AS TIMESTAMP_NTZ)").alias("ocurrido_en"), "dispositivo",
        F.expr("try_cast(segundos AS DOUBLE)").alias("segundos"), "lote",
        *[F.col(c).isNotNull().alias(f"__{c}") for c in REQUIRED + OPTIONAL])
    reason = F.coalesce(*[
        F.when(F.col(c).isNull(), F.when(F.col(f"__{c}"), F.lit(f"formato {c}")).otherwise(F.lit(f"falta {c}")))
        for c in REQUIRED], *[F.when(F.col(c).isNull() & F.col(f"__{c}"), F.lit(f"formato {c}")) for c in OPTIONAL])
    marked = typed.withColumn("motivo_rechazo", reason).drop(*[f"__{c}" for c in REQUIRED + OPTIONAL])
    good = marked.filter(F.col("motivo_rechazo").isNull())
    order = ["lote", "ocurrido_en"]
    order += [c for c in good.columns if c not in ("evento_id", "motivo_rechazo", *order)]
    latest = good.groupBy("evento_id").agg(F.max(F.struct(*order)).alias("r")).select(
        "evento_id", *[F.col(f"r.{c}").alias(c) for c in good.columns if c not in ("evento_id", "motivo_rechazo")])
    return latest, marked.filter(F.col("motivo_rechazo").isNotNull())


def lot_balance(raw: DataFrame, silver: DataFrame, rejected: DataFrame) -> DataFrame:
    """By lot: received = accepted + rejected + repeated in a later lot."""
    r = raw.groupBy("lote").agg(F.count("*").alias("recibidas"))
    a = silver.groupBy("lote").agg(F.count("*").alias("aceptadas"))
    x = rejected.groupBy("lote").agg(F.count("*").alias("rechazadas"))
    zero = F.lit(0)
    joined = r.join(a, "lote", "left").join(x, "lote", "left").select(
        "lote", "recibidas", F.coalesce("aceptadas", zero).alias("aceptadas"),
        F.coalesce("rechazadas", zero).alias("rechazadas"))
    return joined.withColumn("repetidas", F.col("recibidas") - F.col("aceptadas") - F.col("rechazadas"))


# ---- gold -----------------------------------------------------------------------------------------------

def dim_date(spark: SparkSession, first: str, last: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("fecha"))
    return _calendar(days)


def dim_date_of(events: DataFrame, ts: str) -> DataFrame:
    """Every day from the first to the last event, days without events included."""
    span = events.agg(F.min(ts).cast("date").alias("a"), F.max(ts).cast("date").alias("b"))
    return _calendar(span.select(F.explode(F.sequence("a", "b")).alias("fecha")))


def _calendar(days: DataFrame) -> DataFrame:
    parts = E.calendar_columns(F.col("fecha"))
    return days.select(parts["fecha_key"].alias("fecha_key"), "fecha",
                       *[c.alias(n) for n, c in parts.items() if n != "fecha_key"])


def dim_content(contents: DataFrame, types: DataFrame, tree: DataFrame) -> DataFrame:
    """Contents with the root section written into the row."""
    t = types.select(F.col("id").alias("tipo_contenido_id"), F.col("codigo").alias("tipo_contenido"))
    s = tree.select("seccion_id", F.col("nombre").alias("seccion"), "seccion_raiz")
    return contents.join(t, "tipo_contenido_id").join(s, "seccion_id").select(
        F.col("id").alias("contenido_key"), F.col("id").alias("contenido_id"), "titulo", "tipo_contenido", "seccion",
        "seccion_raiz", "nivel_acceso", "estado", F.col("fecha_publicacion").cast("date").alias("fecha_publicacion"))


def dim_user(anonymised: DataFrame) -> DataFrame:
    """Anonymised users; the key is a hash of the pseudonym, the sign-up month an integer yyyyMM."""
    return anonymised.select(
        F.xxhash64("seudonimo").alias("usuario_key"), "seudonimo", "pais", "tramo_etario", "plan",
        F.date_format("mes_alta", "yyyyMM").cast("int").alias("mes_alta"))


def dim_strategy(strategies: DataFrame) -> DataFrame:
    return strategies.select(F.col("id").alias("estrategia_key"), "codigo", "version", "motor")


def gold_tables(events: DataFrame, impressions: DataFrame, contents: DataFrame, types: DataFrame, sections: DataFrame,
                tree: DataFrame, strategies: DataFrame, anonymised: DataFrame, as_of) -> dict[str, DataFrame]:
    """The star schema: four dimensions, two facts, one aggregate."""
    return {
        "dim_fecha": dim_date_of(events, "ocurrido_en"),
        "dim_contenido": dim_content(contents, types, tree),
        "dim_usuario_anonimizado": dim_user(anonymised),
        "dim_estrategia": dim_strategy(strategies),
        "fact_consumo_diario": M.daily_consumption(events),
        "fact_impresiones_diario": M.daily_impressions(impressions),
        "agg_popularidad": M.popularity_by_window(events, contents, sections, as_of),
    }


def build_gold(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Rebuild every gold table as one new version and publish all of them together."""
    from feedlake.sources.loading import load_all_or_nothing

    shaped = {}
    for name, df in tables.items():
        contract = gold_schema(name)
        shaped[name] = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in contract.fields])
    return load_all_or_nothing(shaped, folder)
