"""A frame and a SQL text for every table whose rules and keys are declared in ``operators.quality``.

Tables that the driver does not give are built from those it gives: assignments and experiments from impressions, loads
from the lots, similar items from contents that stand next to each other in a basket. Each frame carries planted defects,
written as expressions that Spark and the checking SQL read alike, so that every rule and key has something to find.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.operators import metrics as M
from feedlake.operators import privacy as N
from feedlake.operators import quality as Q
from feedlake.plans import lake, metrics_queries, people_queries, vectors_queries
from feedlake.sources import loading
from feedlake.sources.domain import AS_OF, Domain

LEDGER_SQL = """
    SELECT 'lote_01' AS lote_id, 'eventos' AS entidad, count(*) AS filas_recibidas,
           count(*) FILTER (WHERE usuario_id IS NOT NULL) AS filas_aceptadas,
           count(*) FILTER (WHERE usuario_id IS NULL) AS filas_rechazadas, 'COMPLETADO' AS estado FROM lotes
    UNION ALL SELECT 'lote_01', 'usuarios', count(*), count(*), 0, 'COMPLETADO' FROM usuarios"""


def ledger(d: Domain) -> DataFrame:
    good, _ = Q.split_required(d.lotes, ["usuario_id", "tipo_evento", "ocurrido_en"])
    return loading.ledger("lote_01", {"eventos": d.lotes, "usuarios": d.usuarios}, {"eventos": good, "usuarios": d.usuarios})


@dataclass(frozen=True)
class Declared:
    """SQL source, frame, planted values by column, and the rows that are planted twice."""

    sql: str
    frame: Callable[[Domain], DataFrame]
    planted: dict[str, str] = field(default_factory=dict)
    twice: str = "FALSE"


def _where(column: str, condition: str, value: str) -> dict[str, str]:
    return {column: f"CASE WHEN {condition} THEN {value} ELSE {column} END"}


def _preferences(d: Domain) -> DataFrame:
    return d.preferencias.select("usuario_id", "seccion_id", F.col("etiqueta").alias("etiqueta_id"), "tipo_preferencia",
                                 (F.col("usuario_id") % 10 / F.lit(10.0)).alias("peso"))


def _experiments(d: Domain) -> DataFrame:
    return d.impresiones.groupBy(F.col("estrategia_id").alias("id")).agg(
        F.min("mostrado_en").alias("desde"), F.max("mostrado_en").alias("hasta"))


def _assignments(d: Domain) -> DataFrame:
    return d.impresiones.select(F.col("estrategia_id").alias("experimento_id"), "usuario_id", F.col("variante_ab").alias("variante")).distinct()


def _similar(d: Domain) -> DataFrame:
    following = F.lead("contenido_id").over(Window.partitionBy("usuario_id").orderBy("contenido_id"))
    pairs = d.cesta.distinct().withColumn("contenido_similar_id", following).filter("contenido_similar_id IS NOT NULL")
    return pairs.groupBy("contenido_id", "contenido_similar_id").agg(F.count("*").cast("double").alias("score")).withColumn(
        "origen", F.lit("coocurrencia"))


def _accesses(d: Domain) -> DataFrame:
    good = N.sensitive_access("usuarios.email_cifrado", "reclamo", d.usuarios.select("id"), "analista_1", 7, AS_OF)
    return good.unionByName(good.withColumn("filas_afectadas", -F.col("filas_afectadas")))


_LOG_SQL = f"""(SELECT accion, registro_id, nullif(datos_anteriores, '') AS datos_anteriores, nullif(datos_nuevos, '') AS datos_nuevos
    FROM ({people_queries.LOG_SQL}))"""
_DAYS_SQL = """(SELECT CAST(strftime(f, '%Y%m%d') AS INT) AS fecha_key FROM (SELECT unnest(generate_series(
    min(date_trunc('day', ocurrido_en)), max(date_trunc('day', ocurrido_en)), INTERVAL 1 DAY)) AS f FROM eventos))"""
_SIMILAR_SQL = """(SELECT contenido_id, contenido_similar_id, CAST(count(*) AS DOUBLE) AS score, 'coocurrencia' AS origen FROM (
    SELECT contenido_id, lead(contenido_id) OVER (PARTITION BY usuario_id ORDER BY contenido_id) AS contenido_similar_id
    FROM (SELECT DISTINCT usuario_id, contenido_id FROM cesta)) WHERE contenido_similar_id IS NOT NULL GROUP BY 1, 2)"""

TABLES: dict[str, Declared] = {
    "planes": Declared("planes", lambda d: d.planes, _where("nivel_acceso", "id = 2", "7"), "id = 3"),
    "tipos_contenido": Declared("tipos_contenido", lambda d: d.tipos_contenido, twice="id = 4"),
    "usuarios": Declared(
        f"(SELECT *, {people_queries._hmac_sql('email', people_queries.HASH_KEY)} AS email_hash, {people_queries.PSEUDO} AS seudonimo FROM usuarios)",
        people_queries.protected, _where("anio_nacimiento", "id % 59 = 0", "1900"), "id % 83 = 0"),
    "usuarios_roles": Declared("(SELECT usuario_id, plan_id AS rol_id FROM suscripciones)",
                               lambda d: d.suscripciones.select("usuario_id", F.col("plan_id").alias("rol_id"))),
    "suscripciones": Declared(
        "suscripciones", lambda d: d.suscripciones,
        _where("estado", "id % 61 = 0", "'rota'") | _where("hasta", "id % 67 = 0", "desde"), "id % 97 = 0"),
    "consentimientos": Declared("consentimientos", lambda d: d.consentimientos, _where("finalidad", "id % 61 = 0", "'otra'"), "id % 89 = 0"),
    "secciones": Declared("secciones", lambda d: d.secciones, _where("seccion_padre_id", "id = 103", "id"), "id = 104"),
    "contenidos": Declared(
        "contenidos", lambda d: d.contenidos,
        _where("estado", "id % 101 = 0", "'perdido'") | _where("nivel_acceso", "id % 103 = 0", "7")
        | _where("duracion_seg", "id % 107 = 0", "0") | _where("fecha_publicacion", "id % 41 = 0", "NULL")
        | _where("vigente_hasta", "id % 43 = 0", "fecha_publicacion"), "id % 97 = 0"),
    "contenidos_etiquetas": Declared(
        "(SELECT contenido_id, etiqueta AS etiqueta_id, relevancia FROM contenidos_etiquetas)",
        lambda d: d.contenidos_etiquetas.withColumnRenamed("etiqueta", "etiqueta_id"),
        _where("relevancia", "contenido_id % 73 = 0", "1.5"), "contenido_id % 97 = 0"),
    "versiones_contenido": Declared("versiones", lambda d: d.versiones, _where("numero_version", "id % 79 = 0", "0"), "id % 97 = 0"),
    "moderaciones": Declared(
        "moderaciones", lambda d: d.moderaciones,
        _where("objeto_tipo", "id % 53 = 0", "'otro'") | _where("accion", "id % 47 = 0", "'nada'")
        | _where("contenido_id", "id % 44 = 0", "NULL"), "id % 59 = 0"),
    "comentarios": Declared("comentarios", lambda d: d.comentarios, twice="comentario_id % 59 = 0 AND orden = 0"),
    "preferencias_usuario": Declared(
        "(SELECT usuario_id, seccion_id, etiqueta AS etiqueta_id, tipo_preferencia, usuario_id % 10 / 10.0 AS peso FROM preferencias)",
        _preferences, _where("tipo_preferencia", "usuario_id % 59 = 0", "'otra'") | _where("peso", "usuario_id % 61 = 0", "1.5")
        | _where("etiqueta_id", "usuario_id % 67 = 0", "'ambas'")),
    "estrategias": Declared("estrategias", lambda d: d.estrategias, _where("motor", "id = 4", "'otro'"), "id = 5"),
    "experimentos_ab": Declared(
        "(SELECT estrategia_id AS id, min(mostrado_en) AS desde, max(mostrado_en) AS hasta FROM impresiones GROUP BY 1)",
        _experiments, _where("hasta", "id = 3", "desde")),
    "asignaciones_ab": Declared(
        "(SELECT DISTINCT estrategia_id AS experimento_id, usuario_id, variante_ab AS variante FROM impresiones)",
        _assignments, _where("variante", "usuario_id % 37 = 0", "'otra'"), "usuario_id % 31 = 0"),
    "impresiones": Declared(
        "impresiones", lambda d: d.impresiones,
        _where("posicion", "id % 211 = 0", "99") | _where("score", "id % 223 = 0", "-1.0") | _where("superficie", "id % 227 = 0", "'otra'")
        | {"clic_en": "CASE WHEN id % 31 = 0 THEN NULL WHEN id % 37 = 0 THEN clic_en - INTERVAL 60 SECOND ELSE clic_en END"},
        "id % 229 = 0"),
    "eventos": Declared("eventos", lambda d: d.eventos, twice="evento_id % 229 = 0"),
    "ranking_items_similares": Declared(
        _SIMILAR_SQL, _similar, _where("origen", "contenido_id % 71 = 0", "'otro'") | _where("score", "contenido_id % 73 = 0", "-1.0")
        | _where("contenido_similar_id", "contenido_id % 79 = 0", "contenido_id"), "contenido_id % 97 = 0"),
    "embeddings_contenido": Declared("(SELECT contenido_id FROM embeddings_c)", lambda d: d.embeddings.select("contenido_id"), twice="contenido_id % 97 = 0"),
    "perfiles_usuario": Declared(
        f"({vectors_queries.PROFILE_SQL})", vectors_queries.profiles, _where("cantidad_eventos", "usuario_id % 13 = 0", "0"), "usuario_id % 17 = 0"),
    "dim_fecha": Declared(_DAYS_SQL, lambda d: lake.dim_date_of(d.eventos, "ocurrido_en"), twice="fecha_key % 7 = 0"),
    "fact_consumo_diario": Declared(
        f"({metrics_queries.FACT_CONSUMPTION_SQL})", lambda d: M.daily_consumption(d.eventos),
        _where("vistas", "contenido_key % 83 = 0", "-1") | _where("usuarios_unicos", "contenido_key % 89 = 0", "-1")
        | _where("segundos_totales", "contenido_key % 97 = 0", "-1") | _where("guardados", "contenido_key % 31 = 0", "-1")
        | _where("compartidos", "contenido_key % 37 = 0", "-1") | _where("vistas_completas", "contenido_key % 41 = 0", "-1"),
        "contenido_key % 43 = 0"),
    "fact_impresiones_diario": Declared(
        f"({metrics_queries.FACT_IMPRESSIONS_SQL})", lambda d: M.daily_impressions(d.impresiones),
        {"clics": "CASE WHEN estrategia_key = 2 THEN impresiones + 1 WHEN estrategia_key = 1 THEN -1 ELSE clics END"}
        | _where("ctr", "estrategia_key = 3", "1.5") | _where("impresiones", "estrategia_key = 4", "-1")
        | _where("contenidos_distintos", "estrategia_key = 5", "-1"), "estrategia_key = 3"),
    "agg_popularidad": Declared(
        f"({metrics_queries.POPULARITY_SQL})", lambda d: M.popularity_by_window(d.eventos, d.contenidos, d.secciones, AS_OF),
        _where("ventana", "contenido_id % 43 = 0", "'90d'") | _where("score", "contenido_id % 47 = 0", "-1.0")
        | _where("vistas", "contenido_id % 53 = 0", "-1"), "contenido_id % 59 = 0"),
    "control_cargas": Declared(
        f"({LEDGER_SQL})", ledger,
        _where("filas_recibidas", "entidad = 'usuarios'", "-1") | _where("filas_aceptadas", "entidad = 'eventos'", "-1")
        | _where("filas_rechazadas", "entidad = 'usuarios'", "-2") | _where("estado", "entidad = 'eventos'", "'A_MEDIAS'"), "entidad = 'usuarios'"),
    "auditoria_eventos": Declared(
        _LOG_SQL, people_queries._log,
        {"accion": "CASE WHEN CAST(registro_id AS BIGINT) % 41 = 0 THEN 'OTRA' ELSE accion END",
         "datos_anteriores": "CASE WHEN accion = 'INSERT' AND CAST(registro_id AS BIGINT) % 3 = 0 THEN '{}' ELSE datos_anteriores END",
         "datos_nuevos": "CASE WHEN accion = 'DELETE' AND CAST(registro_id AS BIGINT) % 2 = 0 THEN '{}' ELSE datos_nuevos END"}),
    "accesos_sensibles": Declared(
        "(SELECT count(*) AS filas_afectadas FROM usuarios UNION ALL SELECT -count(*) FROM usuarios)", _accesses),
}


def _declared(table: str) -> Declared:
    if table not in TABLES:
        raise KeyError(f"no frame for the declared table {table}")
    return TABLES[table]


def frame(d: Domain, table: str) -> DataFrame:
    """The table with its planted defects; rows planted twice are repeated within the scan."""
    t = _declared(table)
    df = t.frame(d).withColumns({c: F.expr(e) for c, e in t.planted.items()})
    copies = F.explode(F.expr(f"sequence(1, CASE WHEN {t.twice} THEN 2 ELSE 1 END)"))
    return df if t.twice == "FALSE" else df.withColumn("_copia", copies).drop("_copia")


def source_sql(table: str) -> str:
    t = _declared(table)
    replaced = f" REPLACE ({', '.join(f'{e} AS {c}' for c, e in t.planted.items())})" if t.planted else ""
    changed = f"SELECT *{replaced} FROM {t.sql}"
    return f"({changed})" if t.twice == "FALSE" else f"(WITH t AS ({changed}) SELECT * FROM t UNION ALL SELECT * FROM t WHERE {t.twice})"
