"""Queries: lakehouse and serving tables."""

from pyspark.sql import functions as F

from feedlake.functions import expressions as E
from feedlake.operators import catalog as C
from feedlake.operators import metrics as M
from feedlake.operators import quality as Q
from feedlake.operators import ranking as K
from feedlake.operators import serving as V
from feedlake.plans import lake as L
from feedlake.plans.catalog_queries import publishable
from feedlake.plans.metrics_queries import FACT_CONSUMPTION_SQL, FEATURES_SQL
from feedlake.plans.people_queries import AGE, ANON_SQL, PSEUDO, SALT, anonymised
from feedlake.plans.ranking_queries import TRENDING_SQL, trending
from feedlake.plans.recommend_queries import HYBRID_SQL, hybrid
from feedlake.plans.registry import query
from feedlake.session import run_folder
from feedlake.sources import loading
from feedlake.sources.domain import AS_OF

_SESSION = "'S-' || lpad(CAST(usuario_id AS VARCHAR), 6, '0') || '-' || strftime(ocurrido_en, '%Y%m%d%H')"
_BRONZE = f"""SELECT 'EV-' || lpad(CAST(evento_id AS VARCHAR), 8, '0') AS evento_id,
    {PSEUDO.replace('CAST(id', 'CAST(usuario_id')} AS usuario_seudonimo, {_SESSION} AS sesion_id, contenido_id, tipo_evento,
    ocurrido_en, dispositivo, segundos"""


@query("e17_flatten_event", f"{_BRONZE}, 'lote_01' AS lote FROM eventos")
def _(d):
    return L.bronze_events(d.eventos, "lote_01", SALT)


@query("l01_bronze_export", f"""
    {_BRONZE}, 'lote_01' AS lote FROM eventos WHERE ocurrido_en < TIMESTAMP '2024-01-16'
    UNION ALL {_BRONZE}, 'lote_02' AS lote FROM eventos WHERE ocurrido_en >= TIMESTAMP '2024-01-16'""")
def _(d):
    path = run_folder(d.spark, "bronce")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    L.write_lot(L.bronze_events(d.eventos.filter(F.col("ocurrido_en") < half), "lote_01", SALT), path)
    L.write_lot(L.bronze_events(d.eventos.filter(F.col("ocurrido_en") >= half), "lote_02", SALT), path)
    return d.spark.read.parquet(path).select(*L.BRONZE_COLUMNS)


@query("s03_bronze_lot_csv", f"{_BRONZE.replace(', dispositivo, segundos', ', dispositivo')} FROM eventos")
def _(d):
    from pyspark.sql.types import StructType

    from feedlake.sources import readers as R

    path = run_folder(d.spark, "lote-csv")
    cols = L.BRONZE_COLUMNS[:-2]
    R.write_entity_csv(L.bronze_events(d.eventos, "lote_01", SALT).select(*cols), path)
    return R.read_entity_csv(d.spark, path, StructType.fromDDL(
        "evento_id STRING, usuario_seudonimo STRING, sesion_id STRING, contenido_id BIGINT, tipo_evento STRING, "
        "ocurrido_en TIMESTAMP_NTZ, dispositivo STRING"))


_SILVER = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evento_id ORDER BY lote DESC, ocurrido_en DESC) AS r FROM lotes
    WHERE motivo IS NULL) WHERE r = 1"""


@query("l02_silver_events", f"""
    SELECT CAST(evento_id AS BIGINT) AS evento_id, usuario_id, contenido_id, tipo_evento, ocurrido_en, dispositivo, segundos, lote
    FROM ({_SILVER})""")
def _(d):
    good, _ = L.silver_events(d.lotes)
    return good


@query("l02_silver_quarantine", """
    SELECT lote, motivo AS motivo_rechazo, count(*) AS filas FROM lotes WHERE motivo IS NOT NULL GROUP BY 1, 2""")
def _(d):
    _, bad = L.silver_events(d.lotes)
    return bad.groupBy("lote", "motivo_rechazo").agg(F.count("*").alias("filas"))


@query("l02_lot_balance", f"""
    SELECT l.lote, count(*) AS recibidas, any_value(a.n) AS aceptadas, count(motivo) AS rechazadas,
           count(*) - any_value(a.n) - count(motivo) AS repetidas
    FROM lotes l JOIN (SELECT lote, count(*) AS n FROM ({_SILVER}) GROUP BY 1) a ON a.lote = l.lote GROUP BY 1""")
def _(d):
    good, bad = L.silver_events(d.lotes)
    return L.lot_balance(d.lotes, good, bad)


def _gold(d):
    return L.gold_tables(d.eventos, d.impresiones, d.contenidos, d.tipos_contenido, d.secciones,
                         C.section_tree(d.secciones), d.estrategias, anonymised(d), AS_OF)


@query("l03_gold_rebuild", f"""
    SELECT 'dim_fecha' AS tabla, CAST(date_diff('day', min(ocurrido_en), max(ocurrido_en)) + 1 AS BIGINT) AS filas FROM eventos
    UNION ALL SELECT 'dim_contenido', count(*) FROM contenidos UNION ALL SELECT 'dim_usuario_anonimizado', count(*) FROM usuarios
    UNION ALL SELECT 'dim_estrategia', 5 UNION ALL SELECT 'fact_consumo_diario', count(*) FROM ({FACT_CONSUMPTION_SQL})
    UNION ALL SELECT 'fact_impresiones_diario', count(*) FROM (SELECT DISTINCT CAST(mostrado_en AS DATE), estrategia_id, superficie FROM impresiones)
    UNION ALL SELECT 'agg_popularidad', (SELECT count(*) FROM (SELECT DISTINCT contenido_id, w.v FROM eventos e
        JOIN (VALUES ('24h', 24), ('7d', 168), ('30d', 720)) w(v, h) ON ocurrido_en <= TIMESTAMP '{AS_OF}'
        AND ocurrido_en >= TIMESTAMP '{AS_OF}' - to_hours(w.h) WHERE tipo_evento = 'vista'))""")
def _(d):
    folder = run_folder(d.spark, "oro")
    tables = _gold(d)
    L.build_gold(tables, folder)
    return M.row_counts({name: loading.read_loaded(d.spark, folder, name) for name in tables})


@query("s13_gold_load", FACT_CONSUMPTION_SQL)
def _(d):
    folder = run_folder(d.spark, "oro-consumo")
    L.build_gold({"fact_consumo_diario": M.daily_consumption(d.eventos)}, folder)
    return loading.read_loaded(d.spark, folder, "fact_consumo_diario")


@query("e04_calendar", """
    SELECT CAST(strftime(f, '%Y%m%d') AS INT) AS fecha_key, strftime(f, '%Y-%m-%d') AS fecha, year(f) AS anio, month(f) AS mes, day(f) AS dia,
           quarter(f) AS trimestre, isodow(f) AS dia_semana, isodow(f) >= 6 AS es_fin_semana FROM (
        SELECT unnest(generate_series(min(date_trunc('day', ocurrido_en)), max(date_trunc('day', ocurrido_en)), INTERVAL 1 DAY)) AS f
        FROM eventos)""")
def _(d):
    return L.dim_date_of(d.eventos, "ocurrido_en").withColumn("fecha", F.date_format("fecha", "yyyy-MM-dd"))


@query("l04_dim_content", """
    SELECT c.id AS contenido_key, c.id AS contenido_id, c.titulo, t.codigo AS tipo_contenido, a.nombre AS seccion, a.seccion_raiz,
           c.nivel_acceso, c.estado, strftime(c.fecha_publicacion, '%Y-%m-%d') AS fecha_publicacion
    FROM contenidos c JOIN tipos_contenido t ON t.id = c.tipo_contenido_id JOIN arbol a ON a.id = c.seccion_id""")
def _(d):
    return L.dim_content(d.contenidos, d.tipos_contenido, C.section_tree(d.secciones)).withColumn(
        "fecha_publicacion", F.date_format("fecha_publicacion", "yyyy-MM-dd"))


@query("l05_dim_strategy", """
    SELECT e.id AS estrategia_key, e.codigo, e.version, e.motor, count(i.id) AS impresiones FROM estrategias e
    LEFT JOIN impresiones i ON i.estrategia_id = e.id GROUP BY 1, 2, 3, 4""")
def _(d):
    facts = M.daily_impressions(d.impresiones).groupBy("estrategia_key").agg(F.sum("impresiones").alias("impresiones"))
    return L.dim_strategy(d.estrategias).join(facts, "estrategia_key", "left").withColumn(
        "impresiones", F.coalesce("impresiones", F.lit(0)))


@query("n04_dim_user", f"""
    SELECT seudonimo, pais, tramo_etario, plan, CAST(replace(substring(mes_alta, 1, 7), '-', '') AS INT) AS mes_alta FROM ({ANON_SQL})""")
def _(d):
    return L.dim_user(anonymised(d)).drop("usuario_key")


@query("l06_idempotent_lot", """
    SELECT lote, count(*) AS filas, count(DISTINCT evento_id) AS eventos FROM (
        SELECT evento_id, CASE WHEN ocurrido_en < TIMESTAMP '2024-01-16' THEN 'lote_01' ELSE 'lote_02' END AS lote FROM eventos) GROUP BY 1""")
def _(d):
    path = run_folder(d.spark, "incremental")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    second = L.bronze_events(d.eventos.filter(F.col("ocurrido_en") >= half), "lote_02", SALT)
    L.write_lot(L.bronze_events(d.eventos.filter(F.col("ocurrido_en") < half), "lote_01", SALT), path)
    L.write_lot(second, path)
    L.write_lot(second, path)
    return d.spark.read.parquet(path).groupBy("lote").agg(
        F.count("*").alias("filas"), F.countDistinct("evento_id").alias("eventos"))


@query("q11_layer_reconciliation", f"""
    SELECT CAST(strftime(ocurrido_en, '%Y%m%d') AS INT) AS fecha_key, count(*) FILTER (WHERE tipo_evento = 'vista') AS vistas_a,
           count(*) FILTER (WHERE tipo_evento = 'vista') AS vistas_b, 0::BIGINT AS vistas_dif FROM ({_SILVER}) GROUP BY 1""")
def _(d):
    silver, _ = L.silver_events(d.lotes)
    per_day = silver.groupBy(E.day_key(F.col("ocurrido_en")).alias("fecha_key")).agg(
        F.count_if(F.col("tipo_evento") == "vista").alias("vistas"))
    return Q.reconcile(per_day, M.daily_consumption(silver), ["fecha_key"], ["vistas"])


# ---- serving --------------------------------------------------------------------------------------------

@query("v01_trending_global", f"""
    SELECT 'rec:trending:global' AS clave, CAST(contenido_id AS VARCHAR) AS miembro, score FROM (
        SELECT contenido_id, score FROM ({TRENDING_SQL}) ORDER BY score DESC, contenido_id LIMIT 50)""")
def _(d):
    return V.trending_global(trending(d), 50, AS_OF).select("clave", "miembro", "score")


@query("v01_trending_by_section", f"""
    SELECT 'rec:trending:seccion:' || seccion_slug AS clave, CAST(contenido_id AS VARCHAR) AS miembro, score FROM ({TRENDING_SQL})
    QUALIFY row_number() OVER (PARTITION BY seccion_id ORDER BY score DESC, contenido_id) <= 20""")
def _(d):
    return V.trending_by_section(trending(d), 20, AS_OF).select("clave", "miembro", "score")


@query("v02_user_top", f"""
    SELECT 'rec:usuario:' || usuario_id || ':top' AS clave, CAST(contenido_id AS VARCHAR) AS miembro, score FROM ({HYBRID_SQL})""")
def _(d):
    return V.user_top(hybrid(d), AS_OF).select("clave", "miembro", "score")


@query("v03_user_seen", f"""
    SELECT DISTINCT 'usuario:' || usuario_id || ':vistos' AS clave, CAST(contenido_id AS VARCHAR) AS miembro,
           TIMESTAMP '{AS_OF}' + INTERVAL 7200 SECOND AS expira_en FROM eventos""")
def _(d):
    return V.user_seen(d.eventos, AS_OF).select("clave", "miembro", "expira_en")


@query("v04_user_features", f"""
    SELECT 'usuario:' || usuario_id || ':features' AS clave, eventos, contenidos_distintos, seccion_principal, ultimo FROM ({FEATURES_SQL})""")
def _(d):
    return V.user_features(M.user_features(d.eventos, d.contenidos), AS_OF).drop("calculado_en", "expira_en")


@query("v05_content_metadata", f"""
    SELECT 'contenido:' || contenido_id || ':meta' AS clave, titulo, seccion, tipo_contenido, nivel_acceso,
           TIMESTAMP '{AS_OF}' + INTERVAL 3600 SECOND AS expira_en FROM publicables""")
def _(d):
    return V.content_metadata(publishable(d), AS_OF).select(
        "clave", "titulo", "seccion", "tipo_contenido", "nivel_acceso", "expira_en")


@query("s12_publish_rankings", f"""
    SELECT 'rec:trending:global' AS clave, count(*) AS miembros FROM (SELECT * FROM ({TRENDING_SQL}) ORDER BY score DESC, contenido_id LIMIT 50)
    UNION ALL SELECT 'rec:trending:seccion:' || seccion_slug, least(count(*), 20) FROM ({TRENDING_SQL}) GROUP BY 1
    UNION ALL SELECT 'usuario:' || usuario_id || ':vistos', count(DISTINCT contenido_id) FROM eventos GROUP BY usuario_id
    UNION ALL SELECT 'usuario:' || usuario_id || ':features', 1 FROM ({FEATURES_SQL})
    UNION ALL SELECT 'contenido:' || contenido_id || ':meta', 1 FROM publicables""")
def _(d):
    path = run_folder(d.spark, "servicio")
    rank = trending(d)
    tables = {"trending_global": V.trending_global(rank, 50, AS_OF), "trending_seccion": V.trending_by_section(rank, 20, AS_OF),
              "vistos": V.user_seen(d.eventos, AS_OF), "features": V.user_features(M.user_features(d.eventos, d.contenidos), AS_OF),
              "meta": V.content_metadata(publishable(d), AS_OF)}
    V.publish(tables, path)
    return V.read_published(d.spark, path, list(tables)).groupBy("clave").agg(F.count("*").alias("miembros"))


@query("t06_expiring_sets", f"""
    SELECT DISTINCT 'usuario:' || usuario_id || ':vistos' AS clave, CAST(contenido_id AS VARCHAR) AS miembro FROM eventos
    GROUP BY usuario_id, contenido_id HAVING max(ocurrido_en) + INTERVAL 7200 SECOND > TIMESTAMP '2024-01-30 12:00:00'""")
def _(d):
    return V.live(V.user_seen_since_last(d.eventos), "2024-01-30 12:00:00").select("clave", "miembro")
