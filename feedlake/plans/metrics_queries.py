"""Queries: aggregates."""

from pyspark.sql import functions as F

from feedlake.functions import expressions as E
from feedlake.operators import catalog as C
from feedlake.operators import metrics as M
from feedlake.plans.catalog_queries import publishable
from feedlake.plans.registry import query
from feedlake.sources.domain import AS_OF


@query("g01_strategy_performance", """
    SELECT e.codigo AS estrategia, e.version, e.motor, i.superficie, count(*) AS impresiones, count(*) FILTER (i.clic) AS clics,
           round(count(*) FILTER (i.clic) / count(*)::DOUBLE, 5) AS ctr, count(DISTINCT i.contenido_id) AS contenidos_distintos,
           count(DISTINCT i.usuario_id) AS usuarios_alcanzados
    FROM impresiones i JOIN estrategias e ON e.id = i.estrategia_id GROUP BY ALL""")
def _(d):
    return M.strategy_performance(d.impresiones, d.estrategias)


@query("g02_filtered_aggregate", """
    SELECT contenido_id, count(*) FILTER (WHERE clic) AS clics, count(*) FILTER (WHERE NOT clic) AS sin_clic
    FROM impresiones GROUP BY 1""")
def _(d):
    return d.impresiones.groupBy("contenido_id").agg(
        F.count_if("clic").alias("clics"), F.count_if(~F.col("clic")).alias("sin_clic"))


DECAY_SQL = """
    SELECT contenido_id, count(*) AS impresiones, count(*) FILTER (WHERE clic) AS clics,
           sum(CASE WHEN clic THEN exp(-((epoch_us(corte) - epoch_us(mostrado_en)) / 1000000.0) / 86400.0) ELSE 0 END) AS s
    FROM impresiones, (SELECT max(mostrado_en) AS corte FROM impresiones) v
    WHERE mostrado_en >= corte - INTERVAL 7 DAY GROUP BY 1"""


@query("g03_decayed_clicks", f"""
    SELECT contenido_id, impresiones, clics, round(s, 6) AS score FROM ({DECAY_SQL})""")
def _(d):
    return M.decayed_clicks(d.impresiones).select(
        "contenido_id", "impresiones", "clics", F.round("score_decaido", 6).alias("score"))


POPULARITY_SQL = f"""
    SELECT e.contenido_id, w.ventana, s.nombre AS seccion,
           round(sum(exp(-((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ocurrido_en)) / 1000000.0) / 86400.0)), 6) AS score,
           count(*) AS vistas
    FROM eventos e JOIN (VALUES ('24h', 24), ('7d', 168), ('30d', 720)) w(ventana, horas)
      ON e.ocurrido_en <= TIMESTAMP '{AS_OF}' AND e.ocurrido_en >= TIMESTAMP '{AS_OF}' - to_hours(w.horas)
    JOIN contenidos c ON c.id = e.contenido_id JOIN secciones s ON s.id = c.seccion_id
    WHERE e.tipo_evento = 'vista' GROUP BY 1, 2, 3"""


@query("g04_popularity_windows", POPULARITY_SQL)
def _(d):
    return M.popularity_by_window(d.eventos, d.contenidos, d.secciones, AS_OF)


FACT_CONSUMPTION_SQL = """
    SELECT CAST(strftime(ocurrido_en, '%Y%m%d') AS INT) AS fecha_key, contenido_id AS contenido_key, dispositivo,
           count(*) FILTER (WHERE tipo_evento IN ('vista', 'completado')) AS vistas,
           count(*) FILTER (WHERE tipo_evento = 'completado') AS vistas_completas,
           count(DISTINCT usuario_id) AS usuarios_unicos, CAST(sum(floor(segundos)) AS BIGINT) AS segundos_totales,
           count(*) FILTER (WHERE tipo_evento = 'guardado') AS guardados,
           count(*) FILTER (WHERE tipo_evento = 'compartido') AS compartidos
    FROM eventos GROUP BY 1, 2, 3"""


@query("g05_daily_consumption", FACT_CONSUMPTION_SQL)
def _(d):
    return M.daily_consumption(d.eventos)


FACT_IMPRESSIONS_SQL = """
    SELECT CAST(strftime(mostrado_en, '%Y%m%d') AS INT) AS fecha_key, estrategia_id AS estrategia_key, superficie,
           count(*) AS impresiones, count(*) FILTER (WHERE clic) AS clics,
           count(DISTINCT contenido_id) AS contenidos_distintos,
           round(CAST(count(*) FILTER (WHERE clic) AS DOUBLE) / count(*), 5) AS ctr
    FROM impresiones GROUP BY 1, 2, 3"""


@query("g06_daily_impressions", FACT_IMPRESSIONS_SQL)
def _(d):
    return M.daily_impressions(d.impresiones)


@query("g07_duplicates", """
    SELECT usuario_id, contenido_id, count(*) AS filas FROM eventos GROUP BY 1, 2 HAVING count(*) > 1""")
def _(d):
    return M.duplicates(d.eventos, ["usuario_id", "contenido_id"])


@query("g08_access_level_now", """
    SELECT u.id AS usuario_id, coalesce(max(p.nivel_acceso), 0) AS nivel_acceso FROM usuarios u
    LEFT JOIN suscripciones s ON s.usuario_id = u.id AND s.estado = 'activa' AND s.desde <= TIMESTAMP '2024-01-31'
         AND (s.hasta IS NULL OR s.hasta > TIMESTAMP '2024-01-31')
    LEFT JOIN planes p ON p.id = s.plan_id GROUP BY 1""")
def _(d):
    return C.access_level_now(d.usuarios, d.suscripciones, d.planes, AS_OF)


@query("g09_rows_per_partition", """
    SELECT strftime(ocurrido_en, '%Y-%m') AS mes, count(*) AS filas FROM (SELECT l_shipdate AS ocurrido_en FROM lineitem)
    GROUP BY 1""")
def _(d):
    return M.rows_per_month(d.table("lineitem").select(F.col("l_shipdate").alias("ocurrido_en")), "ocurrido_en")


@query("g11_catalogue_coverage", """
    SELECT estrategia_id, count(DISTINCT contenido_id) AS mostrados,
           round(CAST(count(DISTINCT contenido_id) AS DOUBLE) / (SELECT count(*) FROM publicables), 6) AS cobertura
    FROM impresiones WHERE contenido_id IN (SELECT contenido_id FROM publicables) GROUP BY 1""")
def _(d):
    return M.coverage_by_strategy(d.impresiones, publishable(d))


@query("g12_strategy_diversity", """
    WITH x AS (SELECT i.estrategia_id, i.usuario_id, a.seccion_raiz_id FROM impresiones i
        JOIN contenidos c ON c.id = i.contenido_id JOIN arbol a ON a.id = c.seccion_id),
    n AS (SELECT estrategia_id, seccion_raiz_id, count(*) AS n FROM x GROUP BY 1, 2),
    t AS (SELECT estrategia_id, sum(n) AS total FROM n GROUP BY 1),
    ent AS (SELECT n.estrategia_id, round(sum(-(n.n / t.total::DOUBLE) * ln(n.n / t.total::DOUBLE)), 6) AS entropia
        FROM n JOIN t USING (estrategia_id) GROUP BY 1),
    per_user AS (SELECT estrategia_id, usuario_id, count(DISTINCT seccion_raiz_id) AS k FROM x GROUP BY 1, 2)
    SELECT p.estrategia_id, any_value(e.entropia) AS entropia, round(CAST(sum(k) AS DOUBLE) / count(*), 5) AS raices_por_usuario
    FROM per_user p JOIN ent e USING (estrategia_id) GROUP BY 1""")
def _(d):
    return M.diversity_by_strategy(d.impresiones, d.contenidos, C.section_tree(d.secciones))


@query("g13_strategy_retention", """
    WITH f AS (SELECT estrategia_id, usuario_id, min(CAST(mostrado_en AS DATE)) AS d0 FROM impresiones GROUP BY 1, 2),
    r AS (SELECT f.*, EXISTS (SELECT 1 FROM eventos e WHERE e.usuario_id = f.usuario_id
        AND CAST(e.ocurrido_en AS DATE) > f.d0 AND CAST(e.ocurrido_en AS DATE) <= f.d0 + 7) AS vuelve FROM f)
    SELECT estrategia_id, count(*) AS expuestos, count(*) FILTER (WHERE vuelve) AS vuelven,
           round(CAST(count(*) FILTER (WHERE vuelve) AS DOUBLE) / count(*), 5) AS retencion FROM r GROUP BY 1""")
def _(d):
    return M.retention_by_strategy(d.impresiones, d.eventos)


@query("g14_ab_comparison", """
    WITH a AS (SELECT CASE WHEN u.id % 2 = 0 THEN 'tratamiento' ELSE 'control' END AS variante,
        count(DISTINCT u.id) AS usuarios, count(*) AS impresiones, count(*) FILTER (WHERE clic) AS clics
        FROM impresiones i JOIN usuarios u ON u.id = i.usuario_id GROUP BY 1)
    SELECT variante, usuarios, impresiones, clics, round(clics / impresiones::DOUBLE, 6) AS ctr,
           round(clics / impresiones::DOUBLE - (SELECT clics / impresiones::DOUBLE FROM a WHERE variante = 'control'), 6)
           AS diferencia FROM a""")
def _(d):
    assignments = d.usuarios.select(F.col("id").alias("usuario_id"), E.ab_variant(F.col("id")).alias("variante"))
    return M.ab_comparison(d.impresiones, assignments)


@query("g15_consumption_by_root", """
    SELECT a.seccion_raiz, count(*) AS vistas, count(DISTINCT c.id) AS contenidos FROM eventos e
    JOIN contenidos c ON c.id = e.contenido_id JOIN arbol a ON a.id = c.seccion_id WHERE e.tipo_evento = 'vista' GROUP BY 1""")
def _(d):
    return M.consumption_by_root(d.eventos, d.contenidos, C.section_tree(d.secciones))


@query("g16_content_metrics", """
    SELECT contenido_id, count(*) AS eventos, count(DISTINCT usuario_id) AS usuarios,
           count(*) FILTER (WHERE tipo_evento = 'vista') AS vistas, count(*) FILTER (WHERE tipo_evento = 'clic') AS clics,
           round(sum(segundos) FILTER (WHERE tipo_evento = 'vista'), 2)
           / count(*) FILTER (WHERE tipo_evento = 'vista') AS segundos_medios, max(ocurrido_en) AS ultimo
    FROM eventos GROUP BY 1""")
def _(d):
    return M.content_metrics(d.eventos)


@query("g17_recommendation_attribution", """
    SELECT estrategia_origen AS estrategia, count(*) AS impresiones, count(DISTINCT usuario_id) AS usuarios
    FROM eventos WHERE tipo_evento = 'impresion' GROUP BY 1""")
def _(d):
    return M.attribution(d.eventos)


FEATURES_SQL = """
    WITH s AS (SELECT e.usuario_id, c.seccion_id, count(*) AS n FROM eventos e JOIN contenidos c ON c.id = e.contenido_id
        GROUP BY 1, 2),
    b AS (SELECT usuario_id, seccion_id FROM (SELECT *, row_number() OVER (PARTITION BY usuario_id
        ORDER BY n DESC, seccion_id) AS r FROM s) WHERE r = 1)
    SELECT e.usuario_id, count(*) AS eventos, count(DISTINCT e.contenido_id) AS contenidos_distintos,
           any_value(b.seccion_id) AS seccion_principal, max(e.ocurrido_en) AS ultimo
    FROM eventos e JOIN b ON b.usuario_id = e.usuario_id GROUP BY 1"""


@query("g18_user_features", FEATURES_SQL)
def _(d):
    return M.user_features(d.eventos, d.contenidos)


@query("g19_latest_consent", """
    SELECT usuario_id, finalidad, otorgado, registrado_en FROM (SELECT *, row_number() OVER (
        PARTITION BY usuario_id, finalidad ORDER BY registrado_en DESC, id DESC) AS r FROM consentimientos) WHERE r = 1""")
def _(d):
    return M.latest_consents(d.consentimientos)


@query("g20_latest_version", """
    SELECT contenido_id, max(numero_version) AS ultima_version, count(*) AS ediciones,
           max_by(editor_id, numero_version) AS ultimo_editor FROM versiones GROUP BY 1""")
def _(d):
    return M.latest_versions(d.versiones)


@query("g20_changed_fields", """
    SELECT campo, count(*) AS cambios, count(DISTINCT contenido_id) AS contenidos FROM (
        SELECT contenido_id, unnest(json_keys(cambios)) AS campo FROM versiones) GROUP BY 1""")
def _(d):
    return M.changed_fields(d.versiones)


@query("g21_playback_rollup", """
    SELECT date_trunc('hour', ocurrido_en) AS desde, contenido_id, count(*) AS latidos, round(sum(buffer_ms), 2) / count(*) AS buffer_medio,
           max(buffer_ms) AS buffer_max, count(*) FILTER (WHERE calidad = 'sd') AS latidos_sd FROM telemetria GROUP BY 1, 2""")
def _(d):
    return M.playback_rollup(d.telemetria)


@query("g22_search_clickthrough", """
    WITH b AS (SELECT texto, busqueda_id, count(*) AS r, count(*) FILTER (WHERE clic) AS c FROM busquedas GROUP BY 1, 2)
    SELECT texto, count(*) AS busquedas, CAST(sum(r) AS BIGINT) AS resultados, CAST(sum(c) AS BIGINT) AS clics,
           round(CAST(sum(c) AS DOUBLE) / sum(r), 5) AS ctr,
           round(CAST(count(*) FILTER (WHERE c > 0) AS DOUBLE) / count(*), 5) AS tasa_exito FROM b GROUP BY 1""")
def _(d):
    return M.search_clickthrough(d.busquedas)


@query("g23_moderation_outcome", """
    SELECT contenido_id, max_by(accion, id) AS ultima_accion, count(*) FILTER (WHERE accion = 'aprobado') AS aprobadas,
           count(*) FILTER (WHERE accion = 'rechazado') AS rechazadas, count(*) FILTER (WHERE accion = 'marcado') AS marcadas,
           count(*) FILTER (WHERE accion = 'despublicado') AS despublicadas
    FROM moderaciones WHERE contenido_id IS NOT NULL GROUP BY 1""")
def _(d):
    return M.moderation_outcome(d.moderaciones)


@query("g24_plan_transitions", """
    WITH s AS (SELECT s.usuario_id, p.codigo AS plan, lag(p.codigo) OVER (PARTITION BY s.usuario_id ORDER BY s.desde) AS previo
        FROM suscripciones s JOIN planes p ON p.id = s.plan_id)
    SELECT coalesce(previo, 'inicio') AS plan_previo, plan, count(*) AS cambios, count(DISTINCT usuario_id) AS usuarios
    FROM s GROUP BY 1, 2""")
def _(d):
    return M.plan_transitions(d.suscripciones, d.planes)


@query("g24_premium_conversion", """
    WITH u AS (SELECT s.usuario_id, min_by(p.codigo, s.desde) AS primer_plan, bool_or(p.codigo = 'premium') AS llego
        FROM suscripciones s JOIN planes p ON p.id = s.plan_id GROUP BY 1)
    SELECT primer_plan, count(*) AS usuarios, count(*) FILTER (WHERE llego) AS premium,
           round(CAST(count(*) FILTER (WHERE llego) AS DOUBLE) / count(*), 5) AS conversion FROM u GROUP BY 1""")
def _(d):
    return M.premium_conversion(d.suscripciones, d.planes)
