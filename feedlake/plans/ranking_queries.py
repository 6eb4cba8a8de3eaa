"""Queries: window functions, sorts, top lists."""

from pyspark.sql import functions as F

from feedlake.operators import metrics as M
from feedlake.operators import ranking as K
from feedlake.plans.catalog_queries import publishable
from feedlake.plans.metrics_queries import DECAY_SQL
from feedlake.plans.registry import query

TRENDING_SQL = f"""
    SELECT p.seccion_id, p.seccion_slug, p.contenido_id, p.titulo, p.tipo_contenido, p.nivel_acceso, p.fecha_publicacion,
           r.impresiones, r.clics, round(r.s, 6) AS score, 168 AS ventana_horas,
           row_number() OVER (PARTITION BY p.seccion_id ORDER BY round(r.s, 6) DESC, p.fecha_publicacion DESC,
                              p.contenido_id) AS posicion_en_seccion
    FROM publicables p JOIN ({DECAY_SQL}) r USING (contenido_id)"""


def trending(d):
    return K.trending_by_section(d.impresiones, publishable(d))


@query("w01_position_in_section", """
    SELECT contenido_id, seccion_id, row_number() OVER (PARTITION BY seccion_id
        ORDER BY score DESC, fecha_publicacion DESC, contenido_id) AS posicion_en_seccion
    FROM (SELECT id AS contenido_id, seccion_id, fecha_publicacion, CAST(coalesce(duracion_seg, 0) AS DOUBLE) AS score
          FROM contenidos)""")
def _(d):
    scored = d.contenidos.select(F.col("id").alias("contenido_id"), "seccion_id", "fecha_publicacion",
                                 F.coalesce("duracion_seg", F.lit(0)).cast("double").alias("score"))
    return K.position_in_section(scored).select("contenido_id", "seccion_id", "posicion_en_seccion")


@query("w02_trending_by_section", TRENDING_SQL)
def _(d):
    return trending(d)


@query("w03_top_global", f"SELECT contenido_id, score FROM ({TRENDING_SQL}) ORDER BY score DESC, contenido_id LIMIT 20")
def _(d):
    return K.top_global(trending(d), 20).select("contenido_id", "score")


@query("w03_top_by_section", f"""
    SELECT seccion_id, contenido_id, score, puesto FROM (SELECT *, row_number() OVER (PARTITION BY seccion_id
        ORDER BY score DESC, contenido_id) AS puesto FROM ({TRENDING_SQL})) WHERE puesto <= 3""")
def _(d):
    return K.top_by_section(trending(d), 3).select("seccion_id", "contenido_id", "score", "puesto")


@query("w04_section_cap", """
    WITH r AS (SELECT e.usuario_id, e.contenido_id, c.seccion_id, CAST(count(*) AS DOUBLE) AS score FROM eventos e
        JOIN contenidos c ON c.id = e.contenido_id GROUP BY 1, 2, 3),
    s AS (SELECT *, row_number() OVER (PARTITION BY usuario_id, seccion_id ORDER BY score DESC, contenido_id) AS q FROM r)
    SELECT usuario_id, contenido_id, seccion_id, score, puesto FROM (SELECT *, row_number() OVER (PARTITION BY usuario_id
        ORDER BY score DESC, contenido_id) AS puesto FROM s WHERE q <= 2) WHERE puesto <= 10""")
def _(d):
    place = d.contenidos.select(F.col("id").alias("contenido_id"), "seccion_id")
    scored = d.eventos.groupBy("usuario_id", "contenido_id").agg(
        F.count(F.lit(1)).cast("double").alias("score")).join(place, "contenido_id")
    return K.diversified(scored, 10).select("usuario_id", "contenido_id", "seccion_id", "score", "puesto")


@query("w05_session_order", """
    WITH s AS (SELECT *, 'S-' || lpad(CAST(usuario_id AS VARCHAR), 6, '0') || '-' || strftime(ocurrido_en, '%Y%m%d%H')
        AS sesion_id FROM eventos)
    SELECT evento_id, sesion_id, row_number() OVER (PARTITION BY sesion_id ORDER BY ocurrido_en, evento_id) AS orden_en_sesion
    FROM s""")
def _(d):
    return K.session_order(d.eventos).select("evento_id", "sesion_id", "orden_en_sesion")


@query("w06_latest_history", """
    SELECT usuario_id, evento_id, contenido_id, puesto FROM (SELECT *, row_number() OVER (PARTITION BY usuario_id
        ORDER BY ocurrido_en DESC, evento_id DESC) AS puesto FROM eventos) WHERE puesto <= 20""")
def _(d):
    from feedlake.functions.ordering import top_per_group

    return top_per_group(d.eventos, ["usuario_id"], [F.col("ocurrido_en").desc(), F.col("evento_id").desc()], 20,
                         "puesto").select("usuario_id", "evento_id", "contenido_id", "puesto")


@query("w07_ordered_report", """
    SELECT tipo_evento, count(*) AS filas FROM eventos GROUP BY 1 ORDER BY filas DESC, tipo_evento""")
def _(d):
    return d.eventos.groupBy("tipo_evento").agg(F.count(F.lit(1)).alias("filas")).orderBy(
        F.col("filas").desc(), "tipo_evento")


@query("w08_refreshed_ranking", f"SELECT seccion_id, contenido_id, score, posicion_en_seccion FROM ({TRENDING_SQL})")
def _(d):
    from feedlake.session import run_folder

    out = K.refresh_ranking(trending(d), run_folder(d.spark, "trending"))
    return out.select("seccion_id", "contenido_id", "score", "posicion_en_seccion")
