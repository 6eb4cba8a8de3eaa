"""Queries: vectors."""

from pyspark.sql import functions as F

from feedlake.functions import expressions as E
from feedlake.operators import catalog as C
from feedlake.operators import vectors as V
from feedlake.plans.catalog_queries import publishable
from feedlake.plans.registry import query
from feedlake.sources.domain import AS_OF

_W = "CASE tipo_evento " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in E.EVENT_WEIGHTS.items()) + " ELSE 0 END"

PROFILE_SQL = f"""
    SELECT usuario_id, list(x / n ORDER BY pos) AS embedding, any_value(cantidad_eventos) AS cantidad_eventos FROM (
        SELECT usuario_id, pos, x, sqrt(sum(x * x) OVER (PARTITION BY usuario_id)) AS n, cantidad_eventos FROM (
            SELECT p.usuario_id, e.pos, sum(p.w * e.x) AS x, any_value(g.cantidad_eventos) AS cantidad_eventos
            FROM (SELECT usuario_id, contenido_id, sum({_W}) AS w FROM eventos WHERE usuario_id IN
                    (SELECT id FROM usuarios WHERE consentimiento_personalizacion) GROUP BY 1, 2) p
            JOIN (SELECT usuario_id, count(DISTINCT contenido_id) AS k, count(*) AS cantidad_eventos FROM eventos GROUP BY 1) g
              ON g.usuario_id = p.usuario_id AND g.k >= 4
            JOIN (SELECT contenido_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings_c) e
              ON e.contenido_id = p.contenido_id GROUP BY 1, 2)) WHERE n > 1e-12 GROUP BY 1"""

LEVEL_SQL = f"""
    SELECT u.id AS usuario_id, coalesce(max(p.nivel_acceso), 0) AS nivel_acceso FROM usuarios u
    LEFT JOIN suscripciones s ON s.usuario_id = u.id AND s.estado = 'activa' AND s.desde <= TIMESTAMP '{AS_OF}'
         AND (s.hasta IS NULL OR s.hasta > TIMESTAMP '{AS_OF}') LEFT JOIN planes p ON p.id = s.plan_id GROUP BY 1"""

FEED_SQL = f"""
    SELECT f.usuario_id, e.contenido_id, p.seccion_id, round(list_cosine_similarity(f.embedding, e.embedding), 6) AS similitud
    FROM ({PROFILE_SQL}) f JOIN ({LEVEL_SQL}) l ON l.usuario_id = f.usuario_id
    JOIN publicables p ON p.nivel_acceso <= l.nivel_acceso JOIN embeddings_c e ON e.contenido_id = p.contenido_id"""


def neighbours(d, k=10):
    """Exact neighbours among publishable contents, as rows of the similar-items table."""
    base = V.as_base(d.embeddings, publishable(d))
    return V.nearest(base.select("id", "v", F.lit(2).alias("level")), base, k, same_space=True)


def profiles(d):
    return V.user_profiles(d.eventos, d.embeddings, d.usuarios)


def profile_queries(d):
    """Profiles of users with their access level, as queries."""
    levels = C.access_level_now(d.usuarios, d.suscripciones, d.planes, AS_OF)
    return V.as_queries(profiles(d).join(levels, "usuario_id"), "usuario_id", "embedding", F.col("nivel_acceso"))


def feed_for(d, queries, k=10, per_section=None):
    return V.nearest(queries, V.as_base(d.embeddings, publishable(d)), k, per_group=per_section)


def personal_feed(d, k=10, per_section=None):
    return feed_for(d, profile_queries(d), k, per_section)


NEIGHBOURS_SQL = """
    SELECT contenido_id, contenido_similar_id, similitud, puesto FROM (
        SELECT a.contenido_id, b.contenido_id AS contenido_similar_id,
               round(list_cosine_similarity(a.embedding, b.embedding), 6) AS similitud,
               row_number() OVER (PARTITION BY a.contenido_id ORDER BY round(list_cosine_similarity(a.embedding, b.embedding), 6) DESC,
                                  b.contenido_id) AS puesto
        FROM embeddings_c a JOIN embeddings_c b ON a.contenido_id <> b.contenido_id
        WHERE a.contenido_id IN (SELECT contenido_id FROM publicables) AND b.contenido_id IN (SELECT contenido_id FROM publicables))
    WHERE puesto <= 10"""


@query("j14_nearest_content_of_profile", f"""
    SELECT usuario_id, contenido_id, similitud FROM (SELECT f.usuario_id, e.contenido_id,
        round(list_cosine_similarity(f.embedding, e.embedding), 6) AS similitud, row_number() OVER (PARTITION BY f.usuario_id
        ORDER BY round(list_cosine_similarity(f.embedding, e.embedding), 6) DESC, e.contenido_id) AS r
    FROM ({PROFILE_SQL}) f, embeddings_c e WHERE e.contenido_id IN (SELECT id FROM contenidos)) WHERE r = 1""")
def _(d):
    every = d.contenidos.select(F.col("id").alias("contenido_id"), F.lit(0).alias("nivel_acceso"), "seccion_id")
    found = V.nearest(V.as_queries(profiles(d), "usuario_id", "embedding"), V.as_base(d.embeddings, every), 1)
    return found.select(F.col("id").alias("usuario_id"), F.col("other").alias("contenido_id"), F.col("sim").alias("similitud"))


@query("x01_cosine_similarity", """
    SELECT e.contenido_id, round(list_cosine_similarity(e.embedding, q.embedding), 6) AS similitud,
           round(1 - list_cosine_similarity(e.embedding, q.embedding), 6) AS distancia
    FROM embeddings_c e, (SELECT embedding FROM embeddings_c WHERE contenido_id = 3) q""")
def _(d):
    q = d.embeddings.filter("contenido_id = 3").select("embedding").scalar()
    s = E.cosine_similarity(F.col("embedding"), F.col("__q"))
    return d.embeddings.withColumn("__q", q).select("contenido_id", F.round(s, 6).alias("similitud"), F.round(1 - s, 6).alias("distancia"))


@query("x02_more_like_this", """
    SELECT e.contenido_id, round(list_cosine_similarity(e.embedding, q.embedding), 6) AS similitud
    FROM embeddings_c e JOIN publicables p ON p.contenido_id = e.contenido_id,
         (SELECT embedding FROM embeddings_c WHERE contenido_id = 5) q
    WHERE e.contenido_id <> 5 AND p.nivel_acceso <= 1 ORDER BY similitud DESC, e.contenido_id LIMIT 10""")
def _(d):
    return V.similar_to(d.embeddings, publishable(d), 5, 10, 1)


@query("x03_personal_feed", f"""
    SELECT usuario_id, contenido_id, similitud, puesto FROM (SELECT *, row_number() OVER (PARTITION BY usuario_id
        ORDER BY similitud DESC, contenido_id) AS puesto FROM ({FEED_SQL})) WHERE puesto <= 10""")
def _(d):
    return personal_feed(d).select(F.col("id").alias("usuario_id"), F.col("other").alias("contenido_id"),
                                   F.col("sim").alias("similitud"), "puesto")


@query("x04_diversified_feed", f"""
    SELECT usuario_id, contenido_id, seccion_id, similitud, puesto FROM (SELECT *, row_number() OVER (PARTITION BY usuario_id
        ORDER BY similitud DESC, contenido_id) AS puesto FROM (SELECT *, row_number() OVER (PARTITION BY usuario_id, seccion_id
        ORDER BY similitud DESC, contenido_id) AS s FROM ({FEED_SQL})) WHERE s <= 2) WHERE puesto <= 10""")
def _(d):
    return personal_feed(d, per_section=2).select(
        F.col("id").alias("usuario_id"), F.col("other").alias("contenido_id"), F.col("grp").alias("seccion_id"),
        F.col("sim").alias("similitud"), "puesto")


@query("x05_near_duplicates", """
    WITH vectores AS (SELECT * FROM embeddings_c UNION ALL SELECT contenido_id + 1000000, embedding FROM embeddings_c WHERE contenido_id % 10 = 0
        UNION ALL SELECT contenido_id + 2000000, embedding FROM embeddings_c WHERE contenido_id % 50 = 0),
    reps AS (SELECT embedding, min(contenido_id) AS rep FROM vectores GROUP BY 1)
    SELECT a.rep AS contenido_a, b.rep AS contenido_b, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS similitud
    FROM reps a JOIN reps b ON a.rep < b.rep WHERE round(list_cosine_similarity(a.embedding, b.embedding), 6) > 0.45
    UNION ALL SELECT rep, contenido_id, 1.0 FROM vectores JOIN reps USING (embedding) WHERE contenido_id <> rep""")
def _(d):
    """Groups of copies (planted) as pairs with their lowest id, and pairs between the lowest ids."""
    copies = [d.embeddings.filter(F.col("contenido_id") % n == 0).withColumn("contenido_id", F.col("contenido_id") + add)
              for n, add in ((10, 1000000), (50, 2000000))]
    return V.near_duplicates(d.embeddings.unionByName(copies[0]).unionByName(copies[1]), 0.45)


@query("x06_exact_batch_neighbours", NEIGHBOURS_SQL)
def _(d):
    return neighbours(d).select(F.col("id").alias("contenido_id"), F.col("other").alias("contenido_similar_id"),
                                F.col("sim").alias("similitud"), "puesto")


@query("x07_inverted_lists_recall")
def _(d):
    base = V.as_base(d.embeddings, publishable(d))
    q = base.select("id", "v", F.lit(2).alias("level"))
    approx, read = V.nearest_in_lists(q, base, 10, V.kmeans_centres(base), same_space=True)
    return V.recall(V.nearest(q, base, 10, same_space=True), approx).withColumns(
        {c: read.select(c).scalar() for c in read.columns})


@query("x08_user_profiles", f"""
    SELECT usuario_id, cantidad_eventos, unnest(range(len(embedding))) AS pos,
           round(unnest(embedding), 6) + 0.0 AS valor FROM ({PROFILE_SQL})""")
def _(d):
    return profiles(d).select("usuario_id", "cantidad_eventos", F.posexplode("embedding").alias("pos", "valor")).select(
        "usuario_id", "cantidad_eventos", F.col("pos").cast("long").alias("pos"),
        (F.round("valor", 6) + F.lit(0.0)).alias("valor"))


@query("x09_vector_sanity", """
    SELECT count(*) AS vectores, 1::BIGINT AS modelos, count(DISTINCT len(embedding)) AS dimensiones,
           CAST(max(len(embedding)) AS INT) AS dimension, 0::BIGINT AS no_unitarios, TRUE AS coherente FROM embeddings_c""")
def _(d):
    return V.vector_sanity(d.embeddings)


@query("x09_mean_neighbours", f"""
    SELECT CAST(count(*) AS DOUBLE) / count(DISTINCT contenido_id) AS vecinos_medios, count(DISTINCT contenido_id) AS contenidos
    FROM ({NEIGHBOURS_SQL})""")
def _(d):
    return neighbours(d).agg((F.count("*") / F.countDistinct("id")).alias("vecinos_medios"),
                             F.countDistinct("id").alias("contenidos"))


@query("x10_post_filter_survivors", """
    SELECT r.contenido_id, r.similitud FROM (SELECT e.contenido_id, round(list_cosine_similarity(e.embedding, q.embedding), 6) AS similitud
        FROM embeddings_c e, (SELECT embedding FROM embeddings_c WHERE contenido_id = 5) q WHERE e.contenido_id <> 5
        ORDER BY 2 DESC, 1 LIMIT 50) r JOIN publicables p ON p.contenido_id = r.contenido_id AND p.nivel_acceso <= 0""")
def _(d):
    return V.post_filtered(d.embeddings, publishable(d), 5, 50, 0)


@query("x11_similarity_edges", f"""
    SELECT contenido_id, contenido_similar_id, similitud FROM ({NEIGHBOURS_SQL}) WHERE similitud >= 0.3""")
def _(d):
    return neighbours(d).filter("sim >= 0.3").select(
        F.col("id").alias("contenido_id"), F.col("other").alias("contenido_similar_id"), F.col("sim").alias("similitud"))
