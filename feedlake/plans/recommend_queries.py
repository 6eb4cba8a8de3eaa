"""Queries: graph, collaborative filtering, hybrid blend and the similar-items table."""

from pyspark.sql import functions as F

from feedlake.operators import catalog as C
from feedlake.operators import metrics as M
from feedlake.operators import ranking as K
from feedlake.operators import recommend as R
from feedlake.plans.catalog_queries import publishable
from feedlake.plans.registry import query
from feedlake.session import cut_lineage
from feedlake.plans.vectors_queries import FEED_SQL, LEVEL_SQL, NEIGHBOURS_SQL, feed_for, neighbours, profile_queries
from feedlake.sources.domain import AS_OF


def views(d):
    return d.eventos.filter("tipo_evento = 'vista'")


_VIO = "(SELECT DISTINCT usuario_id AS u, contenido_id AS i FROM eventos WHERE tipo_evento = 'vista')"


def _pair_sql(source: str, score: str, k: int, factor: str = "1.0::DOUBLE") -> str:
    """Whole self-join of a (u, i) relation with a score; the check has no notion of large or small groups."""
    return f"""
        SELECT i, j, n_ij, score, puesto FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY r DESC, j) AS puesto FROM (
            SELECT p.i, p.j, p.n_ij, {score} AS score, floor(p.n_ij * ({factor}) * 1000000000.0::DOUBLE + 0.5::DOUBLE) AS r FROM (
                SELECT x.i, y.i AS j, count(*) AS n_ij FROM {source} x JOIN {source} y ON x.u = y.u AND x.i <> y.i GROUP BY 1, 2) p
            JOIN (SELECT i, count(*) AS n FROM {source} GROUP BY 1) a ON a.i = p.i
            JOIN (SELECT i AS j, count(*) AS n FROM {source} GROUP BY 1) b ON b.j = p.j)) WHERE puesto <= {k}"""


_COSINE = ("n_ij / sqrt(CAST(a.n * b.n AS DOUBLE))", 10, "1.0::DOUBLE / sqrt(CAST(b.n AS DOUBLE))")
COOC_SQL = _pair_sql("(SELECT DISTINCT usuario_id AS u, contenido_id AS i FROM eventos)", *_COSINE)
GRAPH_SQL = _pair_sql(_VIO, "n_ij / CAST(a.n AS DOUBLE)", 10)
COVIEW_SQL = f"""
    SELECT u, j, caminos, puesto FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY caminos DESC, j) AS puesto FROM (
        SELECT a.u, c.i AS j, CAST(count(*) AS BIGINT) AS caminos FROM {_VIO} a JOIN {_VIO} b ON b.i = a.i AND b.u <> a.u
        JOIN {_VIO} c ON c.u = b.u WHERE NOT EXISTS (SELECT 1 FROM {_VIO} s WHERE s.u = a.u AND s.i = c.i) GROUP BY 1, 2))"""


def _rename(df):
    return df.select(F.col("i").alias("contenido_id"), F.col("j").alias("contenido_similar_id"), "n_ij",
                     F.round("score", 6).alias("score"), "puesto")


_PAIR_OUT = "SELECT i AS contenido_id, j AS contenido_similar_id, n_ij, round(score, 6) AS score, puesto FROM "


@query("r01_graph_projection", f"""
    SELECT 'U' || usuario_id AS origen, 'VIO' AS relacion, 'C' || contenido_id AS destino, count(*) AS veces,
           bool_or(tipo_evento = 'completado') AS completo, 0.0::DOUBLE AS peso, '' AS fuente FROM eventos
        WHERE tipo_evento = 'vista' GROUP BY 1, 2, 3
    UNION ALL SELECT DISTINCT 'U' || usuario_id, 'GUARDO', 'C' || contenido_id, 1, FALSE, 0, '' FROM eventos WHERE tipo_evento = 'guardado'
    UNION ALL SELECT 'U' || usuario_id, CASE tipo_preferencia WHEN 'sigue' THEN 'SIGUE' ELSE 'NO_LE_INTERESA' END,
        'S' || seccion_id, 1, FALSE, 0, '' FROM preferencias WHERE seccion_id IS NOT NULL
    UNION ALL SELECT 'U' || autor_id, 'ESCRIBIO', 'C' || id, 1, FALSE, 0, '' FROM contenidos
    UNION ALL SELECT 'C' || id, 'PERTENECE_A', 'S' || seccion_id, 1, FALSE, 0, '' FROM contenidos
    UNION ALL SELECT 'C' || contenido_id, 'TIENE_ETIQUETA', 'E' || etiqueta, 1, FALSE, round(relevancia, 6), '' FROM contenidos_etiquetas
    UNION ALL SELECT 'C' || i, 'SIMILAR_A', 'C' || j, 1, FALSE, round(score, 6), 'grafo' FROM ({GRAPH_SQL})""")
def _(d):
    similar = R.neighbour_table({"grafo": R.graph_neighbours(views(d), 10)})
    edges = R.graph_edges(d.eventos, d.contenidos, d.contenidos_etiquetas, d.preferencias, similar)
    return edges.select("origen", "relacion", "destino", "veces", "completo",
                        F.round(F.coalesce("peso", F.lit(0.0)), 6).alias("peso"), F.coalesce("fuente", F.lit("")).alias("fuente"))


@query("r01_graph_nodes", """
    SELECT 'U' || u.id AS nodo, 'Usuario' AS etiqueta, CAST(json_object('usuario_id', u.id, 'pais', u.pais, 'plan',
           coalesce(p.codigo, 'sin_plan')) AS VARCHAR) AS propiedades FROM usuarios u
        LEFT JOIN suscripciones s ON s.usuario_id = u.id AND s.estado = 'activa' LEFT JOIN planes p ON p.id = s.plan_id
    UNION ALL SELECT 'C' || contenido_id, 'Contenido', titulo || '/' || a.seccion_raiz || '/' || tipo_contenido
        FROM publicables JOIN arbol a ON a.id = seccion_id
    UNION ALL SELECT 'S' || id, 'Seccion', CAST(json_object('slug', slug, 'nombre', nombre, 'raiz', seccion_raiz) AS VARCHAR) FROM arbol
    UNION ALL SELECT DISTINCT 'E' || etiqueta, 'Etiqueta', CAST(json_object('nombre', etiqueta) AS VARCHAR) FROM contenidos_etiquetas""")
def _(d):
    from feedlake.operators.privacy import users_with_plan

    nodes = R.graph_nodes(users_with_plan(d.usuarios, d.suscripciones, d.planes), publishable(d), C.section_tree(d.secciones),
                          d.etiquetas)
    # Instants are written differently by the two engines, so contents are compared on three properties.
    short = F.concat_ws("/", *[F.get_json_object("propiedades", f"$.{p}") for p in ("titulo", "seccion_raiz", "tipo")])
    return nodes.withColumn("propiedades", F.when(F.col("etiqueta") == "Contenido", short).otherwise(F.col("propiedades")))


@query("r02_co_viewing", f"""
    WITH t AS ({COVIEW_SQL} WHERE puesto <= 10),
    step AS (SELECT t.u, t.j, a.i, count(b.u) AS n FROM t JOIN {_VIO} a ON a.u = t.u
        LEFT JOIN (SELECT x.u, x.i, y.i AS j FROM {_VIO} x JOIN {_VIO} y ON x.u = y.u) b ON b.i = a.i AND b.j = t.j GROUP BY 1, 2, 3)
    SELECT t.u AS usuario_id, t.j AS contenido_id, t.caminos, t.puesto, (SELECT s.i FROM step s WHERE s.u = t.u AND s.j = t.j
        ORDER BY s.n DESC, s.i LIMIT 1) AS via FROM t""")
def _(d):
    return R.co_view_recommendations(views(d), 10).select(
        F.col("u").alias("usuario_id"), F.col("j").alias("contenido_id"), "caminos", "puesto", "via")


_BOTH = f"""(SELECT DISTINCT a, b FROM (SELECT 'U' || u AS a, 'C' || i AS b FROM {_VIO} UNION ALL SELECT 'C' || i, 'U' || u FROM {_VIO}
    UNION ALL SELECT 'C' || id, 'S' || seccion_id FROM contenidos UNION ALL SELECT 'S' || seccion_id, 'C' || id FROM contenidos))"""


@query("r03_shortest_path", f"""
    WITH e AS MATERIALIZED (SELECT a, b FROM {_BOTH}),
    camino AS (SELECT 'U3' AS nodo, 0 AS saltos UNION SELECT e.b, c.saltos + 1 FROM camino c JOIN e ON e.a = c.nodo WHERE c.saltos < 6),
    dist AS (SELECT nodo, min(saltos) AS saltos FROM camino GROUP BY 1)
    SELECT d.nodo, d.saltos, coalesce((SELECT min(p.nodo) FROM e JOIN dist p ON p.nodo = e.a WHERE e.b = d.nodo
        AND p.saltos = d.saltos - 1), '') AS previo FROM dist d""")
def _(d):
    seen = views(d).select(F.concat(F.lit("U"), "usuario_id").alias("origen"), F.concat(F.lit("C"), "contenido_id").alias("destino"))
    section = d.contenidos.select(F.concat(F.lit("C"), "id").alias("origen"), F.concat(F.lit("S"), "seccion_id").alias("destino"))
    return R.shortest_paths(seen.unionByName(section), "U3").withColumn("previo", F.coalesce("previo", F.lit("")))


@query("r04_bridge_contents", f"""
    SELECT a.i AS contenido_id, c.seccion_id, k.seccion_id AS seccion_destino, count(DISTINCT a.u) AS lectores, count(*) AS caminos
    FROM {_VIO} a JOIN contenidos c ON c.id = a.i JOIN {_VIO} b ON b.u = a.u JOIN contenidos k ON k.id = b.i
    WHERE c.seccion_id <> k.seccion_id GROUP BY 1, 2, 3""")
def _(d):
    return R.bridge_contents(views(d), d.contenidos)


@query("r05_related_tags", f"""
    SELECT i AS etiqueta, j AS etiqueta_afin, n_ij AS comunes, puesto FROM ({_pair_sql(
        '(SELECT contenido_id AS u, etiqueta AS i FROM contenidos_etiquetas)', 'n_ij::DOUBLE', 5)})""")
def _(d):
    return R.related_tags(d.contenidos_etiquetas, d.etiquetas, 5)


@query("r06_cold_start_contents", f"""
    SELECT contenido_id, parecido_id, comunes, lectores, puesto FROM (SELECT *, row_number() OVER (PARTITION BY contenido_id
        ORDER BY comunes DESC, lectores DESC, parecido_id) AS puesto FROM (
        SELECT a.contenido_id, b.contenido_id AS parecido_id, count(*) AS comunes, any_value(l.n) AS lectores
        FROM contenidos_etiquetas a JOIN contenidos_etiquetas b ON b.etiqueta = a.etiqueta
        JOIN (SELECT i, count(*) AS n FROM {_VIO} GROUP BY 1) l ON l.i = b.contenido_id
        WHERE a.contenido_id NOT IN (SELECT i FROM {_VIO}) GROUP BY 1, 2)) WHERE puesto <= 5""")
def _(d):
    return R.cold_start_similar(d.contenidos, d.contenidos_etiquetas, views(d), 5)


@query("r07_graph_neighbours", f"{_PAIR_OUT} ({GRAPH_SQL})")
def _(d):
    return _rename(R.graph_neighbours(views(d), 10))


@query("r08_item_cooccurrence", _PAIR_OUT + "(" + _pair_sql(
    "(SELECT DISTINCT usuario_id AS u, contenido_id AS i FROM cesta)", *_COSINE) + ")")
def _(d):
    return _rename(R.item_cooccurrence(d.cesta, 10))


POPULAR_SQL = f"""
    SELECT e.contenido_id AS j, round(sum(exp(-((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ocurrido_en)) / 1000000.0) / 86400.0)), 6)
           AS score FROM eventos e JOIN publicables p ON p.contenido_id = e.contenido_id
    WHERE tipo_evento = 'vista' AND ocurrido_en <= TIMESTAMP '{AS_OF}' AND ocurrido_en >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY
    GROUP BY 1"""


def popularity(d):
    """Every publishable content with reads in the last seven days, with its score."""
    p = M.popularity_by_window(d.eventos, d.contenidos, d.secciones, AS_OF).filter("ventana = '7d'")
    return p.join(publishable(d).select("contenido_id"), "contenido_id", "left_semi")


@query("r09_popularity_strategy", f"SELECT j AS contenido_id, score FROM ({POPULAR_SQL}) ORDER BY 2 DESC, 1 LIMIT 20")
def _(d):
    return K.top_global(popularity(d), 20).select("contenido_id", "score")


_SEEN = "(SELECT DISTINCT usuario_id AS u, contenido_id AS i FROM eventos)"
HYBRID_SQL = f"""
    WITH con AS (SELECT id AS u FROM usuarios WHERE consentimiento_personalizacion), cooc AS ({COOC_SQL}),
    posibles AS MATERIALIZED (SELECT g.id AS u, p.contenido_id AS j, p.seccion_id FROM usuarios g JOIN ({LEVEL_SQL}) l ON l.usuario_id = g.id
        JOIN publicables p ON p.nivel_acceso <= l.nivel_acceso WHERE g.activo
        AND NOT EXISTS (SELECT 1 FROM vetos v WHERE v.usuario_id = g.id AND v.contenido_id = p.contenido_id)
        AND NOT EXISTS (SELECT 1 FROM {_SEEN} z WHERE z.u = g.id AND z.i = p.contenido_id)),
    todas AS (
        SELECT 'popularidad' AS s, g.id AS u, p.j, p.score FROM usuarios g, ({POPULAR_SQL}) p
        UNION ALL SELECT 'embedding', usuario_id, contenido_id, similitud FROM ({FEED_SQL})
        UNION ALL SELECT 'coocurrencia', a.u, c.j, round(sum(c.score), 6) AS score FROM {_SEEN} a JOIN cooc c ON c.i = a.i
            WHERE a.u IN (SELECT u FROM con) GROUP BY 2, 3
        UNION ALL SELECT 'grafo', u, j, CAST(caminos AS DOUBLE) FROM ({COVIEW_SQL}) WHERE u IN (SELECT u FROM con)),
    senales AS (SELECT * FROM (SELECT t.*, p.seccion_id, row_number() OVER (PARTITION BY s, t.u ORDER BY score DESC, t.j) AS r
        FROM todas t JOIN posibles p ON p.u = t.u AND p.j = t.j) WHERE r <= 20),
    escala AS (SELECT *, min(score) OVER (PARTITION BY s, u) AS lo, max(score) OVER (PARTITION BY s, u) AS hi FROM senales),
    mezcla AS (SELECT u AS usuario_id, j AS contenido_id, seccion_id, round(sum(CASE s WHEN 'popularidad' THEN 0.2::DOUBLE WHEN 'grafo' THEN 0.2::DOUBLE
        ELSE 0.3::DOUBLE END * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END), 6) AS score FROM escala GROUP BY 1, 2, 3),
    tope AS (SELECT *, row_number() OVER (PARTITION BY usuario_id, seccion_id ORDER BY score DESC, contenido_id) AS q FROM mezcla)
    SELECT usuario_id, contenido_id, seccion_id, score, puesto FROM (SELECT *, row_number() OVER (PARTITION BY usuario_id
        ORDER BY score DESC, contenido_id) AS puesto FROM tope WHERE q <= 2) WHERE puesto <= 10"""


def hybrid(d, n=20, k=10):
    """Weighted blend of the four strategies' lists of what a user may get and has not seen, two per section at most.

    Access level, vetoes and seen contents are taken off each strategy before its ``n`` best are chosen.
    """
    people = cut_lineage(d.usuarios.filter("activo").select(F.col("id").alias("u")))
    agreed = C.consenting(d.usuarios)
    mine = d.eventos.join(agreed, "usuario_id", "left_semi")
    levels = cut_lineage(C.access_level_now(d.usuarios, d.suscripciones, d.planes, AS_OF).select(
        F.col("usuario_id").alias("u"), F.col("nivel_acceso").alias("nivel")))
    allowed = cut_lineage(publishable(d).select(F.col("contenido_id").alias("j"), "seccion_id", "nivel_acceso"))
    seen = cut_lineage(d.eventos.select("usuario_id", "contenido_id").distinct())

    def eligible(candidates):
        open_to = candidates.join(people, "u", "left_semi").join(allowed.drop("seccion_id"), "j").join(levels, "u").filter("nivel_acceso <= nivel")
        rows = open_to.drop("nivel", "nivel_acceso").withColumnsRenamed({"u": "usuario_id", "j": "contenido_id"})
        kept = C.without_seen(C.without_vetoed(rows, d.preferencias, d.contenidos, d.contenidos_etiquetas), seen)
        return kept.withColumnsRenamed({"usuario_id": "u", "contenido_id": "j"})

    popular = cut_lineage(popularity(d).select(F.col("contenido_id").alias("j"), "score"))

    def most_read(users, size):
        # One list for all, as deep as asked; a row of it meets each user who still needs it.
        top = popular.orderBy(F.desc("score"), "j").limit(size).agg(F.collect_list(F.struct("j", "score")).alias("lista")).select("lista").scalar()
        return (people if users is None else users).withColumn("lista", top).select("u", F.explode("lista").alias("p")).select("u", "p.j", "p.score")

    taste = cut_lineage(profile_queries(d).join(people, F.col("id") == F.col("u"), "left_semi"))

    def nearest(users, size):
        asked = taste if users is None else taste.join(users, F.col("id") == F.col("u"), "left_semi")
        return feed_for(d, asked, size).select(F.col("id").alias("u"), F.col("other").alias("j"), F.col("sim").alias("score"))

    whole = {
        "coocurrencia": R.from_neighbours(mine, R.item_cooccurrence(d.eventos, 10), None),
        "grafo": R.co_view_recommendations(views(d).join(agreed, "usuario_id", "left_semi"), None, False, views(d)).withColumnRenamed("caminos", "score"),
    }
    lists = R.eligible_top(whole, {"popularidad": most_read, "embedding": nearest}, eligible, n)
    mixed = R.blend_lists(lists).select(F.col("u").alias("usuario_id"), "j", "score").join(allowed.select("j", "seccion_id"), "j")
    return K.diversified(mixed.withColumnRenamed("j", "contenido_id"), k)


@query("r10_hybrid_feed", HYBRID_SQL)
def _(d):
    return hybrid(d).select("usuario_id", "contenido_id", "seccion_id", "score", "puesto")


def neighbour_rows(d):
    vectors = neighbours(d).select(F.col("id").alias("i"), F.col("other").alias("j"), F.col("sim").alias("score"))
    return R.neighbour_table({"embedding": vectors, "coocurrencia": R.item_cooccurrence(d.eventos, 10),
                              "grafo": R.graph_neighbours(views(d), 10)})


TABLE_SQL = f"""
    SELECT contenido_id, contenido_similar_id, 'embedding' AS origen, greatest(similitud, 0.0) AS score FROM ({NEIGHBOURS_SQL})
    UNION ALL SELECT i, j, 'coocurrencia', round(score, 6) FROM ({COOC_SQL})
    UNION ALL SELECT i, j, 'grafo', round(score, 6) FROM ({GRAPH_SQL})"""


@query("r13_neighbour_table", TABLE_SQL)
def _(d):
    return neighbour_rows(d)


@query("g10_source_diversity", f"""
    WITH n AS (SELECT t.origen, t.contenido_id, count(*) AS n, count(DISTINCT c.seccion_id) AS s FROM ({TABLE_SQL}) t
        JOIN contenidos c ON c.id = t.contenido_similar_id GROUP BY 1, 2)
    SELECT origen, count(*) AS contenidos, CAST(sum(n) AS BIGINT) AS pares,
           CAST(sum(s) AS DOUBLE) / count(*) AS secciones_por_contenido FROM n GROUP BY 1""")
def _(d):
    return R.source_diversity(neighbour_rows(d), d.contenidos)
