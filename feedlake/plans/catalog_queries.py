"""Queries over the catalogue: filters, joins, scalar expressions."""

from pyspark.sql import functions as F

from feedlake.functions import expressions as E
from feedlake.operators import catalog as C
from feedlake.plans.registry import query
from feedlake.sources.domain import AS_OF, Domain


def publishable(d: Domain):
    return C.publishable_contents(d.contenidos, d.tipos_contenido, d.secciones, AS_OF)


_PUB = "contenido_id, titulo, nivel_acceso, tipo_contenido, seccion_id, seccion_slug, seccion, autor_id"


@query("f01_publishable_contents", f"SELECT {_PUB} FROM publicables")
def _(d):
    return publishable(d).select(*_PUB.split(", "))


@query("f02_access_level_filter", """
    SELECT n.usuario_id, n.nivel_acceso, CAST(count(p.contenido_id) AS BIGINT) AS contenidos_visibles FROM (
        SELECT u.id AS usuario_id, coalesce(max(pl.nivel_acceso), 0) AS nivel_acceso FROM usuarios u
        LEFT JOIN suscripciones s ON s.usuario_id = u.id AND s.estado = 'activa'
             AND s.desde <= TIMESTAMP '2024-01-31' AND (s.hasta IS NULL OR s.hasta > TIMESTAMP '2024-01-31')
        LEFT JOIN planes pl ON pl.id = s.plan_id GROUP BY u.id) n
    LEFT JOIN publicables p ON p.nivel_acceso <= n.nivel_acceso GROUP BY 1, 2""")
def _(d):
    levels = C.access_level_now(d.usuarios, d.suscripciones, d.planes, AS_OF)
    return C.visible_count_by_user(publishable(d), levels)


@query("f03_chronological_feed", """
    SELECT id, titulo, fecha_publicacion FROM contenidos WHERE estado = 'publicado'
    ORDER BY fecha_publicacion DESC, id LIMIT 50""")
def _(d):
    return C.chronological_feed(d.contenidos, 50).select("id", "titulo", "fecha_publicacion")


@query("f03_section_feed", """
    SELECT id, titulo, nivel_acceso FROM contenidos WHERE estado = 'publicado' AND seccion_id = 107 AND nivel_acceso <= 1
    ORDER BY fecha_publicacion DESC, id LIMIT 20""")
def _(d):
    return C.chronological_feed(d.contenidos, 20, section_id=107, level=1).select("id", "titulo", "nivel_acceso")


@query("f04_json_containment", """
    SELECT id, titulo FROM contenidos WHERE json_extract_string(metadatos, '$.brand') = 'Brand#7'
    AND json_extract_string(metadatos, '$.destacado') = 'true'""")
def _(d):
    return C.metadata_contains(d.contenidos, "metadatos", {"brand": "Brand#7", "destacado": "true"}).select("id", "titulo")


@query("f05_json_key_existence", """
    SELECT id, titulo FROM contenidos WHERE list_contains(json_keys(metadatos), 'destacado')""")
def _(d):
    return C.metadata_has_key(d.contenidos, "metadatos", "destacado").select("id", "titulo")


@query("f06_clicked_impressions", "SELECT id, usuario_id, contenido_id, clic_en FROM impresiones WHERE clic")
def _(d):
    return d.impresiones.filter("clic").select("id", "usuario_id", "contenido_id", "clic_en")


@query("f07_impressions_of_user", """
    SELECT id, usuario_id, mostrado_en, orden FROM (SELECT *, row_number() OVER (
        PARTITION BY usuario_id ORDER BY mostrado_en DESC, id DESC) AS orden FROM impresiones) WHERE orden <= 5""")
def _(d):
    return C.latest_per_user(d.impresiones, "mostrado_en", "id", 5).select("id", "usuario_id", "mostrado_en", "orden")


@query("f08_time_range_scan", """
    SELECT id, mostrado_en, strftime(mostrado_en, '%Y-%m') AS mes FROM impresiones
    WHERE mostrado_en >= TIMESTAMP '2024-01-10' AND mostrado_en < TIMESTAMP '2024-01-20'""")
def _(d):
    with_month = d.impresiones.withColumn("mes", E.month_text(F.col("mostrado_en")))
    return C.between_instants(with_month, "2024-01-10", "2024-01-20").select("id", "mostrado_en", "mes")


@query("f09_moderator_inbox", """
    SELECT comentario_id, texto, creado_en FROM comentarios WHERE orden = 0 AND estado_moderacion = 'pendiente'""")
def _(d):
    return C.moderator_inbox(d.comentarios.filter("orden = 0")).select("comentario_id", "texto", "creado_en")


@query("f10_contents_with_quote", """
    SELECT contenido_id, idioma FROM bloques GROUP BY 1, 2 HAVING bool_or(tipo = 'cita')""")
def _(d):
    return C.with_block_of_type(d.cuerpos, "cita").select("contenido_id", "idioma")


@query("f11_retention_window", """
    SELECT evento_id, ocurrido_en FROM eventos WHERE ocurrido_en >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY""")
def _(d):
    return C.retained(d.eventos, "ocurrido_en", AS_OF, 14).select("evento_id", "ocurrido_en")


@query("f12_retention_by_month", """
    SELECT strftime(ocurrido_en, '%Y-%m') AS mes, count(*) AS filas FROM (
        SELECT o_orderdate AS ocurrido_en FROM orders) WHERE strftime(ocurrido_en, '%Y-%m') >= '2000-07' GROUP BY 1""")
def _(d):
    from feedlake.sources.loading import months_to_keep

    facts = d.table("orders").select(F.col("o_orderdate").alias("ocurrido_en")).withColumn(
        "mes", E.month_text(F.col("ocurrido_en")))
    return months_to_keep(facts, "2001-07-15", 12).groupBy("mes").agg(F.count(F.lit(1)).alias("filas"))


@query("f13_cold_start_gate", """
    SELECT u.id AS usuario_id, count(DISTINCT e.contenido_id) AS contenidos_distintos,
           count(DISTINCT e.contenido_id) < 4 AS frio
    FROM usuarios u LEFT JOIN eventos e ON e.usuario_id = u.id GROUP BY 1""")
def _(d):
    return C.cold_users(d.usuarios, d.eventos)


@query("f14_consent_gate", """
    SELECT evento_id, usuario_id FROM eventos WHERE usuario_id IN (
        SELECT id FROM usuarios WHERE consentimiento_personalizacion)""")
def _(d):
    return d.eventos.join(C.consenting(d.usuarios), "usuario_id", "left_semi").select("evento_id", "usuario_id")


@query("f15_playable_contents", """
    SELECT c.id, t.codigo AS tipo_contenido, c.duracion_seg FROM contenidos c JOIN tipos_contenido t
    ON t.id = c.tipo_contenido_id WHERE t.admite_duracion AND c.duracion_seg IS NOT NULL""")
def _(d):
    return C.playable(d.contenidos, d.tipos_contenido).select("id", "tipo_contenido", "duracion_seg")


# ---- joins ---------------------------------------------------------------------------------------

@query("j01_fact_to_dimension", """
    SELECT i.id, e.codigo AS estrategia, e.motor FROM impresiones i JOIN estrategias e ON e.id = i.estrategia_id""")
def _(d):
    s = d.estrategias.select(F.col("id").alias("estrategia_id"), F.col("codigo").alias("estrategia"), "motor")
    return d.impresiones.join(s, "estrategia_id").select("id", "estrategia", "motor")


@query("j02_left_outer_plan", """
    SELECT u.id AS usuario_id, coalesce(p.codigo, 'sin_plan') AS plan FROM usuarios u
    LEFT JOIN suscripciones s ON s.usuario_id = u.id AND s.estado = 'activa' LEFT JOIN planes p ON p.id = s.plan_id""")
def _(d):
    from feedlake.operators.privacy import users_with_plan

    return users_with_plan(d.usuarios, d.suscripciones, d.planes).select(F.col("id").alias("usuario_id"), "plan")


@query("j03_contents_outside_tree", """
    SELECT c.id FROM (SELECT id, CASE WHEN id % 40 = 0 THEN 9 ELSE seccion_id END AS seccion_id FROM contenidos) c
    LEFT JOIN arbol a ON a.id = c.seccion_id WHERE a.id IS NULL""")
def _(d):
    moved = d.contenidos.withColumn("seccion_id", F.when(F.col("id") % 40 == 0, 9).otherwise(F.col("seccion_id")))
    return C.outside_tree(moved, C.section_tree(d.secciones)).select("id")


@query("j04_semi_join", """
    SELECT id, titulo FROM contenidos c WHERE EXISTS (
        SELECT 1 FROM contenidos_etiquetas e WHERE e.contenido_id = c.id AND e.etiqueta = 'red')""")
def _(d):
    red = d.contenidos_etiquetas.filter(F.col("etiqueta") == "red").select(F.col("contenido_id").alias("id"))
    return d.contenidos.join(red, "id", "left_semi").select("id", "titulo")


@query("j05_user_vetoes", "SELECT usuario_id, contenido_id FROM vetos")
def _(d):
    return C.user_vetoes(d.preferencias, d.contenidos, d.contenidos_etiquetas)


@query("j05_user_vetoes_descendants", """
    SELECT DISTINCT p.usuario_id, c.id AS contenido_id FROM (
        SELECT usuario_id, CAST(seccion_id % 5 + 1 AS INT) AS seccion_id FROM preferencias
        WHERE tipo_preferencia = 'no_interesa' AND seccion_id IS NOT NULL) p
    JOIN secciones s ON s.seccion_padre_id = p.seccion_id JOIN contenidos c ON c.seccion_id = s.id""")
def _(d):
    roots = d.preferencias.filter(F.col("seccion_id").isNotNull()).withColumn(
        "seccion_id", (F.col("seccion_id") % 5 + 1).cast("int"))
    return C.user_vetoes(roots, d.contenidos, d.contenidos_etiquetas, C.section_descendants(d.secciones))


@query("j06_parameter_relation", """
    WITH ventana AS (SELECT max(mostrado_en) AS corte FROM impresiones)
    SELECT id, mostrado_en FROM impresiones, ventana WHERE mostrado_en >= corte - INTERVAL 7 DAY""")
def _(d):
    from feedlake.operators.metrics import cutoff

    return d.impresiones.filter(
        F.col("mostrado_en") >= cutoff(d.impresiones) - F.expr("INTERVAL 7 DAYS")).select("id", "mostrado_en")


@query("j07_section_tree", """
    SELECT id AS seccion_id, slug, nombre, coalesce(seccion_padre_id, 0) AS seccion_padre_id, profundidad,
           seccion_raiz_id, seccion_raiz, camino FROM arbol""")
def _(d):
    return C.section_tree(d.secciones).withColumn("seccion_padre_id", F.coalesce("seccion_padre_id", F.lit(0)))


@query("j08_access_level_at_instant", """
    SELECT i.usuario_id, i.mostrado_en, i.hechos, coalesce(max(p.nivel_acceso), 0) AS nivel_entonces FROM (
        SELECT o_custkey AS usuario_id, l_shipdate AS mostrado_en, count(*) AS hechos
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) i
    LEFT JOIN suscripciones s ON s.usuario_id = i.usuario_id AND s.desde <= i.mostrado_en
         AND (s.hasta IS NULL OR i.mostrado_en < s.hasta)
    LEFT JOIN planes p ON p.id = s.plan_id GROUP BY 1, 2, 3""")
def _(d):
    o = d.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("usuario_id"))
    facts = d.table("lineitem").join(o, "l_orderkey").select(
        "usuario_id", F.col("l_shipdate").alias("mostrado_en")).groupBy("usuario_id", "mostrado_en").agg(F.count("*").alias("hechos"))
    return C.access_level_at(facts, "mostrado_en", d.suscripciones, d.planes)


@query("j09_cross_store_enrichment", """
    SELECT i.id, i.contenido_id, p.titulo, p.seccion FROM impresiones i JOIN publicables p USING (contenido_id)""")
def _(d):
    return C.enrich(d.impresiones.select("id", "contenido_id"), publishable(d)).select(
        "id", "contenido_id", "titulo", "seccion")


@query("j10_veto_subtraction", """
    SELECT DISTINCT i.usuario_id, i.contenido_id FROM impresiones i
    WHERE NOT EXISTS (SELECT 1 FROM vetos v WHERE v.usuario_id = i.usuario_id AND v.contenido_id = i.contenido_id)""")
def _(d):
    pairs = d.impresiones.select("usuario_id", "contenido_id").distinct()
    return C.without_vetoed(pairs, d.preferencias, d.contenidos, d.contenidos_etiquetas)


@query("j11_seen_subtraction", """
    SELECT DISTINCT i.usuario_id, i.contenido_id FROM impresiones i WHERE NOT EXISTS (
        SELECT 1 FROM eventos e WHERE e.tipo_evento = 'vista' AND e.usuario_id = i.usuario_id
        AND e.contenido_id = i.contenido_id)""")
def _(d):
    pairs = d.impresiones.select("usuario_id", "contenido_id").distinct()
    return C.without_seen(pairs, d.eventos.filter(F.col("tipo_evento") == "vista"))


@query("j12_content_tags", """
    SELECT c.id AS contenido_id, c.titulo, e.etiqueta, round(e.relevancia, 3) AS relevancia
    FROM contenidos c JOIN contenidos_etiquetas e ON e.contenido_id = c.id""")
def _(d):
    return C.tags_of_contents(d.contenidos, d.contenidos_etiquetas).withColumn("relevancia", F.round("relevancia", 3))


@query("j13_polymorphic_reference", """
    SELECT m.id, m.objeto_tipo, m.objeto_id, m.accion, coalesce(c.titulo, k.texto, '') AS objeto FROM moderaciones m
    LEFT JOIN contenidos c ON m.objeto_tipo = 'contenido' AND c.id = m.contenido_id
    LEFT JOIN (SELECT comentario_id, texto FROM comentarios WHERE orden = 0) k
         ON m.objeto_tipo = 'comentario' AND CAST(k.comentario_id AS VARCHAR) = m.objeto_id""")
def _(d):
    out = C.resolve_moderations(d.moderaciones, d.contenidos, d.comentarios.filter("orden = 0"))
    return out.withColumn("objeto", F.coalesce("objeto", F.lit("")))


@query("j15_users_with_idle", """
    SELECT u.id AS usuario_id, count(e.evento_id) AS eventos FROM usuarios u LEFT JOIN eventos e ON e.usuario_id = u.id
    GROUP BY 1""")
def _(d):
    return C.activity_with_idle(d.usuarios, d.eventos)


@query("j15_contents_never_shown", """
    SELECT id AS contenido_id, titulo FROM contenidos WHERE id NOT IN (SELECT contenido_id FROM impresiones)""")
def _(d):
    return C.never_shown(d.contenidos, d.impresiones)


@query("u02_recursive_union", """
    SELECT seccion_raiz, profundidad, count(*) AS secciones FROM arbol GROUP BY 1, 2""")
def _(d):
    return C.section_tree(d.secciones).groupBy("seccion_raiz", "profundidad").agg(F.count("*").alias("secciones"))


@query("u05_set_subtraction", """
    SELECT DISTINCT usuario_id, contenido_id FROM impresiones EXCEPT SELECT usuario_id, contenido_id FROM vetos""")
def _(d):
    pairs = d.impresiones.select("usuario_id", "contenido_id").distinct()
    return pairs.subtract(C.user_vetoes(d.preferencias, d.contenidos, d.contenidos_etiquetas, among=pairs))


# ---- unions and scalar expressions ----------------------------------------------------------------

@query("u01_labelled_counts", """
    SELECT 'contenidos' AS tabla, count(*) AS filas FROM contenidos UNION ALL SELECT 'impresiones', count(*) FROM impresiones
    UNION ALL SELECT 'secciones', count(*) FROM secciones UNION ALL SELECT 'usuarios', count(*) FROM usuarios""")
def _(d):
    from feedlake.operators.metrics import row_counts

    return row_counts({"contenidos": d.contenidos, "impresiones": d.impresiones, "secciones": d.secciones,
                       "usuarios": d.usuarios})


@query("u03_distinct_pairs", "SELECT DISTINCT usuario_id, contenido_id FROM eventos")
def _(d):
    return d.eventos.select("usuario_id", "contenido_id").distinct()


@query("e01_conditionals", """
    SELECT id, CASE WHEN clic THEN posicion ELSE 0 END AS puesto, coalesce(clic_en, mostrado_en) AS ultimo,
           coalesce(nullif(superficie, 'home'), 'portada') AS lugar FROM impresiones""")
def _(d):
    return d.impresiones.select(
        "id", F.when(F.col("clic"), F.col("posicion")).otherwise(0).alias("puesto"),
        F.coalesce("clic_en", "mostrado_en").alias("ultimo"),
        F.coalesce(F.nullif(F.col("superficie"), F.lit("home")), F.lit("portada")).alias("lugar"))


@query("e02_numeric", """
    SELECT evento_id, round(segundos / 7, 3) AS septimo, round(exp(-segundos / 100), 6) AS peso,
           CAST(floor(segundos) AS BIGINT) AS entero FROM eventos""")
def _(d):
    s = F.col("segundos")
    return d.eventos.select("evento_id", F.round(s / 7, 3).alias("septimo"), F.round(F.exp(-s / 100), 6).alias("peso"),
                            F.floor(s).alias("entero"))


@query("e03_dates", """
    SELECT evento_id, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ocurrido_en)) / 1000000.0, 3) AS segundos_atras,
           strftime(date_trunc('month', ocurrido_en), '%Y-%m-%d') AS mes, ocurrido_en + INTERVAL 7 DAY AS limite FROM eventos""")
def _(d):
    return d.eventos.select(
        "evento_id", F.round(E.elapsed_seconds(E.literal_ts(AS_OF), F.col("ocurrido_en")), 3).alias("segundos_atras"),
        F.date_format(F.trunc(F.col("ocurrido_en").cast("date"), "month"), "yyyy-MM-dd").alias("mes"),
        (F.col("ocurrido_en") + F.expr("INTERVAL 7 DAYS")).alias("limite"))


@query("e05_strings", """
    SELECT id, titulo || ' (' || coalesce(bajada, '') || ')' AS rotulo, substring(titulo, 1, 4) AS inicio,
           length(titulo) AS largo FROM contenidos""")
def _(d):
    return d.contenidos.select(
        "id", F.concat("titulo", F.lit(" ("), F.coalesce("bajada", F.lit("")), F.lit(")")).alias("rotulo"),
        F.substring("titulo", 1, 4).alias("inicio"), F.length("titulo").cast("long").alias("largo"))


@query("e06_slug", """
    SELECT doc_id, regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}]', '-', 'g'),
           '^-+|-+$', '', 'g') AS slug FROM documents""")
def _(d):
    return d.table("documents").select("doc_id", E.slug(F.col("text")).alias("slug"))


@query("e07_json_row", """
    SELECT id, json_extract_string(json_object('id', id, 'titulo', titulo), '$.titulo') AS titulo,
           json_extract_string(metadatos, '$.brand') AS marca FROM contenidos""")
def _(d):
    row = F.to_json(F.struct("id", "titulo"))
    return d.contenidos.select("id", F.get_json_object(row, "$.titulo").alias("titulo"),
                               F.get_json_object("metadatos", "$.brand").alias("marca"))


@query("e12_session_key", """
    SELECT evento_id, 'S-' || lpad(CAST(usuario_id AS VARCHAR), 6, '0') || '-' || strftime(ocurrido_en, '%Y%m%d%H') AS sesion_id
    FROM eventos""")
def _(d):
    return d.eventos.select("evento_id", E.session_key(F.col("usuario_id"), F.col("ocurrido_en")).alias("sesion_id"))


@query("e13_block_word_count", """
    SELECT contenido_id, CAST(sum(len(list_filter(regexp_split_to_array(texto, '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))) AS BIGINT)
           AS palabras, count(*) AS bloques FROM bloques GROUP BY 1""")
def _(d):
    words = F.aggregate(
        F.transform("bloques", lambda b: F.size(E.tokens(b["texto"])).cast("long")), F.lit(0).cast("long"),
        lambda a, n: a + n)
    return d.cuerpos.filter(F.size("bloques") > 0).select(
        "contenido_id", words.alias("palabras"), F.size("bloques").cast("long").alias("bloques"))


@query("e13_embedded_replies", """
    SELECT comentario_id, count(*) FILTER (WHERE orden > 0) AS respuestas, CAST(max(orden) AS BIGINT) AS ultimo_orden
    FROM comentarios GROUP BY 1""")
def _(d):
    return d.comentarios.groupBy("comentario_id").agg(
        F.count_if(F.col("orden") > 0).alias("respuestas"), F.max("orden").cast("long").alias("ultimo_orden"))


@query("e14_embedding_source_text", """
    SELECT c.id AS contenido_id, s.nombre || '. ' || c.titulo || '. ' || c.bajada || ' Temas: ' || e.temas AS texto_fuente
    FROM contenidos c JOIN secciones s ON s.id = c.seccion_id JOIN (
        SELECT contenido_id, string_agg(etiqueta, ', ' ORDER BY etiqueta) AS temas FROM contenidos_etiquetas GROUP BY 1) e
    ON e.contenido_id = c.id""")
def _(d):
    from feedlake.operators.search import embedding_sources

    return embedding_sources(d.contenidos, d.secciones, d.contenidos_etiquetas)


@query("e15_ab_assignment", """
    SELECT id AS usuario_id, CASE WHEN id % 2 = 0 THEN 'tratamiento' ELSE 'control' END AS variante FROM usuarios""")
def _(d):
    return d.usuarios.select(F.col("id").alias("usuario_id"), E.ab_variant(F.col("id")).alias("variante"))
