"""Queries: constraints, reconciliation and loading."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedlake.operators import catalog as C
from feedlake.operators import metrics as M
from feedlake.operators import quality as Q
from feedlake.plans import declared as D
from feedlake.plans.registry import query
from feedlake.plans.vectors_queries import PROFILE_SQL, profiles
from feedlake.session import run_folder
from feedlake.sources import loading as L
from feedlake.sources import readers as R
from feedlake.sources.domain import AS_OF

# Frames with known defects, the same in Spark and in SQL.
_BAD_CONTENTS = """(SELECT id, titulo, seccion_id, tipo_contenido_id, vigente_hasta,
    CASE WHEN id % 101 = 0 THEN 'perdido' ELSE estado END AS estado,
    CASE WHEN id % 103 = 0 THEN 7 ELSE nivel_acceso END AS nivel_acceso,
    CASE WHEN id % 107 = 0 THEN 0 ELSE duracion_seg END AS duracion_seg,
    CASE WHEN id % 41 = 0 THEN NULL ELSE fecha_publicacion END AS fecha_publicacion FROM contenidos)"""
_BAD_IMPRESSIONS = """(SELECT id, usuario_id, contenido_id, estrategia_id, superficie, mostrado_en, clic, score,
    CASE WHEN id % 211 = 0 THEN 99 ELSE posicion END AS posicion,
    CASE WHEN id % 31 = 0 THEN NULL WHEN id % 37 = 0 THEN clic_en - INTERVAL 60 SECOND ELSE clic_en END AS clic_en
    FROM impresiones)"""


def _bad_contents(d):
    k = F.col("id")
    return d.contenidos.withColumns({
        "estado": F.when(k % 101 == 0, "perdido").otherwise(F.col("estado")),
        "nivel_acceso": F.when(k % 103 == 0, 7).otherwise(F.col("nivel_acceso")),
        "duracion_seg": F.when(k % 107 == 0, 0).otherwise(F.col("duracion_seg")),
        "fecha_publicacion": F.when(k % 41 != 0, F.col("fecha_publicacion"))})


def _bad_impressions(d):
    k = F.col("id")
    return d.impresiones.withColumns({
        "posicion": F.when(k % 211 == 0, 99).otherwise(F.col("posicion")),
        "clic_en": F.when(k % 31 == 0, None).when(k % 37 == 0, F.col("clic_en") - F.expr("INTERVAL 60 SECONDS"))
        .otherwise(F.col("clic_en"))})


@query("p1_row_rules", " UNION ALL ".join(
    f"SELECT '{table}' AS tabla, '{rule}' AS regla, count(*) FILTER (WHERE NOT coalesce(({predicate}), TRUE)) AS violaciones "
    f"FROM {D.source_sql(table)}" for table, rules in Q.ROW_RULES.items() for rule, predicate in rules.items()))
def _(d):
    """Every declared rule of every declared table; a table without a frame stops the job."""
    return reduce(DataFrame.unionByName, [Q.check_rows(table, D.frame(d, table)) for table in Q.ROW_RULES])


#: Keys checked beside the declared ones: tables of the driver, and a pair of columns that is no key.
_MORE_KEYS = {
    "eventos": [["evento_id"], ["usuario_id", "contenido_id"]], "moderaciones": [["id"]], "planes": [["id"]],
    "tipos_contenido": [["id"], ["codigo"]], "consentimientos": [["id"]], "comentarios": [["comentario_id", "orden"]],
}
_KEYED = Q.KEYS | _MORE_KEYS


@query("p2_key_rules", " UNION ALL ".join(
    f"SELECT '{table}' AS tabla, 'unica_{'_'.join(key)}' AS regla, (SELECT count(*) FROM (SELECT {', '.join(key)} FROM {D.source_sql(table)} "
    f"WHERE {' AND '.join(f'{c} IS NOT NULL' for c in key)} GROUP BY ALL HAVING count(*) > 1)) AS violaciones"
    for table, keys in _KEYED.items() for key in keys))
def _(d):
    """Every declared key, and a few more, in one exchange."""
    return Q.check_keys([(table, D.frame(d, table), keys) for table, keys in _KEYED.items()])


@query("p3_one_active_subscription", """
    SELECT 'suscripciones' AS tabla, 'una_activa' AS regla, (SELECT count(*) FROM (SELECT usuario_id FROM suscripciones
        WHERE estado = 'activa' OR id % 7 = 0 GROUP BY 1 HAVING count(*) > 1)) AS violaciones""")
def _(d):
    both = (F.col("estado") == "activa") | (F.col("id") % 7 == 0)
    return Q.check_conditional_key("suscripciones", d.suscripciones, ["usuario_id"], both, "una_activa")


#: Targets of references: SQL source and frame, all keyed by ``id``.
_TARGETS = {
    "publicados": ("(SELECT * FROM contenidos WHERE estado = 'publicado')", lambda d: d.contenidos.filter("estado = 'publicado'")),
    "contenidos": ("contenidos", lambda d: d.contenidos), "usuarios": ("usuarios", lambda d: d.usuarios),
    "secciones": ("secciones", lambda d: d.secciones), "tipos_contenido": ("tipos_contenido", lambda d: d.tipos_contenido),
    "estrategias": ("estrategias", lambda d: d.estrategias), "planes": ("planes", lambda d: d.planes),
}
#: Checked references: table, SQL source, frame, and the target of each column.
_REFERRING = [
    ("eventos", "eventos", lambda d: d.eventos, {"contenido_id": "publicados", "usuario_id": "usuarios"}),
    ("contenidos", "contenidos", lambda d: d.contenidos, {"seccion_id": "secciones", "tipo_contenido_id": "tipos_contenido"}),
    ("impresiones", "impresiones", lambda d: d.impresiones,
     {"estrategia_id": "estrategias", "usuario_id": "usuarios", "contenido_id": "contenidos"}),
    ("embeddings", "embeddings_c", lambda d: d.embeddings, {"contenido_id": "contenidos"}),
    ("suscripciones", "suscripciones", lambda d: d.suscripciones, {"usuario_id": "usuarios", "plan_id": "planes"}),
    ("preferencias", "preferencias", lambda d: d.preferencias, {"usuario_id": "usuarios", "seccion_id": "secciones"}),
    ("consentimientos", "consentimientos", lambda d: d.consentimientos, {"usuario_id": "usuarios"}),
    ("contenidos_etiquetas", "contenidos_etiquetas", lambda d: d.contenidos_etiquetas, {"contenido_id": "contenidos"}),
    ("versiones_contenido", "versiones", lambda d: d.versiones, {"contenido_id": "contenidos", "editor_id": "usuarios"}),
    ("moderaciones", "moderaciones", lambda d: d.moderaciones, {"contenido_id": "contenidos"}),
    ("secciones", "secciones", lambda d: d.secciones, {"seccion_padre_id": "secciones"}),
    ("telemetria", "telemetria", lambda d: d.telemetria, {"contenido_id": "contenidos", "usuario_id": "usuarios"}),
    ("busquedas", "busquedas", lambda d: d.busquedas, {"contenido_id": "contenidos"}),
]


@query("p4_foreign_keys", " UNION ALL ".join(
    f"SELECT '{table}' AS tabla, 'fk_{column}' AS regla, (SELECT count(*) FROM {source} WHERE {column} IS NOT NULL AND {column} NOT IN "
    f"(SELECT id FROM {_TARGETS[target][0]})) AS violaciones" for table, source, _, refs in _REFERRING for column, target in refs.items()))
def _(d):
    return Q.check_references([(table, frame(d), refs) for table, _, frame, refs in _REFERRING],
                              {name: (frame(d), "id") for name, (_, frame) in _TARGETS.items()})


@query("p5_schema_contract", """
    SELECT 'suscripciones' AS tabla, c AS columna, d AS declarado, e AS encontrado, d = e AS cumple, n AS filas
    FROM (VALUES ('id', 'bigint', 'bigint'), ('usuario_id', 'bigint', 'bigint'), ('plan_id', 'int', 'int'),
                 ('desde', 'timestamp_ntz', 'timestamp_ntz'), ('hasta', 'timestamp_ntz', 'timestamp_ntz'), ('estado', 'string', 'int'),
                 ('sobra', '-', 'string'), ('falta', 'date', '-')) v(c, d, e),
         (SELECT count(*) AS n FROM suscripciones)""")
def _(d):
    """The schema of a written table as its files state it, with a wrong, an unknown and a missing column planted."""
    contract = StructType.fromDDL("id BIGINT, usuario_id BIGINT, plan_id INT, desde TIMESTAMP_NTZ, hasta TIMESTAMP_NTZ, estado STRING, falta DATE")
    path = run_folder(d.spark, "esquema")
    d.suscripciones.withColumns({"estado": F.length("estado"), "sobra": F.lit("x")}).write.parquet(path)
    written = d.spark.read.parquet(path)
    return Q.check_schema("suscripciones", written, contract).withColumn("filas", written.agg(F.count("*").alias("n")).scalar())


@query("p6_required_fields", """
    SELECT coalesce(CASE WHEN usuario_id IS NULL THEN 'falta usuario_id' END, CASE WHEN contenido_id IS NULL AND NOT id_malo
           THEN 'falta contenido_id' END, 'valida') AS destino, count(*) AS filas FROM lotes GROUP BY 1""")
def _(d):
    good, bad = Q.split_required(d.lotes, ["usuario_id", "contenido_id", "tipo_evento", "ocurrido_en"])
    return good.select(F.lit("valida").alias("destino")).unionByName(
        bad.select(F.col("motivo_rechazo").alias("destino"))).groupBy("destino").agg(F.count("*").alias("filas"))


@query("q01_counts_against_ledger", """
    SELECT 'contenidos' AS entidad, count(*) + 3 AS esperadas, count(*) AS encontradas, CAST(-3 AS BIGINT) AS diferencia FROM contenidos
    UNION ALL SELECT 'impresiones', count(*), count(*), 0 FROM impresiones""")
def _(d):
    counts = M.row_counts({"contenidos": d.contenidos, "impresiones": d.impresiones})
    declared = counts.select(F.col("tabla").alias("entidad"), (
        F.col("filas") + F.when(F.col("tabla") == "contenidos", 3).otherwise(0)).alias("esperadas"))
    return R.compare_counts(declared, counts)


@query("q02_published_without_date", f"""
    SELECT id, titulo FROM {_BAD_CONTENTS} WHERE estado = 'publicado' AND fecha_publicacion IS NULL""")
def _(d):
    return Q.published_without_date(_bad_contents(d)).select("id", "titulo")


@query("q03_several_active_subscriptions", """
    SELECT usuario_id, count(*) AS filas FROM suscripciones WHERE estado = 'activa' OR id % 7 = 0 GROUP BY 1 HAVING count(*) > 1""")
def _(d):
    return M.duplicates(d.suscripciones.filter("estado = 'activa' OR id % 7 = 0"), ["usuario_id"])


@query("q04_active_but_expired", """
    SELECT id, usuario_id FROM suscripciones WHERE hasta <= TIMESTAMP '2000-01-01'""")
def _(d):
    return Q.active_but_expired(d.suscripciones.withColumn("estado", F.lit("activa")), "2000-01-01 00:00:00").select(
        "id", "usuario_id")


@query("q05_click_without_time", f"SELECT id FROM {_BAD_IMPRESSIONS} WHERE clic AND clic_en IS NULL")
def _(d):
    return Q.clicked_without_time(_bad_impressions(d)).select("id")


@query("q06_catch_all_partition", """
    SELECT l_orderkey, l_linenumber FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') NOT IN ('1998-01', '1998-02', '1998-03')""")
def _(d):
    facts = d.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("mostrado_en"))
    return Q.outside_declared_months(facts, ["1998-01", "1998-02", "1998-03"]).select("l_orderkey", "l_linenumber")


# Computed profiles; some are planted under a user who does not consent, as if the consent had been withdrawn afterwards.
_WITHDRAWN = "CASE WHEN usuario_id % 23 = 0 THEN usuario_id - usuario_id % 100 + 90 ELSE usuario_id END"
_KEPT_PROFILES = f"(SELECT {_WITHDRAWN} AS usuario_id, cantidad_eventos FROM ({PROFILE_SQL}))"


def _kept_profiles(d):
    return profiles(d).select(F.expr(_WITHDRAWN).alias("usuario_id"), "cantidad_eventos")


@query("q07_profiles_without_consent", f"""
    SELECT usuario_id, cantidad_eventos FROM {_KEPT_PROFILES} WHERE usuario_id IN (SELECT id FROM usuarios WHERE NOT consentimiento_personalizacion)""")
def _(d):
    return Q.profiles_without_consent(_kept_profiles(d), d.usuarios)


@query("q08_outside_section_tree", """
    SELECT id FROM (SELECT id, CASE WHEN id % 23 = 0 THEN 77 ELSE seccion_id END AS s FROM contenidos) WHERE s NOT IN (SELECT id FROM arbol)""")
def _(d):
    moved = d.contenidos.withColumn("seccion_id", F.when(F.col("id") % 23 == 0, 77).otherwise(F.col("seccion_id")))
    return C.outside_tree(moved, C.section_tree(d.secciones)).select("id")


@query("q09_integrity_report", f"""
    SELECT 'contenidos' AS tabla, 'publicados_sin_fecha' AS regla, count(*) FILTER (WHERE estado = 'publicado'
        AND fecha_publicacion IS NULL) AS violaciones FROM {_BAD_CONTENTS}
    UNION ALL SELECT 'suscripciones', 'varias_activas', (SELECT count(*) FROM (SELECT usuario_id FROM suscripciones
        WHERE estado = 'activa' GROUP BY 1 HAVING count(*) > 1))
    UNION ALL SELECT 'suscripciones', 'activas_vencidas', count(*) FILTER (WHERE estado = 'activa' AND hasta <= TIMESTAMP '{AS_OF}')
        FROM suscripciones
    UNION ALL SELECT 'impresiones', 'particion_default', 0
    UNION ALL SELECT 'impresiones', 'clics_sin_fecha', count(*) FILTER (WHERE clic AND clic_en IS NULL) FROM {_BAD_IMPRESSIONS}
    UNION ALL SELECT 'contenidos', 'seccion_fuera_del_arbol', count(*) FILTER (WHERE seccion_id NOT IN (SELECT id FROM arbol))
        FROM contenidos
    UNION ALL SELECT 'perfiles', 'perfiles_sin_consentimiento', (SELECT count(DISTINCT usuario_id) FROM eventos WHERE usuario_id IN
        (SELECT id FROM usuarios WHERE NOT consentimiento_personalizacion))""")
def _(d):
    return Q.integrity_report({
        "contenidos": _bad_contents(d), "suscripciones": d.suscripciones, "impresiones": _bad_impressions(d),
        "arbol": C.section_tree(d.secciones), "perfiles": d.eventos.select("usuario_id").distinct(),
        "usuarios": d.usuarios}, ["2024-01"], AS_OF)


@query("q10_code_completeness", """
    SELECT 'planes' AS tabla, count(DISTINCT plan_id) AS usados, count(*) FILTER (plan_id NOT IN (SELECT id FROM planes)) AS desconocidos
    FROM suscripciones
    UNION ALL SELECT 'tipos_contenido', count(DISTINCT tipo_contenido_id),
        count(*) FILTER (tipo_contenido_id NOT IN (SELECT id FROM tipos_contenido)) FROM contenidos
    UNION ALL SELECT 'estrategias', count(DISTINCT e), count(*) FILTER (e NOT IN (SELECT id FROM estrategias))
    FROM (SELECT CASE WHEN id % 500 = 0 THEN 99 ELSE estrategia_id END AS e FROM impresiones)""")
def _(d):
    """Codes that the facts use against the code lists; a code that no list has is planted in some impressions."""
    shown = d.impresiones.select(F.when(F.col("id") % 500 == 0, 99).otherwise(F.col("estrategia_id")).alias("estrategia_id"))
    return reduce(DataFrame.unionByName, [
        Q.unknown_codes("planes", d.suscripciones, "plan_id", d.planes),
        Q.unknown_codes("tipos_contenido", d.contenidos, "tipo_contenido_id", d.tipos_contenido),
        Q.unknown_codes("estrategias", shown, "estrategia_id", d.estrategias)])


@query("q12_live_against_gold_ctr", """
    SELECT estrategia_key, count(*) AS impresiones_a, count(*) AS impresiones_b, 0::BIGINT AS impresiones_dif,
           count(*) FILTER (WHERE clic) AS clics_a, count(*) FILTER (WHERE clic) AS clics_b, 0::BIGINT AS clics_dif
    FROM (SELECT estrategia_id AS estrategia_key, clic FROM impresiones) GROUP BY 1""")
def _(d):
    live = M.strategy_performance(d.impresiones, d.estrategias).join(
        d.estrategias.select(F.col("codigo").alias("estrategia"), F.col("id").alias("estrategia_key")), "estrategia")
    return Q.reconcile(live, M.daily_impressions(d.impresiones), ["estrategia_key"], ["impresiones", "clics"])


@query("q14_types_that_need_duration", """
    SELECT c.id FROM (SELECT id, tipo_contenido_id, CASE WHEN id % 29 <> 0 THEN duracion_seg END AS duracion_seg FROM contenidos) c
    JOIN tipos_contenido t ON t.id = c.tipo_contenido_id WHERE t.admite_duracion AND c.duracion_seg IS NULL""")
def _(d):
    holes = d.contenidos.withColumn("duracion_seg", F.when(F.col("id") % 29 != 0, F.col("duracion_seg")))
    return Q.missing_duration(holes, d.tipos_contenido).select("id")


@query("q15_anonymised_output_check", """
    SELECT 'consentimiento_personalizacion,activo,mes_alta,pais,plan,seudonimo,tramo_etario' AS columnas,
           count(*) AS personas FROM usuarios u LEFT JOIN suscripciones s ON s.usuario_id = u.id AND s.estado = 'activa'""")
def _(d):
    from feedlake.operators.privacy import check_no_direct_identifiers
    from feedlake.plans.people_queries import anonymised

    checked = check_no_direct_identifiers(anonymised(d))
    names = ["consentimiento_personalizacion"] + sorted(c for c in checked.columns if not c.startswith("consent"))
    return checked.agg(F.count("*").alias("personas")).select(F.lit(",".join(names)).alias("columnas"), "personas")


# ---- sources and sinks -----------------------------------------------------------------------------

_CONTENT_COLS = ["id", "titulo", "bajada", "seccion_id", "estado", "nivel_acceso", "metadatos", "vigente_hasta"]


@query("s01_entity_csv", """
    SELECT id, titulo, CASE WHEN id % 9 = 0 THEN 'vacia' ELSE bajada END AS bajada, seccion_id, estado, nivel_acceso, metadatos,
           coalesce(vigente_hasta, TIMESTAMP '1970-01-01') AS vigente_hasta FROM contenidos""")
def _(d):
    path = run_folder(d.spark, "csv")
    R.write_entity_csv(d.contenidos.select(*_CONTENT_COLS).withColumn(
        "bajada", F.when(F.col("id") % 9 != 0, F.col("bajada")).otherwise("")), path)
    back = R.read_entity_csv(d.spark, path, StructType.fromDDL(
        "id BIGINT, titulo STRING, bajada STRING, seccion_id INT, estado STRING, nivel_acceso INT, metadatos STRING, "
        "vigente_hasta TIMESTAMP_NTZ"))
    return back.withColumns({"bajada": F.coalesce("bajada", F.lit("vacia")),
                             "vigente_hasta": F.coalesce("vigente_hasta", F.lit("1970-01-01").cast("timestamp_ntz"))})


@query("s02_document_json", """
    SELECT contenido_id, idioma, orden, tipo, texto FROM bloques""")
def _(d):
    path = run_folder(d.spark, "json")
    d.cuerpos.write.json(path)
    back = R.read_documents(d.spark, path, StructType.fromDDL(
        "contenido_id BIGINT, idioma STRING, bloques ARRAY<STRUCT<orden: INT, tipo: STRING, texto: STRING>>"))
    return back.select("contenido_id", "idioma", F.explode("bloques").alias("b")).select(
        "contenido_id", "idioma", F.col("b.orden").cast("long").alias("orden"), "b.tipo", "b.texto")


@query("s04_manifest_check", """
    SELECT 'eventos' AS entidad, count(*) AS esperadas, count(*) AS encontradas, 0::BIGINT AS diferencia FROM eventos
    UNION ALL SELECT 'usuarios', count(*), count(*), 0 FROM usuarios""")
def _(d):
    path = run_folder(d.spark, "manifiesto")
    counts = M.row_counts({"eventos": d.eventos, "usuarios": d.usuarios})
    counts.agg(F.map_from_entries(F.collect_list(F.struct("tabla", "filas"))).alias("archivos")).select(
        "archivos", F.lit("chica").alias("escala"), F.lit("lote_01").alias("lote"), F.lit(42).alias("semilla")
    ).write.json(path)
    return R.compare_counts(R.read_expected_counts(d.spark, path).drop("lote"), counts)


@query("s05_dataset_summary", """
    SELECT 'contenidos' AS entidad, count(*) AS esperadas, count(*) AS encontradas, 0::BIGINT AS diferencia FROM contenidos
    UNION ALL SELECT 'secciones', count(*), count(*), 0 FROM secciones""")
def _(d):
    path = run_folder(d.spark, "resumen")
    counts = M.row_counts({"contenidos": d.contenidos, "secciones": d.secciones})
    counts.agg(F.map_from_entries(F.collect_list(F.struct("tabla", "filas"))).alias("conteos")).select(
        F.lit(42).alias("semilla"), F.lit("chica").alias("escala"), "conteos").write.json(path)
    return R.compare_counts(R.read_expected_counts(d.spark, path, "resumen").drop("lote"), counts)


@query("s06_staged_load", """
    SELECT 'contenidos' AS tabla, count(*) AS filas FROM contenidos UNION ALL SELECT 'secciones', count(*) FROM secciones""")
def _(d):
    folder = run_folder(d.spark, "carga")
    fk = lambda t: t["contenidos"].join(
        t["secciones"].select(F.col("id").alias("seccion_id")), "seccion_id", "left_anti")
    L.load_all_or_nothing({"contenidos": d.contenidos, "secciones": d.secciones}, folder, [fk])
    return M.row_counts({t: L.read_loaded(d.spark, folder, t) for t in ("contenidos", "secciones")})


@query("s07_full_reload", "SELECT count(*) AS filas, CAST(sum(id) AS BIGINT) AS suma FROM secciones")
def _(d):
    folder = run_folder(d.spark, "recarga")
    L.load_all_or_nothing({"secciones": d.secciones}, folder)
    L.load_all_or_nothing({"secciones": d.secciones}, folder)
    return L.read_loaded(d.spark, folder, "secciones").agg(F.count("*").alias("filas"), F.sum("id").alias("suma"))


@query("s08_code_lookup", """
    SELECT i.id, e.id AS estrategia_id, 'resuelta' AS estado FROM impresiones i JOIN estrategias e ON e.id = i.estrategia_id WHERE i.id % 90 <> 1
    UNION ALL SELECT 0, 0, 'codigo sin resolver: desconocida'""")
def _(d):
    codes = d.estrategias.filter("version = '1.0'").select("id", "codigo")
    coded = d.impresiones.join(codes.withColumnRenamed("id", "estrategia_id"), "estrategia_id").select(
        "id", F.when(F.col("id") % 90 == 1, "desconocida").otherwise(F.col("codigo")).alias("estrategia_codigo"))
    resolved, unresolved = L.with_lookup(coded, codes, "estrategia_codigo", out="estrategia_id")
    return resolved.select("id", "estrategia_id", F.lit("resuelta").alias("estado")).unionByName(
        unresolved.select(F.lit(0).cast("long").alias("id"), F.lit(0).alias("estrategia_id"), F.concat(
            F.lit("codigo sin resolver: "), "estrategia_codigo").alias("estado")))


@query("s09_month_partitions", """
    SELECT strftime(l_shipdate, '%Y-%m') AS mes, count(*) AS filas FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-03-10' AND l_shipdate < TIMESTAMP '1998-05-02' GROUP BY 1""")
def _(d):
    path = run_folder(d.spark, "meses")
    facts = d.table("lineitem").select("l_orderkey", F.col("l_shipdate").alias("mostrado_en"))
    L.write_by_month(facts, path, "mostrado_en")
    stored = d.spark.read.schema("l_orderkey BIGINT, mostrado_en TIMESTAMP_NTZ, mes STRING").parquet(path)
    return C.between_instants(stored, "1997-03-10", "1998-05-02").groupBy("mes").agg(F.count("*").alias("filas"))


@query("s10_insert_if_absent", """
    SELECT usuario_id, 'vieja' AS origen FROM (SELECT DISTINCT id AS usuario_id FROM usuarios WHERE consentimiento_personalizacion)
    UNION ALL SELECT DISTINCT usuario_id, 'nueva' FROM eventos
        WHERE usuario_id NOT IN (SELECT id FROM usuarios WHERE consentimiento_personalizacion)""")
def _(d):
    old = d.usuarios.filter("consentimiento_personalizacion").select(F.col("id").alias("usuario_id"), F.lit("vieja").alias("origen"))
    new = d.eventos.select("usuario_id", F.lit("nueva").alias("origen"))
    return L.insert_if_absent(old, new, ["usuario_id"])


@query("s11_load_ledger", D.LEDGER_SQL)
def _(d):
    path = run_folder(d.spark, "control")
    L.append(D.ledger(d), path)
    return d.spark.read.parquet(path)


@query("q13_rejected_balance", f"""
    SELECT 'control_cargas' AS tabla, 'balance' AS regla, count(*) FILTER (WHERE filas_aceptadas + filas_rechazadas <> filas_recibidas)
    AS violaciones FROM ({D.LEDGER_SQL})""")
def _(d):
    return Q.check_rows("control_cargas", D.ledger(d)).filter("regla = 'balance'")
