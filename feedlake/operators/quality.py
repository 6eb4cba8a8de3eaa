"""Constraints as data-quality jobs: one row per rule with the number of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from feedlake.functions import expressions as E
from feedlake.operators import metrics as M
from feedlake.sources.loading import LoadError

# Row rules by table, as SQL predicates. A NULL result passes.
ROW_RULES: dict[str, dict[str, str]] = {
    "planes": {"nivel_acceso": "nivel_acceso BETWEEN 0 AND 2"},
    "usuarios": {"anio_nacimiento": "anio_nacimiento BETWEEN 1920 AND 2012"},
    "suscripciones": {
        "estado": "estado IN ('activa', 'vencida', 'cancelada')",
        "hasta_posterior": "hasta IS NULL OR hasta > desde",
    },
    "consentimientos": {"finalidad": "finalidad IN ('personalizacion', 'analitica', 'comunicaciones')"},
    "secciones": {"no_es_su_padre": "seccion_padre_id IS NULL OR seccion_padre_id <> id"},
    "contenidos": {
        "estado": "estado IN ('borrador', 'en_revision', 'publicado', 'despublicado', 'archivado')",
        "nivel_acceso": "nivel_acceso BETWEEN 0 AND 2",
        "duracion": "duracion_seg IS NULL OR duracion_seg > 0",
        "publicado_con_fecha": "estado <> 'publicado' OR fecha_publicacion IS NOT NULL",
        "vigencia_posterior": "vigente_hasta IS NULL OR fecha_publicacion IS NULL OR vigente_hasta > fecha_publicacion",
    },
    "contenidos_etiquetas": {"relevancia": "relevancia BETWEEN 0 AND 1"},
    "versiones_contenido": {"numero_version": "numero_version > 0"},
    "moderaciones": {
        "objeto_tipo": "objeto_tipo IN ('contenido', 'comentario')",
        "accion": "accion IN ('aprobado', 'rechazado', 'despublicado', 'marcado')",
        "contenido_con_id": "objeto_tipo <> 'contenido' OR contenido_id IS NOT NULL",
    },
    "preferencias_usuario": {
        "tipo": "tipo_preferencia IN ('sigue', 'no_interesa')",
        "peso": "peso BETWEEN 0 AND 1",
        "seccion_o_etiqueta": "(seccion_id IS NULL) <> (etiqueta_id IS NULL)",
    },
    "estrategias": {"motor": "motor IN ('postgresql', 'pgvector', 'duckdb', 'neo4j', 'redis', 'hibrido')"},
    "experimentos_ab": {"hasta_posterior": "hasta IS NULL OR hasta > desde"},
    "asignaciones_ab": {"variante": "variante IN ('control', 'tratamiento')"},
    "impresiones": {
        "posicion": "posicion BETWEEN 1 AND 50",
        "score": "score >= 0",
        "superficie": "superficie IN ('home', 'seccion', 'articulo', 'newsletter', 'busqueda')",
        "clic_con_fecha": "clic = FALSE OR clic_en IS NOT NULL",
        "clic_posterior": "clic_en IS NULL OR clic_en >= mostrado_en",
    },
    "ranking_items_similares": {
        "origen": "origen IN ('embedding', 'coocurrencia', 'grafo')",
        "score": "score >= 0",
        "no_es_el_mismo": "contenido_id <> contenido_similar_id",
    },
    "fact_consumo_diario": {
        "vistas": "vistas >= 0",
        "vistas_completas": "vistas_completas >= 0",
        "usuarios_unicos": "usuarios_unicos >= 0",
        "segundos_totales": "segundos_totales >= 0",
        "guardados": "guardados >= 0",
        "compartidos": "compartidos >= 0",
        "completas_hasta_vistas": "vistas_completas <= vistas",
    },
    "fact_impresiones_diario": {
        "impresiones": "impresiones >= 0",
        "clics": "clics >= 0",
        "ctr": "ctr BETWEEN 0 AND 1",
        "contenidos_distintos": "contenidos_distintos >= 0",
        "clics_hasta_impresiones": "clics <= impresiones",
    },
    "agg_popularidad": {
        "ventana": "ventana IN ('24h', '7d', '30d')",
        "score": "score >= 0",
        "vistas": "vistas >= 0",
    },
    "control_cargas": {
        "recibidas": "filas_recibidas >= 0",
        "aceptadas": "filas_aceptadas >= 0",
        "rechazadas": "filas_rechazadas >= 0",
        "estado": "estado IN ('COMPLETADO', 'FALLIDO')",
        "balance": "filas_aceptadas + filas_rechazadas = filas_recibidas",
    },
    "perfiles_usuario": {"cantidad_eventos": "cantidad_eventos > 0"},
    "auditoria_eventos": {
        "accion": "accion IN ('INSERT', 'UPDATE', 'DELETE')",
        "alta_sin_anterior": "accion <> 'INSERT' OR datos_anteriores IS NULL",
        "baja_sin_nuevo": "accion <> 'DELETE' OR datos_nuevos IS NULL",
    },
    "accesos_sensibles": {"filas_afectadas": "filas_afectadas >= 0"},
}

# Unique keys by table.
KEYS: dict[str, list[list[str]]] = {
    "usuarios": [["id"], ["email_hash"], ["seudonimo"]],
    "usuarios_roles": [["usuario_id", "rol_id"]],
    "suscripciones": [["id"]],
    "secciones": [["id"], ["slug"]],
    "contenidos": [["id"]],
    "contenidos_etiquetas": [["contenido_id", "etiqueta_id"]],
    "versiones_contenido": [["id"], ["contenido_id", "numero_version"]],
    "estrategias": [["id"], ["codigo", "version"]],
    "asignaciones_ab": [["experimento_id", "usuario_id"]],
    "impresiones": [["id", "mostrado_en"]],
    "ranking_items_similares": [["contenido_id", "contenido_similar_id", "origen"]],
    "embeddings_contenido": [["contenido_id"]],
    "perfiles_usuario": [["usuario_id"]],
    "dim_fecha": [["fecha_key"]],
    "fact_consumo_diario": [["fecha_key", "contenido_key", "dispositivo"]],
    "fact_impresiones_diario": [["fecha_key", "estrategia_key", "superficie"]],
    "agg_popularidad": [["contenido_id", "ventana"]],
    "control_cargas": [["lote_id", "entidad"]],
}



def _rows(counts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, counts)


def check_rows(table: str, df: DataFrame) -> DataFrame:
    """All row rules of a table in one pass: (tabla, regla, violaciones)."""
    rules = ROW_RULES[table]
    row = df.agg(*[F.count_if(~F.coalesce(F.expr(p), F.lit(True))).alias(r) for r, p in rules.items()])
    pairs = F.array(*[F.struct(F.lit(r).alias("regla"), F.col(r).alias("violaciones")) for r in rules])
    return row.select(F.explode(pairs).alias("p")).select(F.lit(table).alias("tabla"), "p.regla", "p.violaciones")


def check_key(table: str, df: DataFrame, key: list[str], name: str | None = None) -> DataFrame:
    """Number of key values that occur more than once; rows with a NULL in the key do not collide."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    return M.duplicates(df.filter(present), key).agg(F.count("*").alias("violaciones")).select(
        F.lit(table).alias("tabla"), F.lit(name or "unica_" + "_".join(key)).alias("regla"), "violaciones")


def check_keys(tables: list[tuple[str, DataFrame, list[list[str]]]]) -> DataFrame:
    """Key values that occur more than once, for every declared key: (tabla, regla, violaciones), one row a key.

    Each table is read once for all its keys and all values go through one exchange, combined before it. A value is its
    column as text, or the list of its columns as text, so columns of any type compare exactly; a NULL in the key never collides. Keys of empty
    tables count 0.
    """
    spark = tables[0][1].sparkSession
    names, values = [], []
    for table, df, keys in tables:
        cells = []
        for key in keys:
            rule = "unica_" + "_".join(key)
            present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
            text = [F.col(c).cast("string") for c in key]
            cells.append(F.struct(F.lit(len(names)).alias("r"), F.when(present, text[0] if len(key) == 1 else F.to_json(F.array(*text))).alias("valor")))
            names.append((len(names), table, rule))
        values.append(df.select(F.explode(F.array(*cells)).alias("k")).select("k.*").filter("valor IS NOT NULL"))
    # Tasks hold a map of their values: a rule is a number in it, as its names would be most of each entry.
    counted = _rows(values).groupBy("r", "valor").agg(F.count("*").alias("n")).groupBy("r").agg(F.count_if(F.col("n") > 1).alias("v"))
    rules = spark.createDataFrame(names, "r int, tabla string, regla string")
    return _every_rule(rules.select("tabla", "regla"), counted.join(rules, "r"))


def _every_rule(names: DataFrame, counted: DataFrame) -> DataFrame:
    """Rules without a counted row stay, with 0."""
    return names.withColumn("v", F.lit(0).cast("long")).unionByName(counted.select("tabla", "regla", "v")).groupBy(
        "tabla", "regla").agg(F.max("v").alias("violaciones"))


def check_references(referring: list[tuple[str, DataFrame, dict[str, str]]],
                     targets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows whose reference does not exist, for all references at once: (tabla, regla, violaciones).

    ``referring`` lists (table, frame, {column: name of a target}), ``targets`` the frame and key of each name. The values
    of all references and of all targets form one relation; one aggregate by (target, value) notes whether the target has
    the value and how many rows of each reference use it. Every table is read once, nothing is joined, and a value that a
    third of all rows use is combined before the exchange. NULL references are no violation.
    """
    spark = next(iter(targets.values()))[0].sparkSession
    used = [df.schema[c].dataType for _, df, refs in referring for c in refs] + [df.schema[k].dataType for df, k in targets.values()]
    kind = "bigint" if all(isinstance(t, IntegralType) for t in used) else "string"
    slots: dict[str, list[tuple[str, str]]] = {name: [] for name in targets}
    parts = []
    for table, df, refs in referring:
        cells = []
        for column, target in refs.items():
            cells.append(F.struct(F.lit(target).alias("destino"), F.lit(len(slots[target])).alias("ranura"),
                                  F.col(column).cast(kind).alias("valor")))
            slots[target].append((table, f"fk_{column}"))
        parts.append(df.select(F.explode(F.array(*cells)).alias("r")).select("r.*").filter("valor IS NOT NULL"))
    for name, (df, key) in targets.items():
        parts.append(df.select(F.lit(name).alias("destino"), F.lit(-1).alias("ranura"), F.col(key).cast(kind).alias("valor")))
    width = range(max(len(s) for s in slots.values()))
    by_value = _rows(parts).groupBy("destino", "valor").agg(
        F.bool_or(F.col("ranura") == -1).alias("existe"), *[F.count_if(F.col("ranura") == i).alias(f"n{i}") for i in width])
    lost = by_value.filter("NOT existe").groupBy("destino").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in width])
    counts = F.array(*[F.struct(F.lit(i).alias("ranura"), F.col(f"n{i}").alias("v")) for i in width])
    per_slot = lost.select("destino", F.explode(counts).alias("c")).select("destino", "c.*")
    names = spark.createDataFrame([(t, i, *rule) for t, rules in slots.items() for i, rule in enumerate(rules)],
                                  "destino string, ranura int, tabla string, regla string")
    return names.join(per_slot, ["destino", "ranura"], "left").select(
        "tabla", "regla", F.coalesce("v", F.lit(0).cast("long")).alias("violaciones"))


def check_conditional_key(table: str, df: DataFrame, key: list[str], condition, name: str) -> DataFrame:
    return check_key(table, df.filter(condition), key, name)


def check_foreign_key(table: str, df: DataFrame, column: str, parent: DataFrame, parent_key: str = "id",
                      name: str | None = None) -> DataFrame:
    """Rows whose reference does not exist. References are counted per value before the join."""
    refs = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__ref")).agg(F.count("*").alias("n"))
    missing = refs.join(parent.select(F.col(parent_key).alias("__ref")), "__ref", "left_anti")
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violaciones")).select(
        F.lit(table).alias("tabla"), F.lit(name or f"fk_{column}").alias("regla"), "violaciones")


def count_rule(table: str, name: str, violating: DataFrame) -> DataFrame:
    return violating.agg(F.count("*").alias("violaciones")).select(
        F.lit(table).alias("tabla"), F.lit(name).alias("regla"), "violaciones")


def check_schema(name: str, df: DataFrame, contract) -> DataFrame:
    """Declared against actual columns: missing, unexpected and differently typed ones, one row each."""
    want = {f.name: f.dataType.simpleString() for f in contract.fields}
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [(name, c, want.get(c, "-"), have.get(c, "-"), want.get(c) == have.get(c)) for c in sorted(want | have)]
    return df.sparkSession.createDataFrame(
        rows, "tabla string, columna string, declarado string, encontrado string, cumple boolean")


def split_required(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): quarantined rows lack a required field and name the first one missing."""
    reason = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"falta {c}")) for c in required])
    marked = df.withColumn("motivo_rechazo", reason)
    return (marked.filter(F.col("motivo_rechazo").isNull()).drop("motivo_rechazo"),
            marked.filter(F.col("motivo_rechazo").isNotNull()))


def published_without_date(contents: DataFrame) -> DataFrame:
    return contents.filter((F.col("estado") == "publicado") & F.col("fecha_publicacion").isNull())


def active_but_expired(subscriptions: DataFrame, as_of) -> DataFrame:
    return subscriptions.filter((F.col("estado") == "activa") & (F.col("hasta") <= E.literal_ts(as_of)))


def clicked_without_time(impressions: DataFrame) -> DataFrame:
    return impressions.filter(F.col("clic") & F.col("clic_en").isNull())


def outside_declared_months(impressions: DataFrame, months: list[str]) -> DataFrame:
    """Rows of the catch-all partition: months nobody declared."""
    return impressions.filter(~E.month_text(F.col("mostrado_en")).isin(months))


def profiles_without_consent(profiles: DataFrame, users: DataFrame) -> DataFrame:
    refusing = users.filter(~F.col("consentimiento_personalizacion")).select(F.col("id").alias("usuario_id"))
    return profiles.join(refusing, "usuario_id", "left_semi")


def missing_duration(contents: DataFrame, types: DataFrame) -> DataFrame:
    timed = types.filter("admite_duracion").select(F.col("id").alias("tipo_contenido_id"))
    return contents.filter(F.col("duracion_seg").isNull()).join(timed, "tipo_contenido_id", "left_semi")


def integrity_report(frames: dict[str, DataFrame], months: list[str], as_of) -> DataFrame:
    """The seven controls run after a load, one row each."""
    from feedlake.operators.catalog import outside_tree

    active = F.col("estado") == "activa"
    return _rows([
        count_rule("contenidos", "publicados_sin_fecha", published_without_date(frames["contenidos"])),
        check_conditional_key("suscripciones", frames["suscripciones"], ["usuario_id"], active, "varias_activas"),
        count_rule("suscripciones", "activas_vencidas", active_but_expired(frames["suscripciones"], as_of)),
        count_rule("impresiones", "particion_default", outside_declared_months(frames["impresiones"], months)),
        count_rule("impresiones", "clics_sin_fecha", clicked_without_time(frames["impresiones"])),
        count_rule("contenidos", "seccion_fuera_del_arbol", outside_tree(frames["contenidos"], frames["arbol"])),
        count_rule("perfiles", "perfiles_sin_consentimiento",
                   profiles_without_consent(frames["perfiles"], frames["usuarios"])),
    ])


def require_clean(report: DataFrame) -> DataFrame:
    """Fail once, naming every broken rule (the report has one row per rule)."""
    broken = report.filter("violaciones > 0").collect()
    if broken:
        raise LoadError("; ".join(f"{r.tabla}.{r.regla}: {r.violaciones}" for r in broken))
    return report


def unknown_codes(name: str, facts: DataFrame, code: str, listed: DataFrame) -> DataFrame:
    """Codes that facts use, and the facts whose code is not listed: (tabla, usados, desconocidos). Counted by code first."""
    used = facts.groupBy(F.col(code).alias("_code")).agg(F.count("*").alias("n"))
    seen = used.join(listed.select(F.col("id").alias("_id")), F.col("_code") == F.col("_id"), "left")
    return seen.agg(F.count("*").alias("usados"), F.coalesce(F.sum(F.when(F.col("_id").isNull(), F.col("n"))), F.lit(0)).alias("desconocidos")
                    ).select(F.lit(name).alias("tabla"), "usados", "desconocidos")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Totals of two layers side by side with their difference; groups present on one side only stay visible."""
    a = left.groupBy(*keys).agg(*[F.sum(m).alias(f"{m}_a") for m in measures])
    b = right.groupBy(*keys).agg(*[F.sum(m).alias(f"{m}_b") for m in measures])
    out = a.join(b, keys, "full_outer")
    cols = []
    for m in measures:
        x, y = F.coalesce(f"{m}_a", F.lit(0)), F.coalesce(f"{m}_b", F.lit(0))
        cols += [x.alias(f"{m}_a"), y.alias(f"{m}_b"), (x - y).alias(f"{m}_dif")]
    return out.select(*keys, *cols)


def require_equal(reconciled: DataFrame, measures: list[str]) -> None:
    from feedlake.sources.loading import require_empty

    bad = reduce(lambda p, q: p | q, [F.col(f"{m}_dif") != 0 for m in measures])
    require_empty(reconciled.filter(bad), "layer totals differ")
