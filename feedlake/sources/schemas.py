"""Fixed schemas. Nothing is inferred: every reader takes one of these."""

from __future__ import annotations

from pyspark.sql.types import StructType

# File layouts of the entity, document and lot files.
FILES: dict[str, str] = {
    "usuarios": "id BIGINT, email STRING, alias STRING, pais STRING, anio_nacimiento INT, "
                "consentimiento_personalizacion BOOLEAN, activo BOOLEAN, fecha_alta TIMESTAMP",
    "roles": "id INT, codigo STRING, nombre STRING, descripcion STRING",
    "usuarios_roles": "usuario_id BIGINT, rol_id INT, otorgado_en TIMESTAMP, otorgado_por BIGINT",
    "suscripciones": "id BIGINT, usuario_id BIGINT, plan_codigo STRING, desde TIMESTAMP, hasta TIMESTAMP, estado STRING",
    "consentimientos": "usuario_id BIGINT, finalidad STRING, otorgado BOOLEAN, registrado_en TIMESTAMP",
    "secciones": "id INT, slug STRING, nombre STRING, seccion_padre_id INT, activa BOOLEAN",
    "etiquetas": "id INT, slug STRING, nombre STRING",
    "contenidos": "id BIGINT, titulo STRING, bajada STRING, tipo_contenido_codigo STRING, seccion_id INT, autor_id BIGINT, "
                  "estado STRING, nivel_acceso INT, idioma STRING, fecha_publicacion TIMESTAMP, vigente_hasta TIMESTAMP, "
                  "duracion_seg INT, cuerpo_ref STRING, metadatos STRING, creado_en TIMESTAMP, actualizado_en TIMESTAMP",
    "contenidos_etiquetas": "contenido_id BIGINT, etiqueta_id INT, relevancia DECIMAL(4,3)",
    "versiones_contenido": "id BIGINT, contenido_id BIGINT, numero_version INT, editor_id BIGINT, cambios STRING, "
                           "comentario STRING, creado_en TIMESTAMP",
    "moderaciones": "id BIGINT, objeto_tipo STRING, objeto_id STRING, contenido_id BIGINT, moderador_id BIGINT, "
                    "accion STRING, motivo STRING, creado_en TIMESTAMP",
    "preferencias_usuario": "id BIGINT, usuario_id BIGINT, seccion_id INT, etiqueta_id INT, tipo_preferencia STRING, "
                            "peso DECIMAL(4,3), actualizado_en TIMESTAMP",
    "asignaciones_ab": "experimento_codigo STRING, usuario_id BIGINT, variante STRING, asignado_en TIMESTAMP",
    "impresiones": "usuario_id BIGINT, contenido_id BIGINT, estrategia_codigo STRING, posicion SMALLINT, "
                   "score DECIMAL(9,6), variante_ab STRING, superficie STRING, mostrado_en TIMESTAMP, clic BOOLEAN, "
                   "clic_en TIMESTAMP",
    "eventos_interaccion": "evento_id STRING, usuario_id BIGINT, sesion_id STRING, contenido_id BIGINT, tipo_evento STRING, "
                           "ocurrido_en TIMESTAMP, "
                           "contexto STRUCT<dispositivo: STRING, canal: STRING, pais: STRING, superficie: STRING>, "
                           "metricas STRUCT<segundos_visibles: INT, porcentaje_scroll: DOUBLE, "
                           "segundos_reproducidos: INT, porcentaje_reproducido: DOUBLE>, "
                           "origen_recomendacion STRUCT<estrategia: STRING, posicion: INT, variante_ab: STRING>",
    "cuerpos_contenido": "_id STRING, contenido_id BIGINT, formato STRING, idioma STRING, palabras INT, "
                         "bloques ARRAY<STRUCT<orden: INT, tipo: STRING, texto: STRING, autor: STRING, cargo: STRING, "
                         "url: STRING, epigrafe: STRING, credito: STRING>>, "
                         "transcripcion ARRAY<STRUCT<desde_seg: INT, texto: STRING>>, "
                         "fotos ARRAY<STRUCT<orden: INT, url: STRING>>",
    "comentarios": "_id STRING, contenido_id BIGINT, usuario_id BIGINT, texto STRING, creado_en TIMESTAMP, "
                   "estado_moderacion STRING, "
                   "respuestas ARRAY<STRUCT<orden: INT, usuario_id: BIGINT, texto: STRING, creado_en: TIMESTAMP>>",
    "busquedas": "_id STRING, usuario_id BIGINT, sesion_id STRING, texto STRING, "
                 "filtros STRUCT<seccion: STRING, tipo: STRING>, resultados ARRAY<BIGINT>, clics ARRAY<BIGINT>, "
                 "ocurrido_en TIMESTAMP",
    "telemetria_reproduccion": "ocurrido_en TIMESTAMP, "
                               "medicion STRUCT<segundo_reproduccion: INT, buffer_ms: INT, calidad: STRING>, "
                               "origen STRUCT<contenido_id: BIGINT, usuario_id: BIGINT, dispositivo: STRING>",
    "bronze_eventos": "evento_id STRING, usuario_seudonimo STRING, sesion_id STRING, contenido_id BIGINT, "
                      "tipo_evento STRING, ocurrido_en TIMESTAMP_NTZ, dispositivo STRING, canal STRING, pais STRING, "
                      "superficie STRING, segundos_visibles INT, porcentaje_scroll DOUBLE, segundos_reproducidos INT, "
                      "porcentaje_reproducido DOUBLE, estrategia_origen STRING, posicion_origen INT, variante_ab STRING",
    "manifiesto": "archivos MAP<STRING, BIGINT>, escala STRING, lote STRING, semilla INT",
    "resumen": "semilla INT, escala STRING, fecha_inicio TIMESTAMP, fecha_corte TIMESTAMP, conteos MAP<STRING, BIGINT>",
}

# Columns of the analytical (gold) tables and the control log.
GOLD: dict[str, str] = {
    "dim_fecha": "fecha_key INT, fecha DATE, anio INT, mes INT, dia INT, trimestre INT, dia_semana INT, es_fin_semana BOOLEAN",
    "dim_contenido": "contenido_key BIGINT, contenido_id BIGINT, titulo STRING, tipo_contenido STRING, seccion STRING, "
                     "seccion_raiz STRING, nivel_acceso INT, estado STRING, fecha_publicacion DATE",
    "dim_usuario_anonimizado": "usuario_key BIGINT, seudonimo STRING, pais STRING, tramo_etario STRING, plan STRING, "
                               "mes_alta INT",
    "dim_estrategia": "estrategia_key INT, codigo STRING, version STRING, motor STRING",
    "fact_consumo_diario": "fecha_key INT, contenido_key BIGINT, dispositivo STRING, vistas BIGINT, vistas_completas BIGINT, "
                           "usuarios_unicos BIGINT, segundos_totales BIGINT, guardados BIGINT, compartidos BIGINT",
    "fact_impresiones_diario": "fecha_key INT, estrategia_key INT, superficie STRING, impresiones BIGINT, clics BIGINT, "
                               "contenidos_distintos BIGINT, ctr DOUBLE",
    "agg_popularidad": "contenido_id BIGINT, ventana STRING, seccion STRING, score DOUBLE, vistas BIGINT",
    "control_cargas": "lote_id STRING, entidad STRING, filas_recibidas BIGINT, filas_aceptadas BIGINT, "
                      "filas_rechazadas BIGINT, estado STRING",
}


def file_schema(name: str) -> StructType:
    return StructType.fromDDL(FILES[name])


def gold_schema(name: str) -> StructType:
    return StructType.fromDDL(GOLD[name])
