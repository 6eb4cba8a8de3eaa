"""Queries: privacy, row and column policies, audit."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.functions import expressions as E
from feedlake.operators import audit as A
from feedlake.operators import policy as P
from feedlake.operators import privacy as N
from feedlake.plans.registry import query
from feedlake.session import run_folder
from feedlake.sources.domain import AS_OF

# Test secrets only: in production they are parameters of the job.
SALT = "0123456789abcdef" * 4
HASH_KEY = "clave-de-busqueda"
PASSPHRASE = "frase-de-prueba"


def _hmac_sql(message: str, key: str) -> str:
    raw = key.encode().ljust(64, b"\0")
    ipad = bytes(b ^ 0x36 for b in raw).hex()
    opad = bytes(b ^ 0x5C for b in raw).hex()
    return f"sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode({message}))))"


def protected(d) -> DataFrame:
    return N.protect_users(d.usuarios, HASH_KEY, PASSPHRASE, SALT)


PSEUDO = f"'U-' || substring({_hmac_sql('CAST(id AS VARCHAR)', SALT)}, 1, 12)"
AGE = """CASE WHEN anio_nacimiento IS NULL THEN 'sin_dato' WHEN 2026 - anio_nacimiento < 18 THEN 'menor_de_18'
    WHEN 2026 - anio_nacimiento <= 25 THEN '18-25' WHEN 2026 - anio_nacimiento <= 35 THEN '26-35'
    WHEN 2026 - anio_nacimiento <= 45 THEN '36-45' WHEN 2026 - anio_nacimiento <= 55 THEN '46-55'
    WHEN 2026 - anio_nacimiento <= 65 THEN '56-65' ELSE '66+' END"""
ANON_SQL = f"""
    SELECT {PSEUDO.replace('CAST(id', 'CAST(u.id')} AS seudonimo, u.pais, {AGE} AS tramo_etario, coalesce(p.codigo, 'sin_plan') AS plan,
           u.consentimiento_personalizacion, u.activo, strftime(u.fecha_alta, '%Y-%m-01') AS mes_alta
    FROM usuarios u LEFT JOIN suscripciones s ON s.usuario_id = u.id AND s.estado = 'activa'
    LEFT JOIN planes p ON p.id = s.plan_id"""


def anonymised(d) -> DataFrame:
    return N.anonymised_users(protected(d), d.suscripciones, d.planes)


@query("e09_keyed_hash", f"SELECT id, {_hmac_sql('email', HASH_KEY)} AS email_hash FROM usuarios")
def _(d):
    return d.usuarios.select("id", E.hmac_sha256(F.col("email"), HASH_KEY).alias("email_hash"))


@query("e10_symmetric_encryption", "SELECT id, email, TRUE AS cifrado_distinto FROM usuarios")
def _(d):
    box = d.usuarios.select("id", E.encrypt_text(F.col("email"), PASSPHRASE).alias("c"), F.col("email").alias("claro"))
    return box.select("id", E.decrypt_text(F.col("c"), PASSPHRASE).alias("email"),
                      (F.col("c") != F.encode("claro", "UTF-8")).alias("cifrado_distinto"))


@query("e11_age_band", f"SELECT id, {AGE} AS tramo_etario FROM usuarios")
def _(d):
    return d.usuarios.select("id", E.age_band(F.col("anio_nacimiento")).alias("tramo_etario"))


@query("n01_protect_users", f"""
    SELECT id, {_hmac_sql('email', HASH_KEY)} AS email_hash, {PSEUDO} AS seudonimo, TRUE AS recuperable, alias FROM usuarios""")
def _(d):
    clear = d.usuarios.select("id", "email")
    return protected(d).join(clear, "id").select(
        "id", "email_hash", "seudonimo",
        (E.decrypt_text(F.col("email_cifrado"), PASSPHRASE) == F.col("email")).alias("recuperable"), "alias")


@query("n02_pseudonym_backfill", f"""
    SELECT id, CASE WHEN id % 3 = 0 THEN 'U-previo' ELSE {PSEUDO} END AS seudonimo FROM usuarios""")
def _(d):
    some = d.usuarios.withColumn("seudonimo", F.when(F.col("id") % 3 == 0, "U-previo"))
    return N.fill_pseudonyms(some, SALT).select("id", "seudonimo")


@query("n03_anonymised_users", ANON_SQL)
def _(d):
    return anonymised(d).withColumn("mes_alta", F.date_format("mes_alta", "yyyy-MM-dd"))


@query("n05_k_anonymity", f"""
    SELECT pais, tramo_etario, plan, count(*) AS personas FROM ({ANON_SQL}) GROUP BY 1, 2, 3 HAVING count(*) >= 5""")
def _(d):
    return N.k_anonymous_counts(anonymised(d), ["pais", "tramo_etario", "plan"], 5)


_PUBLIC = f"""(estado = 'publicado' AND fecha_publicacion <= TIMESTAMP '{AS_OF}'
    AND (vigente_hasta IS NULL OR vigente_hasta > TIMESTAMP '{AS_OF}') AND nivel_acceso <= 1)"""


@query("n06_content_row_policy", f"""
    SELECT 'lector' AS rol, id FROM contenidos WHERE {_PUBLIC} UNION ALL SELECT 'api', id FROM contenidos WHERE {_PUBLIC}
    UNION ALL SELECT 'editor', id FROM contenidos WHERE {_PUBLIC} OR autor_id = 7
    UNION ALL SELECT 'moderador', id FROM contenidos UNION ALL SELECT 'admin', id FROM contenidos""")
def _(d):
    parts = [P.apply_policy(d.contenidos, "contenidos", role, 7, 1, AS_OF).select(F.lit(role).alias("rol"), "id")
             for role in P.ROLES]
    return reduce(DataFrame.unionByName, parts)


@query("n07_own_row_policy", """
    SELECT r.rol, count(*) AS filas FROM impresiones i JOIN (VALUES ('lector'), ('editor'), ('moderador'), ('api'), ('admin'))
    r(rol) ON i.usuario_id = 7 OR r.rol = 'admin' GROUP BY 1""")
def _(d):
    parts = [P.apply_policy(d.impresiones, "impresiones", role, 7).groupBy(F.lit(role).alias("rol")).agg(
        F.count("*").alias("filas")) for role in P.ROLES]
    return reduce(DataFrame.unionByName, parts)


#: Tables that people write to: row number, owner, and the rows whose declared writer is somebody else.
_WRITTEN = {
    "impresiones": (lambda d: d.impresiones, "id", "usuario_id", "id % 13 = 0"),
    "preferencias": (lambda d: d.preferencias, "usuario_id", "usuario_id", "usuario_id % 11 = 0"),
    "consentimientos": (lambda d: d.consentimientos, "id", "usuario_id", "id % 17 = 0"),
    "contenidos": (lambda d: d.contenidos, "id", "autor_id", "id % 19 = 0"),
}


@query("n08_write_check", " UNION ALL ".join(
    f"SELECT '{table}' AS tabla, {row} AS id, CASE WHEN {other} THEN 'rechazada' ELSE 'aceptada' END AS destino FROM {table}"
    for table, (_, row, _, other) in _WRITTEN.items()))
def _(d):
    parts = []
    for table, (frame, row, owner, other) in _WRITTEN.items():
        rows = frame(d).withColumn("declarado", F.when(F.expr(other), F.col(owner) + 1).otherwise(F.col(owner)))
        for side, name in zip(P.split_writes(rows, "declarado", owner), ("aceptada", "rechazada"), strict=True):
            parts.append(side.select(F.lit(table).alias("tabla"), F.col(row).alias("id"), F.lit(name).alias("destino")))
    return reduce(DataFrame.unionByName, parts)


@query("n09_column_visibility", """
    WITH legibles AS (
        SELECT r.rol, 'impresiones' AS tabla, count(*) AS filas, count(usuario_id) AS usuario_id, count(contenido_id) AS contenido_id
        FROM impresiones, (VALUES ('lector'), ('editor'), ('moderador'), ('api'), ('admin')) r(rol) GROUP BY 1
        UNION ALL SELECT r.rol, 'preferencias', count(*), count(usuario_id), NULL
        FROM preferencias, (VALUES ('lector'), ('editor'), ('moderador'), ('api'), ('admin')) r(rol) GROUP BY 1
        UNION ALL SELECT r.rol, 'versiones', count(*), NULL, count(contenido_id)
        FROM versiones, (VALUES ('editor'), ('moderador'), ('admin')) r(rol) GROUP BY 1
        UNION ALL SELECT r.rol, 'moderaciones', count(*), NULL, count(contenido_id)
        FROM moderaciones, (VALUES ('moderador'), ('admin')) r(rol) GROUP BY 1)
    SELECT rol, tabla, filas, usuario_id, contenido_id FROM legibles""")
def _(d):
    """What every role can read of four tables: values by column, null for a column that is refused or absent."""
    parts = []
    for table in ("impresiones", "preferencias", "versiones", "moderaciones"):
        df = getattr(d, table)
        for role in P.ROLES:
            visible = P.granted_columns(role, table, df.columns)
            if visible:
                read = P.select_visible(df, table, role, visible)
                count = lambda c, names=tuple(visible): F.count(c) if c in names else F.lit(None).cast("long")
                parts.append(read.agg(F.count("*").alias("filas"), count("usuario_id").alias("usuario_id"),
                                      count("contenido_id").alias("contenido_id")).select(
                    F.lit(role).alias("rol"), F.lit(table).alias("tabla"), "filas", "usuario_id", "contenido_id"))
    return reduce(DataFrame.unionByName, parts)


_IMAGE = "CAST(json_object('id', {0}.id, 'nombre', {0}.nombre, 'segmento', {0}.segmento) AS VARCHAR)"
LOG_SQL = f"""
    SELECT CASE WHEN b.id IS NULL THEN 'INSERT' WHEN a.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS accion,
           CAST(coalesce(a.id, b.id) AS VARCHAR) AS registro_id,
           coalesce(CASE WHEN b.id IS NOT NULL THEN {_IMAGE.format('b')} END, '') AS datos_anteriores,
           coalesce(CASE WHEN a.id IS NOT NULL THEN {_IMAGE.format('a')} END, '') AS datos_nuevos
    FROM foto_antes b FULL OUTER JOIN foto_despues a ON a.id = b.id
    WHERE a.id IS NULL OR b.id IS NULL OR a.nombre <> b.nombre OR a.segmento <> b.segmento"""


def _log(d, at=AS_OF):
    return A.change_log(d.foto_antes, d.foto_despues, "personas", "usuarios", at, user_app=7)


@query("a01_change_log", LOG_SQL)
def _(d):
    return _log(d).select("accion", "registro_id", F.coalesce("datos_anteriores", F.lit("")).alias("datos_anteriores"),
                          F.coalesce("datos_nuevos", F.lit("")).alias("datos_nuevos"))


@query("a02_append_only_log", f"SELECT accion, CAST(2 * count(*) AS BIGINT) AS filas FROM ({LOG_SQL}) GROUP BY 1")
def _(d):
    path = run_folder(d.spark, "registro")
    A.append_log(_log(d), path)
    A.append_log(_log(d, "2024-02-01 00:00:00"), path)
    return d.spark.read.parquet(path).groupBy("accion").agg(F.count("*").alias("filas"))


@query("a03_sensitive_access", """
    SELECT TIMESTAMP '2024-01-31' AS ocurrido_en, 'analista_1' AS usuario_bd, 7::BIGINT AS usuario_app,
           'usuarios.email_cifrado' AS recurso, 'reclamo' AS motivo, count(*) AS filas_afectadas FROM usuarios""")
def _(d):
    read = protected(d).select(E.decrypt_text(F.col("email_cifrado"), PASSPHRASE).alias("email"))
    return N.sensitive_access("usuarios.email_cifrado", "reclamo", read, "analista_1", 7, AS_OF)


@query("a04_log_by_table", f"SELECT accion, registro_id FROM ({LOG_SQL})")
def _(d):
    return A.log_of_table(_log(d), "usuarios", "2024-01-30", "2024-02-02").select("accion", "registro_id")


@query("a04_log_by_user", f"SELECT accion, registro_id FROM ({LOG_SQL})")
def _(d):
    return A.log_of_user(_log(d), 7).select("accion", "registro_id")


def _full_log(d):
    empty = d.foto_antes.filter(F.lit(False))
    first = A.change_log(empty, d.foto_antes, "personas", "usuarios", "2024-01-01 00:00:00")
    return first.unionByName(_log(d))


@query("a05_state_before_change", f"""
    SELECT CAST(id AS VARCHAR) AS registro_id, {_IMAGE.format('f')} AS datos FROM foto_antes f""")
def _(d):
    return A.state_at(_full_log(d), "usuarios", "2024-01-15 00:00:00")


@query("a05_state_after_change", f"""
    SELECT CAST(id AS VARCHAR) AS registro_id, {_IMAGE.format('f')} AS datos FROM foto_despues f""")
def _(d):
    return A.state_at(_full_log(d), "usuarios", "2024-02-01 00:00:00")
