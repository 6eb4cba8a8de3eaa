"""Row and column policies as predicates. Permissive policies of a role are ORed; none means no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.operators.catalog import publishable_filter

# Roles, tables with own-row policies, and what each role may read; None stands for all columns.
READERS = ("lector", "editor", "moderador", "api")
ROLES = ("lector", "editor", "moderador", "api", "analista", "admin")
OWN_ROW_TABLES = {"preferencias": "usuario_id", "impresiones": "usuario_id", "perfiles": "usuario_id", "usuarios": "id"}
CATALOGUE = ("contenidos", "secciones", "tipos_contenido", "etiquetas", "contenidos_etiquetas")
ANALYTIC = ("dim_fecha", "dim_contenido", "dim_usuario_anonimizado", "dim_estrategia", "fact_consumo_diario",
            "fact_impresiones_diario", "agg_popularidad", "usuarios_anonimizados")
READER_GRANTS = dict.fromkeys((*CATALOGUE, "publicables", "preferencias", "impresiones"))
GRANTS: dict[str, dict[str, list[str] | None]] = {
    "lector": READER_GRANTS,
    "editor": READER_GRANTS | dict.fromkeys(("versiones",)),
    "moderador": READER_GRANTS | dict.fromkeys(("versiones", "moderaciones")),
    "api": dict.fromkeys((*CATALOGUE, "publicables", "embeddings", "agg_popularidad", "preferencias", "usuarios", "impresiones")),
    "analista": dict.fromkeys((*ANALYTIC, "rendimiento_estrategias", "secciones", "tipos_contenido"))
    | {"estrategias": ["id", "codigo", "version", "motor", "activa"]},
    "admin": dict.fromkeys((*CATALOGUE, *ANALYTIC, "publicables", "preferencias", "impresiones", "versiones", "moderaciones", "embeddings",
                            "usuarios", "perfiles", "estrategias", "rendimiento_estrategias", "auditoria", "control_cargas")),
}


def granted_columns(role: str, table: str, columns: list[str]) -> list[str]:
    """The columns of ``table`` that ``role`` may read: none without a grant."""
    grants = GRANTS.get(role, {})
    if table not in grants:
        return []
    return [c for c in columns if grants[table] is None or c in grants[table]]


def row_predicate(table: str, role: str, user: int | None, level: int = 0, as_of=None) -> Column:
    """Predicate of the rows ``role`` may read; an unknown user (None) owns nothing."""
    who = F.lit(user).cast("long")
    allowed: list[Column] = []
    if table == "contenidos":
        if role in READERS:
            allowed.append(publishable_filter(as_of) & (F.col("nivel_acceso") <= level))
        if role == "editor":
            allowed.append(F.col("autor_id") == who)
        if role in ("moderador", "admin"):
            allowed.append(F.lit(True))
    elif table in OWN_ROW_TABLES:
        if role in READERS:
            allowed.append(F.col(OWN_ROW_TABLES[table]) == who)
        if role == "admin":
            allowed.append(F.lit(True))
    else:
        raise KeyError(table)
    return F.coalesce(reduce(lambda a, b: a | b, allowed, F.lit(False)), F.lit(False))


def apply_policy(df: DataFrame, table: str, role: str, user: int | None, level: int = 0, as_of=None) -> DataFrame:
    return df.filter(row_predicate(table, role, user, level, as_of))


def split_writes(rows: DataFrame, declared: str, owner: str = "usuario_id") -> tuple[DataFrame, DataFrame]:
    """Accepted rows carry the declared user; the rest are rejected."""
    ok = F.col(owner).eqNullSafe(F.col(declared)) & F.col(declared).isNotNull()
    return rows.filter(ok), rows.filter(~ok)


def select_visible(df: DataFrame, table: str, role: str, columns: list[str]) -> DataFrame:
    """Project the columns a role may read; asking for any other fails instead of hiding it. What is not granted is refused."""
    visible = granted_columns(role, table, df.columns)
    refused = [c for c in columns if c not in visible]
    if refused or not columns:
        raise PermissionError(f"{role} may not read {refused or table}")
    return df.select(*columns)
