"""Loading: staged publication, full reload, code lookups, month partitions, insert-if-absent, ledger."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions import expressions as E


class LoadError(RuntimeError):
    """A check failed; nothing was published."""


def require_empty(df: DataFrame, message: str) -> None:
    """Raise with up to five offending rows if the frame has any row."""
    rows = df.limit(5).collect()
    if rows:
        raise LoadError(f"{message}: {[r.asDict() for r in rows]}")


# ---- versions and pointers ------------------------------------------------------------------------

def _point_to(spark: SparkSession, folder: str, version: str) -> None:
    """Add a row to the list of versions. The list only grows, so a reader finds the version before or the new one, and a
    failure at any time leaves what was published."""
    spark.createDataFrame([(time.time_ns(), version)], "publicada long, version string").coalesce(1).write.mode("append").parquet(
        f"{folder}/versiones")


def current_version(spark: SparkSession, folder: str) -> str:
    listed = spark.read.schema("publicada long, version string").parquet(f"{folder}/versiones")
    return listed.orderBy(F.desc("publicada"), F.desc("version")).first()["version"]


def publish_version(df: DataFrame, folder: str, check: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Write a new version beside the old one, check what was written, then move the pointer."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    target = f"{folder}/{version}"
    df.write.mode("errorifexists").parquet(target)
    written = spark.read.schema(df.schema).parquet(target)
    if check is not None:
        require_empty(check(written), "check failed")
    _point_to(spark, folder, version)
    return written


def load_all_or_nothing(tables: dict[str, DataFrame], folder: str,
                        checks: list[Callable[[dict[str, DataFrame]], DataFrame]] = ()) -> dict[str, DataFrame]:
    """Stage every table, run all checks on the staged data, publish them together or not at all.

    A full reload is the same call again: the pointer moves to the new version, order of tables is irrelevant.
    """
    if not tables:
        raise LoadError("nothing to load")
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    staged = {}
    for name, df in tables.items():
        target = f"{folder}/{version}/{name}"
        df.write.mode("errorifexists").parquet(target)
        staged[name] = spark.read.schema(df.schema).parquet(target)
    for check in checks:
        require_empty(check(staged), "load rejected")
    _point_to(spark, folder, version)
    return staged


def read_loaded(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{current_version(spark, folder)}/{table}")


# ---- lookups --------------------------------------------------------------------------------------

def with_lookup(df: DataFrame, dim: DataFrame, code: str, dim_code: str = "codigo", dim_id: str = "id",
                out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Replace a code by its id. Returns (resolved rows, distinct codes without a match)."""
    d = dim.select(F.col(dim_code).alias(code), F.col(dim_id).alias(out or f"{code}_id"))
    resolved = df.join(d, code).drop(code)
    unresolved = df.select(code).distinct().join(d, code, "left_anti")
    return resolved, unresolved


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows unchanged plus the new rows whose key is not there yet; of several with one key the one with the
    smallest values, column by column."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else new.distinct()
    return existing.unionByName(one.join(existing.select(*keys), keys, "left_anti"))


# ---- month partitions ------------------------------------------------------------------------------

def write_by_month(df: DataFrame, path: str, ts: str, mode: str = "overwrite") -> None:
    """One directory per month, rows ordered by time inside each file so that row groups can be skipped.

    The rebalance hint lets Spark split a month that holds most of the rows and merge the small ones.
    """
    out = df.withColumn("mes", E.month_text(F.col(ts)))
    out.hint("rebalance", "mes").sortWithinPartitions("mes", ts).write.mode(mode).partitionBy("mes").parquet(path)


def months_to_keep(df: DataFrame, as_of: str, months: int) -> DataFrame:
    """Drop whole months older than ``months`` before ``as_of``: a filter on the partition column alone."""
    low = F.date_format(F.add_months(F.lit(as_of).cast("date"), -months), "yyyy-MM")
    return df.filter(F.col("mes") >= low)


# ---- ledger ---------------------------------------------------------------------------------------

def ledger(batch_id: str, received: dict[str, DataFrame], accepted: dict[str, DataFrame]) -> DataFrame:
    """One row per entity: received, accepted, rejected and state."""
    from feedlake.operators.metrics import row_counts

    r = row_counts(received).withColumnRenamed("filas", "filas_recibidas")
    a = row_counts(accepted).withColumnRenamed("filas", "filas_aceptadas")
    return r.join(a, "tabla", "left").select(
        F.lit(batch_id).alias("lote_id"), F.col("tabla").alias("entidad"), "filas_recibidas",
        F.coalesce("filas_aceptadas", F.lit(0)).alias("filas_aceptadas"),
        (F.col("filas_recibidas") - F.coalesce("filas_aceptadas", F.lit(0))).alias("filas_rechazadas"),
        F.when(F.col("filas_aceptadas").isNotNull(), "COMPLETADO").otherwise("FALLIDO").alias("estado"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
