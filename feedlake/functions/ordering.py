"""Numbering and look-back inside groups of any size.

A window over one key sorts the whole group in one task, which fails when a single key holds a large
part of the table. These helpers cut every group into consecutive slices by a *slice* expression that
never decreases along the wanted order, work inside (group, slice), and repair the borders with one
small aggregate per slice. The result is the same as that of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_in_slices(df: DataFrame, keys: list[str], slice_col: Column, slice_order: str,
                     order: list[Column], out: str) -> DataFrame:
    """``row_number()`` over ``keys`` in ``order``; ``slice_order`` is ``asc`` or ``desc``."""
    work = df.withColumn("__slice", slice_col)
    sizes = work.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    direction = F.col("__slice").asc() if slice_order == "asc" else F.col("__slice").desc()
    before = Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order)
    numbered = work.withColumn("__pos", F.row_number().over(inside).cast("long"))
    return (_equi(numbered, offsets, [*keys, "__slice"])
            .withColumn(out, F.col("__pos") + F.col("__before"))
            .drop("__slice", "__pos", "__before"))


def previous_in_slices(df: DataFrame, keys: list[str], slice_col: Column, order: list[str],
                       values: dict[str, str]) -> DataFrame:
    """``lag(value)`` over ``keys`` by ascending ``order``; ``values`` maps output name to source column."""
    work = df.withColumn("__slice", slice_col)
    carried = F.struct(*[F.col(src).alias(name) for name, src in values.items()])
    last = work.groupBy(*keys, "__slice").agg(F.max_by(carried, F.struct(*order)).alias("__last"))
    across = Window.partitionBy(*keys).orderBy("__slice")
    borders = last.select(*keys, "__slice", F.lag("__last").over(across).alias("__border"))
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order)
    looked = work.withColumn("__prev", F.lag(carried).over(inside))
    joined = _equi(looked, borders, [*keys, "__slice"]).withColumn(
        "__prev", F.coalesce(F.col("__prev"), F.col("__border")))
    for name in values:
        joined = joined.withColumn(name, F.col(f"__prev.{name}"))
    return joined.drop("__slice", "__prev", "__border")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str) -> DataFrame:
    """First ``k`` rows of each group. Spark prunes each partition to ``k`` rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k).withColumn(
        out, F.col(out).cast("long"))


def _equi(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on NULL-safe keys that keeps the left columns."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__r_{key}")
    cond = None
    for key in keys:
        part = left[key].eqNullSafe(renamed[f"__r_{key}"])
        cond = part if cond is None else cond & part
    return left.join(renamed, cond).drop(*[f"__r_{key}" for key in keys])
