"""Rankings: trending by section, top lists, group caps, session order, materialised refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import expressions as E
from feedlake.functions.ordering import number_in_slices, top_per_group
from feedlake.operators.metrics import decayed_clicks
from feedlake.session import cut_lineage


def _score_slice(score: Column, date: Column) -> Column:
    """Score level (eight per power of two); the many zero scores are split further by publication day."""
    level = F.when(score > 0, F.floor(F.log2(score) * 8) + 10000).otherwise(F.lit(0))
    return F.struct(level.alias("nivel"), F.when(score <= 0, date.cast("date")).alias("dia"))


def position_in_section(scored: DataFrame) -> DataFrame:
    """1..n inside each section by score, then date, then id; no section is sorted in a single task."""
    return number_in_slices(
        scored, ["seccion_id"], _score_slice(F.col("score"), F.col("fecha_publicacion")), "desc",
        [F.col("score").desc(), F.col("fecha_publicacion").desc(), F.col("contenido_id").asc()], "posicion_en_seccion")


def trending_by_section(impressions: DataFrame, publishable: DataFrame, days: int = 7,
                        scale_seconds: float = E.DAY_SECONDS) -> DataFrame:
    """Trending contents: decayed clicks of the last days joined with what may be shown, ranked by section."""
    recent = decayed_clicks(impressions, days, scale_seconds)
    scored = publishable.join(recent, "contenido_id").select(
        "seccion_id", "seccion_slug", "contenido_id", "titulo", "tipo_contenido", "nivel_acceso", "fecha_publicacion",
        "impresiones", "clics", F.round("score_decaido", 6).alias("score"), F.lit(days * 24).alias("ventana_horas"))
    # One row per content from a scan of all impressions: written once, because numbering reads it twice.
    return position_in_section(cut_lineage(scored))


def top_global(scored: DataFrame, n: int) -> DataFrame:
    return scored.orderBy(F.col("score").desc(), F.col("contenido_id").asc()).limit(n)


def top_by_section(scored: DataFrame, n: int) -> DataFrame:
    return top_per_group(scored, ["seccion_id"], [F.col("score").desc(), F.col("contenido_id").asc()], n, "puesto")


def diversified(ranked: DataFrame, k: int, per_section: int = 2) -> DataFrame:
    """Best ``k`` rows per user with at most ``per_section`` from one section. Input: usuario_id, seccion_id, score."""
    order = [F.col("score").desc(), F.col("contenido_id").asc()]
    capped = top_per_group(ranked, ["usuario_id", "seccion_id"], order, per_section, "__en_seccion").drop("__en_seccion")
    return top_per_group(capped, ["usuario_id"], order, k, "puesto")


def session_order(events: DataFrame) -> DataFrame:
    """Place of each event in its session; sessions are sliced by minute so that none is sorted as a whole."""
    keyed = events.withColumn("sesion_id", E.session_key(F.col("usuario_id"), F.col("ocurrido_en")))
    return number_in_slices(keyed, ["sesion_id"], F.date_trunc("minute", "ocurrido_en"), "asc",
                            [F.col("ocurrido_en").asc(), F.col("evento_id").asc()], "orden_en_sesion")


def refresh_ranking(ranking: DataFrame, folder: str) -> DataFrame:
    """Rebuild a ranking as a new version next to the old one, check its key, then point to it.

    Readers keep the previous version until the new one is listed.
    """
    from feedlake.operators.metrics import duplicates
    from feedlake.sources.loading import publish_version

    return publish_version(ranking, folder, check=lambda df: duplicates(df, ["seccion_id", "contenido_id"]))
