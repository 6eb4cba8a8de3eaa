"""Aggregates over impressions, clickstream, searches, consents, versions, moderations and subscriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import expressions as E
from feedlake.functions.ordering import previous_in_slices

ONE = "*"
# Popularity windows and their length in hours.
WINDOWS = {"24h": 24, "7d": 168, "30d": 720}


def cutoff(impressions: DataFrame, column: str = "mostrado_en") -> Column:
    """The last instant of the data as a scalar subquery: no cross join with a one-row relation."""
    return impressions.agg(F.max(column).alias("corte")).scalar()


def mean_of(value: Column, digits: int = 2) -> Column:
    """Mean of a measure kept with ``digits`` decimals; rounding the sum makes it independent of row order."""
    return F.round(F.sum(value), digits) / F.count(value)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(ONE).alias("filas")).select(F.lit(name).alias("tabla"), "filas")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def rows_per_month(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(E.month_text(F.col(ts)).alias("mes")).agg(F.count(ONE).alias("filas"))


def strategy_performance(impressions: DataFrame, strategies: DataFrame) -> DataFrame:
    """Impressions, clicks, click-through, distinct contents and users by strategy and surface.

    Grouping runs on the strategy id; the code list is joined to the handful of result rows.
    """
    s = strategies.select(F.col("id").alias("estrategia_id"), F.col("codigo").alias("estrategia"), "version", "motor")
    g = impressions.groupBy("estrategia_id", "superficie").agg(
        F.count(ONE).alias("impresiones"), F.count_if("clic").alias("clics"),
        F.countDistinct("contenido_id").alias("contenidos_distintos"),
        F.countDistinct("usuario_id").alias("usuarios_alcanzados"))
    return g.join(s, "estrategia_id").select(
        "estrategia", "version", "motor", "superficie", "impresiones", "clics",
        E.ratio(F.col("clics"), F.col("impresiones")).alias("ctr"), "contenidos_distintos", "usuarios_alcanzados")


def decayed_clicks(impressions: DataFrame, days: int = 7, scale_seconds: float = E.DAY_SECONDS) -> DataFrame:
    """Impressions, clicks and decayed clicks by content over the days before the last impression."""
    end = cutoff(impressions)
    weight = F.when(F.col("clic"), E.efolding(F.col("__corte"), F.col("mostrado_en"), scale_seconds)).otherwise(0.0)
    recent = impressions.withColumn("__corte", end).filter(
        F.col("mostrado_en") >= F.col("__corte") - F.make_dt_interval(F.lit(days)))
    return recent.groupBy("contenido_id").agg(
        F.count(ONE).alias("impresiones"), F.count_if("clic").alias("clics"), F.sum(weight).alias("score_decaido"))


def popularity_by_window(events: DataFrame, contents: DataFrame, sections: DataFrame, as_of,
                         scale_seconds: float = E.DAY_SECONDS) -> DataFrame:
    """Views and decayed views per content in the last 24 hours, 7 days and 30 days, one pass over the events."""
    now = E.literal_ts(as_of)
    age = E.elapsed_seconds(now, F.col("ocurrido_en"))
    views = events.filter((F.col("tipo_evento") == "vista") & (F.col("ocurrido_en") <= now)
                          & (F.col("ocurrido_en") >= now - F.make_dt_interval(F.lit(30))))
    aggs = []
    for name, hours in WINDOWS.items():
        inside = age <= hours * 3600
        aggs += [F.count_if(inside).alias(f"v_{name}"),
                 F.sum(F.when(inside, F.exp(-age / scale_seconds)).otherwise(0.0)).alias(f"s_{name}")]
    wide = views.groupBy("contenido_id").agg(*aggs)
    rows = wide.select("contenido_id", F.explode(F.array(*[
        F.struct(F.lit(n).alias("ventana"), F.col(f"v_{n}").alias("vistas"), F.round(f"s_{n}", 6).alias("score"))
        for n in WINDOWS])).alias("w")).select("contenido_id", "w.*").filter("vistas > 0")
    place = contents.select(F.col("id").alias("contenido_id"), "seccion_id").join(
        sections.select(F.col("id").alias("seccion_id"), F.col("nombre").alias("seccion")), "seccion_id")
    return rows.join(place, "contenido_id").select("contenido_id", "ventana", "seccion", "score", "vistas")


def daily_consumption(events: DataFrame) -> DataFrame:
    """Grain content x day x device. A completed view is also a view, so completed never exceeds views."""
    kind = F.col("tipo_evento")
    return events.groupBy(
        E.day_key(F.col("ocurrido_en")).alias("fecha_key"), F.col("contenido_id").alias("contenido_key"), "dispositivo"
    ).agg(
        F.count_if(kind.isin("vista", "completado")).alias("vistas"),
        F.count_if(kind == "completado").alias("vistas_completas"),
        F.countDistinct("usuario_id").alias("usuarios_unicos"),
        F.sum(F.floor("segundos")).alias("segundos_totales"),
        F.count_if(kind == "guardado").alias("guardados"),
        F.count_if(kind == "compartido").alias("compartidos"))


def daily_impressions(impressions: DataFrame) -> DataFrame:
    """Grain day x strategy x surface."""
    g = impressions.groupBy(
        E.day_key(F.col("mostrado_en")).alias("fecha_key"), F.col("estrategia_id").alias("estrategia_key"), "superficie"
    ).agg(F.count(ONE).alias("impresiones"), F.count_if("clic").alias("clics"),
          F.countDistinct("contenido_id").alias("contenidos_distintos"))
    return g.withColumn("ctr", E.ratio(F.col("clics"), F.col("impresiones")))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(ONE).alias("filas")).filter("filas > 1")


# ---- strategy evaluation -------------------------------------------------------------------------

def coverage_by_strategy(impressions: DataFrame, publishable: DataFrame) -> DataFrame:
    """Share of the publishable catalogue each strategy showed at least once."""
    total = publishable.agg(F.count(ONE).alias("n")).scalar()
    shown = impressions.select("estrategia_id", "contenido_id").distinct().join(
        publishable.select("contenido_id"), "contenido_id", "left_semi")
    return shown.groupBy("estrategia_id").agg(F.count(ONE).alias("mostrados")).select(
        "estrategia_id", "mostrados", E.ratio(F.col("mostrados"), total, 6).alias("cobertura"))


def diversity_by_strategy(impressions: DataFrame, contents: DataFrame, tree: DataFrame) -> DataFrame:
    """Entropy over root sections, and mean number of root sections in a user's list."""
    roots = contents.select(F.col("id").alias("contenido_id"), "seccion_id").join(
        tree.select("seccion_id", "seccion_raiz_id"), "seccion_id").select("contenido_id", "seccion_raiz_id")
    small = impressions.groupBy("estrategia_id", "usuario_id", "contenido_id").agg(F.count(ONE).alias("n"))
    placed = small.join(roots, "contenido_id")
    per_user = placed.groupBy("estrategia_id", "usuario_id", "seccion_raiz_id").agg(F.sum("n").alias("n"))
    share = per_user.groupBy("estrategia_id", "seccion_raiz_id").agg(F.sum("n").alias("n"), F.count(ONE).alias("listas"))
    users = per_user.groupBy("estrategia_id").agg(F.countDistinct("usuario_id").alias("usuarios"))
    total = share.groupBy("estrategia_id").agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return share.join(total, "estrategia_id").groupBy("estrategia_id").agg(
        F.round(F.sum(-p * F.log(p)), 6).alias("entropia"), F.sum("listas").alias("listas")
    ).join(users, "estrategia_id").select(
        "estrategia_id", "entropia", E.ratio(F.col("listas"), F.col("usuarios")).alias("raices_por_usuario"))


def retention_by_strategy(impressions: DataFrame, events: DataFrame, days: int = 7) -> DataFrame:
    """Users first reached by a strategy who act again on one of the following ``days`` days."""
    first = impressions.groupBy("estrategia_id", "usuario_id").agg(
        F.min(F.col("mostrado_en").cast("date")).alias("d0"))
    active = events.select("usuario_id", F.col("ocurrido_en").cast("date").alias("dia")).distinct()
    later = first.withColumn("dia", F.explode(F.sequence(F.date_add("d0", 1), F.date_add("d0", days))))
    back = later.join(active, ["usuario_id", "dia"], "left_semi").select("estrategia_id", "usuario_id").distinct()
    exposed = first.groupBy("estrategia_id").agg(F.count(ONE).alias("expuestos"))
    kept = back.groupBy("estrategia_id").agg(F.count(ONE).alias("vuelven"))
    return exposed.join(kept, "estrategia_id", "left").select(
        "estrategia_id", "expuestos", F.coalesce("vuelven", F.lit(0)).alias("vuelven"),
        E.ratio(F.coalesce("vuelven", F.lit(0)), F.col("expuestos")).alias("retencion"))


def ab_comparison(impressions: DataFrame, assignments: DataFrame) -> DataFrame:
    """Click-through of each arm by the user's assigned variant, and its distance to control."""
    per_user = impressions.groupBy("usuario_id").agg(F.count(ONE).alias("i"), F.count_if("clic").alias("c"))
    arms = per_user.join(assignments, "usuario_id").groupBy("variante").agg(
        F.count(ONE).alias("usuarios"), F.sum("i").alias("impresiones"), F.sum("c").alias("clics"))
    control = arms.filter("variante = 'control'").select(
        (F.col("clics") / F.col("impresiones")).alias("base")).scalar()
    return arms.select("variante", "usuarios", "impresiones", "clics",
                       E.ratio(F.col("clics"), F.col("impresiones"), 6).alias("ctr"),
                       F.round(F.col("clics") / F.col("impresiones") - control, 6).alias("diferencia"))


def consumption_by_root(events: DataFrame, contents: DataFrame, tree: DataFrame) -> DataFrame:
    per_content = events.filter(F.col("tipo_evento") == "vista").groupBy("contenido_id").agg(F.count(ONE).alias("n"))
    return (per_content.join(contents.select(F.col("id").alias("contenido_id"), "seccion_id"), "contenido_id")
            .join(tree.select("seccion_id", "seccion_raiz"), "seccion_id")
            .groupBy("seccion_raiz").agg(F.sum("n").alias("vistas"), F.count(ONE).alias("contenidos")))


def content_metrics(events: DataFrame) -> DataFrame:
    kind = F.col("tipo_evento")
    return events.groupBy("contenido_id").agg(
        F.count(ONE).alias("eventos"), F.countDistinct("usuario_id").alias("usuarios"),
        F.count_if(kind == "vista").alias("vistas"), F.count_if(kind == "clic").alias("clics"),
        mean_of(F.when(kind == "vista", F.col("segundos"))).alias("segundos_medios"),
        F.max("ocurrido_en").alias("ultimo"))


def attribution(events: DataFrame) -> DataFrame:
    return events.filter((F.col("tipo_evento") == "impresion") & F.col("estrategia_origen").isNotNull()).groupBy(
        F.col("estrategia_origen").alias("estrategia")).agg(
        F.count(ONE).alias("impresiones"), F.countDistinct("usuario_id").alias("usuarios"))


def user_features(events: DataFrame, contents: DataFrame) -> DataFrame:
    """Events, distinct contents, most frequent section (lowest id on ties) and last activity per user."""
    pairs = events.groupBy("usuario_id", "contenido_id").agg(
        F.count(ONE).alias("n"), F.max("ocurrido_en").alias("ultimo"))
    placed = pairs.join(contents.select(F.col("id").alias("contenido_id"), "seccion_id"), "contenido_id", "left")
    per_section = placed.groupBy("usuario_id", "seccion_id").agg(
        F.sum("n").alias("n"), F.count(ONE).alias("contenidos"), F.max("ultimo").alias("ultimo"))
    best = F.max_by("seccion_id", F.when(F.col("seccion_id").isNotNull(), F.struct("n", -F.col("seccion_id"))))
    return per_section.groupBy("usuario_id").agg(
        F.sum("n").alias("eventos"), F.sum("contenidos").alias("contenidos_distintos"),
        best.alias("seccion_principal"), F.max("ultimo").alias("ultimo"))


# ---- logs with a latest state ---------------------------------------------------------------------

def latest_consents(consents: DataFrame) -> DataFrame:
    return consents.groupBy("usuario_id", "finalidad").agg(
        F.max_by("otorgado", F.struct("registrado_en", "id")).alias("otorgado"),
        F.max("registrado_en").alias("registrado_en"))


def latest_versions(versions: DataFrame) -> DataFrame:
    return versions.groupBy("contenido_id").agg(
        F.max("numero_version").alias("ultima_version"), F.count(ONE).alias("ediciones"),
        F.max_by("editor_id", "numero_version").alias("ultimo_editor"))


def changed_fields(versions: DataFrame) -> DataFrame:
    return versions.select(F.explode(F.json_object_keys("cambios")).alias("campo"), "contenido_id").groupBy("campo").agg(
        F.count(ONE).alias("cambios"), F.countDistinct("contenido_id").alias("contenidos"))


def playback_rollup(telemetry: DataFrame, bucket: str = "1 hour") -> DataFrame:
    w = F.window("ocurrido_en", bucket)
    return telemetry.groupBy(w.alias("w"), "contenido_id").agg(
        F.count(ONE).alias("latidos"), mean_of(F.col("buffer_ms")).alias("buffer_medio"),
        F.max("buffer_ms").alias("buffer_max"), F.count_if(F.col("calidad") == "sd").alias("latidos_sd")).select(
        F.col("w.start").cast("timestamp_ntz").alias("desde"), "contenido_id", "latidos", "buffer_medio", "buffer_max",
        "latidos_sd")


def search_clickthrough(results: DataFrame) -> DataFrame:
    """By query text: searches, results shown, results clicked, share of searches with a click."""
    per_search = results.groupBy("texto", "busqueda_id").agg(
        F.count(ONE).alias("r"), F.count_if("clic").alias("c"))
    return per_search.groupBy("texto").agg(
        F.count(ONE).alias("busquedas"), F.sum("r").alias("resultados"), F.sum("c").alias("clics"),
        F.count_if(F.col("c") > 0).alias("con_clic")).select(
        "texto", "busquedas", "resultados", "clics", E.ratio(F.col("clics"), F.col("resultados")).alias("ctr"),
        E.ratio(F.col("con_clic"), F.col("busquedas")).alias("tasa_exito"))


def moderation_outcome(moderations: DataFrame) -> DataFrame:
    a = F.col("accion")
    return moderations.filter(F.col("contenido_id").isNotNull()).groupBy("contenido_id").agg(
        F.max_by("accion", F.struct("creado_en", "id")).alias("ultima_accion"),
        F.count_if(a == "aprobado").alias("aprobadas"), F.count_if(a == "rechazado").alias("rechazadas"),
        F.count_if(a == "marcado").alias("marcadas"), F.count_if(a == "despublicado").alias("despublicadas"))


def plan_transitions(subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """Counts of previous plan -> plan over each user's history; the first plan comes from ``inicio``."""
    p = plans.select(F.col("id").alias("plan_id"), F.col("codigo").alias("plan"))
    named = subscriptions.join(p, "plan_id").select("usuario_id", "desde", "id", "plan")
    stepped = previous_in_slices(named, ["usuario_id"], F.trunc(F.col("desde").cast("date"), "month"), ["desde", "id"], {"plan_previo": "plan"})
    return stepped.groupBy(F.coalesce("plan_previo", F.lit("inicio")).alias("plan_previo"), "plan").agg(
        F.count(ONE).alias("cambios"), F.countDistinct("usuario_id").alias("usuarios"))


def premium_conversion(subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """By first plan: users, and how many of them ever reached the premium plan later."""
    p = plans.select(F.col("id").alias("plan_id"), F.col("codigo").alias("plan"))
    per_user = subscriptions.join(p, "plan_id").groupBy("usuario_id").agg(
        F.min_by("plan", F.struct("desde", "id")).alias("primer_plan"),
        F.max(F.col("plan") == "premium").alias("llego"))
    return per_user.groupBy("primer_plan").agg(
        F.count(ONE).alias("usuarios"), F.count_if("llego").alias("premium")).withColumn(
        "conversion", E.ratio(F.col("premium"), F.col("usuarios")))
