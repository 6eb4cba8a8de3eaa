"""Queries: streaming jobs run to completion, compared with batch SQL over the same rows.

Windows still open at the end of the input are not emitted in append mode, so the SQL keeps the windows that
close before the watermark (last event minus the lateness).
"""

from pyspark.sql import functions as F

from feedlake.plans.registry import query
from feedlake.session import run_folder
from feedlake.sources.domain import EVENT_NAMES
from feedlake.streaming import events as T


def _stream(d):
    raw = T.read_event_files(d.spark, d.folder, d.table("events").schema, "events.parquet")
    kind = F.lit(None).cast("string")
    for source, name in EVENT_NAMES.items():
        kind = F.when(F.col("event_type") == source, F.lit(name)).otherwise(kind)
    return raw.select(
        F.col("event_id").alias("evento_id"), F.when(F.col("event_id") % 50 != 7, F.col("user_id")).alias("usuario_id"),
        F.get_json_object("props", "$.k").cast("long").alias("contenido_id"), kind.alias("tipo_evento"),
        F.col("ts").alias("ocurrido_en"))


def _ingested(d, name, lose_checkpoint=False):
    """Accepted and rejected rows of the committed batches of one run over the stream, or of two with a checkpoint each."""
    folder, stream = run_folder(d.spark, name), _stream(d)
    accepted, rejected, manifest = f"{folder}/aceptados", f"{folder}/rechazados", f"{folder}/manifiesto"
    for n in range(2 if lose_checkpoint else 1):
        T.ingest(stream, accepted, rejected, manifest, f"{folder}/checkpoint-{n}")
    return (T.read_committed(d.spark, accepted, manifest, stream.schema),
            T.read_committed(d.spark, rejected, manifest, T.rejected_schema(stream.schema)))


_MARK = "(SELECT max(ocurrido_en) - INTERVAL 10 MINUTE FROM eventos)"
_EV = "(SELECT evento_id, CASE WHEN evento_id % 50 <> 7 THEN usuario_id END AS usuario_id, contenido_id, tipo_evento, ocurrido_en FROM eventos)"


@query("t01_stream_ingest", f"""
    SELECT CASE WHEN usuario_id IS NULL THEN 'rechazado' ELSE 'aceptado' END AS destino, tipo_evento, count(*) AS filas FROM {_EV} GROUP BY 1, 2""")
def _(d):
    good, bad = _ingested(d, "ingesta")
    good, bad = good.select(F.lit("aceptado").alias("destino"), "tipo_evento"), bad.select(F.lit("rechazado").alias("destino"), "tipo_evento")
    return good.unionByName(bad).groupBy("destino", "tipo_evento").agg(F.count("*").alias("filas"))


@query("s14_stream_append", f"SELECT evento_id, contenido_id, tipo_evento FROM {_EV} WHERE usuario_id IS NOT NULL")
def _(d):
    """Committed rows of a first query, whose checkpoint is then lost: the second adds its own lots, ids are kept once."""
    return _ingested(d, "agregar", lose_checkpoint=True)[0].select("evento_id", "contenido_id", "tipo_evento").dropDuplicates(["evento_id"])


@query("t02_distinct_events", "SELECT evento_id, ocurrido_en FROM eventos")
def _(d):
    s = _stream(d)
    doubled = s.unionByName(s)
    return T.run_to_folder(T.distinct_events(doubled), run_folder(d.spark, "unicos")).select("evento_id", "ocurrido_en")


@query("t03_rate_limit", f"""
    SELECT usuario_id, date_trunc('minute', ocurrido_en) AS minuto, count(*) AS eventos FROM {_EV} GROUP BY 1, 2
    HAVING count(*) > 1 AND date_trunc('minute', ocurrido_en) + INTERVAL 1 MINUTE <= {_MARK}""")
def _(d):
    done = T.run_to_folder(T.rate_counters(_stream(d).filter("usuario_id IS NOT NULL")), run_folder(d.spark, "cupo"))
    return T.over_limit(done, 1)


@query("t04_sessions", f"""
    WITH e AS (SELECT *, CASE WHEN ocurrido_en - lag(ocurrido_en) OVER (PARTITION BY usuario_id ORDER BY ocurrido_en, evento_id)
        <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nueva FROM {_EV} WHERE usuario_id IS NOT NULL),
    s AS (SELECT *, sum(nueva) OVER (PARTITION BY usuario_id ORDER BY ocurrido_en, evento_id) AS n FROM e)
    SELECT usuario_id, min(ocurrido_en) AS desde, max(ocurrido_en) + INTERVAL 30 MINUTE AS hasta, count(*) AS eventos FROM s
    GROUP BY usuario_id, n HAVING max(ocurrido_en) + INTERVAL 30 MINUTE <= {_MARK}""")
def _(d):
    return T.run_to_folder(T.sessions(_stream(d).filter("usuario_id IS NOT NULL")), run_folder(d.spark, "sesiones"))


@query("t05_sliding_trending", f"""
    SELECT desde, desde + INTERVAL 24 HOUR AS hasta, contenido_id, count(*) AS eventos, count(*) FILTER (WHERE tipo_evento = 'clic') AS clics,
           round(sum(CASE WHEN tipo_evento = 'clic' THEN exp(-((epoch_us(desde + INTERVAL 24 HOUR) - epoch_us(ocurrido_en)) / 1000000.0) / 86400.0)
           ELSE 0 END), 6) AS score
    FROM (SELECT *, unnest(generate_series(date_trunc('hour', ocurrido_en) - INTERVAL 23 HOUR, date_trunc('hour', ocurrido_en), INTERVAL 1 HOUR)) AS desde
          FROM eventos) GROUP BY 1, 2, 3 HAVING desde + INTERVAL 24 HOUR <= {_MARK}""")
def _(d):
    return T.run_to_folder(T.sliding_trending(_stream(d)), run_folder(d.spark, "tendencia"))
