"""Several micro-batches give the batch result; late and repeated rows behave as documented."""

import datetime as dt
import math
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedlake.streaming import events as T

SCHEMA = "evento_id long, usuario_id long, contenido_id long, tipo_evento string, ocurrido_en timestamp"
T0 = dt.datetime(2024, 1, 1, 10, 0)


def land(spark, folder, batches):
    """One file per batch, written in order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/b{n:02d}")


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def stream(spark, folder):
    return T.read_event_files(spark, f"{folder}/*", StructType.fromDDL(SCHEMA), "*.parquet", files_per_trigger=1)


def test_repeated_ids_are_kept_once(spark, tmp_path):
    src = str(tmp_path / "in")
    land(spark, src, [[(1, 1, 1, "vista", at(0)), (2, 1, 1, "vista", at(1))], [(1, 1, 1, "vista", at(0)), (3, 2, 1, "clic", at(4))]])
    out = T.run_to_folder(T.distinct_events(stream(spark, src)), str(tmp_path / "out"))
    assert sorted(r.evento_id for r in out.collect()) == [1, 2, 3]


def test_closed_minutes_equal_the_batch_count(spark, tmp_path):
    src = str(tmp_path / "in")
    land(spark, src, [[(i, i % 2, 1, "vista", at(i / 4)) for i in range(40)], [(100 + i, 1, 1, "vista", at(60 + i)) for i in range(3)]])
    out = T.run_to_folder(T.rate_counters(stream(spark, src)), str(tmp_path / "out"))
    got = {(r.usuario_id, r.minuto): r.eventos for r in out.collect()}
    batch = spark.read.schema(SCHEMA).parquet(f"{src}/*").groupBy("usuario_id", F.date_trunc("minute", "ocurrido_en").alias("m")).count()
    limit = at(62) - dt.timedelta(minutes=10)
    want = {(r.usuario_id, r.m): r["count"] for r in batch.collect() if r.m + dt.timedelta(minutes=1) <= limit}
    assert got == want and len(got) == 20


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    src = str(tmp_path / "in")
    # Spark judges lateness by the watermark of the batch before, so the late row comes two batches later.
    land(spark, src, [[(1, 1, 1, "vista", at(0)), (2, 1, 1, "vista", at(60))], [(5, 1, 1, "vista", at(61))],
                      [(3, 1, 1, "vista", at(0))], [(4, 1, 1, "vista", at(90))]])
    out = T.run_to_folder(T.rate_counters(stream(spark, src)), str(tmp_path / "out"))
    assert {(r.minuto, r.eventos) for r in out.collect()} == {(at(0), 1), (at(60), 1), (at(61), 1)}


def test_sessions_close_after_the_gap(spark, tmp_path):
    src = str(tmp_path / "in")
    land(spark, src, [[(1, 1, 1, "vista", at(0)), (2, 1, 1, "vista", at(20))], [(3, 1, 1, "vista", at(200))], [(4, 2, 1, "vista", at(400))]])
    out = T.run_to_folder(T.sessions(stream(spark, src)), str(tmp_path / "out"))
    assert {(r.desde, r.hasta, r.eventos) for r in out.collect()} == {(at(0), at(50), 2), (at(200), at(230), 1)}


def ingested(spark, base):
    """Ids of accepted and of rejected rows in committed batches."""
    schema = StructType.fromDDL(SCHEMA)
    good = T.read_committed(spark, f"{base}/a", f"{base}/m", schema)
    bad = T.read_committed(spark, f"{base}/r", f"{base}/m", T.rejected_schema(schema))
    return sorted(r.evento_id for r in good.collect()), sorted((r.evento_id, r.motivo_rechazo) for r in bad.collect())


def ingest(spark, src, base):
    T.ingest(stream(spark, src), f"{base}/a", f"{base}/r", f"{base}/m", f"{base}/c")


def test_ingest_resumes_without_writing_twice(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, src, [[(1, 1, 1, "vista", at(0)), (2, None, 1, "vista", at(1))]])
    ingest(spark, src, base)
    ingest(spark, src, base)
    spark.createDataFrame([(3, 1, 1, "clic", at(2))], SCHEMA).coalesce(1).write.parquet(f"{src}/b99")
    ingest(spark, src, base)
    assert ingested(spark, base) == ([1, 3], [(2, "falta usuario_id")])
    rows = T.committed(spark, f"{base}/m").orderBy("lote_n").collect()
    assert [(r.lote_n, r.aceptadas, r.rechazadas) for r in rows] == [(0, 1, 1), (1, 1, 0)] and len({r.consulta for r in rows}) == 1


def test_a_lost_checkpoint_overwrites_nothing(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, src, [[(1, 1, 1, "vista", at(0))], [(2, 1, 1, "vista", at(1)), (3, None, 1, "clic", at(2))]])
    ingest(spark, src, base)
    shutil.rmtree(f"{base}/c")
    # The source folder was cleaned meanwhile: what the first query accepted exists nowhere else.
    new = str(tmp_path / "new")
    land(spark, new, [[(4, 1, 1, "vista", at(3))]])
    ingest(spark, new, base)
    assert ingested(spark, base) == ([1, 2, 4], [(3, "falta usuario_id")])
    assert T.committed(spark, f"{base}/m").select("consulta").distinct().count() == 2


def test_files_of_a_batch_that_failed_before_its_commit_are_not_read(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, src, [[(1, 1, 1, "vista", at(0))]])
    ingest(spark, src, base)
    spark.createDataFrame([(9, 9, 9, "clic", at(5))], SCHEMA).write.parquet(f"{base}/a/lote=halfway")
    assert ingested(spark, base) == ([1], [])


def test_a_batch_replayed_after_its_commit_is_skipped(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, src, [[(1, 1, 1, "vista", at(0))], [(2, 1, 1, "vista", at(1))]])
    ingest(spark, src, base)
    # As after a driver lost between the manifest row and Spark's own commit of batch 1.
    for name in ("1", ".1.crc"):
        (tmp_path / "out" / "c" / "commits" / name).unlink(missing_ok=True)
    ingest(spark, src, base)
    assert ingested(spark, base) == ([1, 2], [])
    assert T.committed(spark, f"{base}/m").count() == 2


def test_nothing_is_committed_before_the_first_batch(spark, tmp_path):
    assert T.committed(spark, str(tmp_path / "none")).count() == 0
    assert T.read_committed(spark, str(tmp_path / "a"), str(tmp_path / "none"), StructType.fromDDL(SCHEMA)).count() == 0


def test_limit_keeps_only_busy_minutes(spark):
    df = spark.createDataFrame([(1, 3), (2, 9)], "usuario_id long, eventos long")
    assert [r.usuario_id for r in T.over_limit(df, 5).collect()] == [2]


def test_sliding_windows_over_batches_equal_the_batch_result(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(i, 1, i % 3, "clic" if i % 2 else "vista", at(i * 7)) for i in range(120)]
    land(spark, src, [rows[:50], rows[50:90], rows[90:]])
    out = T.run_to_folder(T.sliding_trending(stream(spark, src), "3 hours", "1 hour"), str(tmp_path / "out"))
    got = {(r.desde, r.contenido_id): (r.eventos, r.clics, r.score) for r in out.collect()}
    limit, want = rows[-1][4] - dt.timedelta(minutes=10), {}
    for h in range(-3, 16):
        lo = T0 + dt.timedelta(hours=h)
        hi = lo + dt.timedelta(hours=3)
        for c in range(3):
            inside = [r for r in rows if r[2] == c and lo <= r[4] < hi]
            if inside and hi <= limit:
                clicks = [r for r in inside if r[3] == "clic"]
                score = sum(math.exp(-(hi - r[4]).total_seconds() / 86400) for r in clicks)
                want[lo, c] = (len(inside), len(clicks), pytest.approx(score, abs=1e-6))
    assert got == want
