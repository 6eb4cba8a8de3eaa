import json

import pytest
from pyspark.sql import functions as F

from feedlake.plans import lake
from feedlake.sources import loading as L
from feedlake.sources import readers as R
from feedlake.sources.schemas import FILES, GOLD, file_schema, gold_schema


def test_schemas_parse(spark):
    assert all(file_schema(n).fields for n in FILES) and all(gold_schema(n).fields for n in GOLD)


def test_entity_csv_quotes_and_empty_values(spark, tmp_path):
    # Fixed value: the header is the file format.
    head = '"id","titulo","bajada","tipo_contenido_codigo","seccion_id","autor_id","estado","nivel_acceso","idioma",' \
           '"fecha_publicacion","vigente_hasta","duracion_seg","cuerpo_ref","metadatos","creado_en","actualizado_en"\n'
    row = '"91","Uno ""dos""","","podcast","12","7","archivado","1","pt","2021-03-02T05:00:00+00:00","","","","{""a"": true}",' \
          '"2021-03-01T11:30:00+00:00","2021-03-02T06:45:00+00:00"\n'
    (tmp_path / "c.csv").write_text(head + row)
    r = R.read_entity_csv(spark, str(tmp_path / "c.csv"), "contenidos").first()
    assert (r.titulo, r.bajada, r.vigente_hasta, r.duracion_seg, r.cuerpo_ref) == ('Uno "dos"', None, None, None, None)
    assert json.loads(r.metadatos) == {"a": True} and r.fecha_publicacion.hour == 5


def test_documents_as_one_array(spark, tmp_path):
    doc = [{"evento_id": "EV-1", "usuario_id": 7, "sesion_id": "S", "contenido_id": 3, "tipo_evento": "vista",
            "ocurrido_en": "2021-05-06T07:00:01+00:00", "contexto": {"dispositivo": "movil"}, "metricas": {"segundos_visibles": 9}},
           {"evento_id": "EV-2", "usuario_id": 8, "contenido_id": 3, "tipo_evento": "me_gusta", "ocurrido_en": "2021-05-06T07:02:00+00:00"}]
    (tmp_path / "e.json").write_text(json.dumps(doc, indent=1))
    df = R.read_documents(spark, str(tmp_path / "e.json"), "eventos_interaccion", one_array_per_file=True)
    rows = {r.evento_id: r for r in R.flatten_event(df, salt="s" * 32).collect()}
    assert rows["EV-1"].segundos_visibles == 9 and rows["EV-1"].usuario_seudonimo.startswith("U-")
    assert rows["EV-2"].dispositivo is None and "usuario_id" not in rows["EV-2"].asDict()


def test_manifest_differences(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"archivos": {"a.csv": 3, "b.csv": 1}, "escala": "x", "lote": "l", "semilla": 1}))
    expected = R.read_expected_counts(spark, str(tmp_path / "m.json"))
    actual = spark.createDataFrame([("a.csv", 2)], "tabla string, filas long")
    assert {r.entidad: r.diferencia for r in R.compare_counts(expected, actual).collect()} == {"a.csv": -1, "b.csv": -1}


def test_a_rejected_load_publishes_nothing(spark, tmp_path):
    folder = str(tmp_path / "carga")
    good = spark.createDataFrame([(1,)], "id int")
    L.load_all_or_nothing({"t": good}, folder)
    before = L.current_version(spark, folder)
    with pytest.raises(L.LoadError):
        L.load_all_or_nothing({"t": spark.createDataFrame([(1,), (2,)], "id int")}, folder, [lambda t: t["t"].filter("id = 2")])
    assert L.current_version(spark, folder) == before and L.read_loaded(spark, folder, "t").count() == 1


def test_unknown_code_is_reported(spark):
    df = spark.createDataFrame([(1, "a"), (2, "z")], "id int, c string")
    dim = spark.createDataFrame([(9, "a")], "id int, codigo string")
    resolved, unresolved = L.with_lookup(df, dim, "c")
    assert [r.c_id for r in resolved.collect()] == [9] and [r.c for r in unresolved.collect()] == ["z"]
    with pytest.raises(L.LoadError):
        L.require_empty(unresolved, "unknown code")


def test_insert_if_absent_keeps_existing(spark):
    old = spark.createDataFrame([(1, "viejo")], "id int, v string")
    new = spark.createDataFrame([(1, "nuevo"), (2, "nuevo"), (2, "nuevo")], "id int, v string")
    assert sorted(map(tuple, L.insert_if_absent(old, new, ["id"]).collect())) == [(1, "viejo"), (2, "nuevo")]


def test_month_filter_prunes_partitions(spark, tmp_path):
    from feedlake.operators.catalog import between_instants

    path = str(tmp_path / "m")
    df = spark.createDataFrame([(i, f"2024-0{1 + i % 5}-10 00:00:00") for i in range(50)], "id int, s string").select(
        "id", F.col("s").cast("timestamp_ntz").alias("mostrado_en"))
    L.write_by_month(df, path, "mostrado_en")
    out = between_instants(spark.read.schema("id INT, mostrado_en TIMESTAMP_NTZ, mes STRING").parquet(path), "2024-02-01", "2024-03-01")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "mes" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert out.count() == 10


def test_silver_rejects_and_keeps_latest_lot(spark):
    cols = "evento_id string, usuario_id string, contenido_id string, tipo_evento string, ocurrido_en string, dispositivo string, " \
           "segundos string, lote string"
    rows = [("1", "7", "3", "vista", "2024-01-01 00:00:00", "m", "1.5", "l1"), ("1", "7", "4", "vista", "2024-01-01 00:00:00", "m", None, "l2"),
            ("2", None, "3", "vista", "2024-01-01 00:00:00", "m", "1", "l1"), ("3", "7", "q", "vista", "2024-01-01 00:00:00", "m", "1", "l1"),
            ("4", "7", "3", "vista", "ayer", "m", "1", "l2"), (None, "7", "3", "vista", "2024-01-01 00:00:00", "m", "1", "l1"),
            ("z", "7", "3", "vista", "2024-01-01 00:00:00", "m", "1", "l1"), (None, "8", "3", "vista", "2024-01-01 00:00:00", "m", "1", "l1"),
            ("5", "7", "3", "vista", "2024-01-01 00:00:00", "m", "x", "l1"), ("6", "7", "3", "vista", "2024-01-01 00:00:00", "m", None, "l1"),
            ("6", "9", "3", "vista", "2024-01-01 00:01:00", "m", None, "l1")]
    good, bad = lake.silver_events(spark.createDataFrame(rows, cols))
    assert sorted((r.evento_id, r.usuario_id, r.contenido_id, r.segundos, r.lote) for r in good.collect()) == [
        (1, 7, 4, None, "l2"), (6, 9, 3, None, "l1")]
    assert sorted(((r.evento_id or 0), r.motivo_rechazo) for r in bad.collect()) == [
        (0, "falta evento_id"), (0, "falta evento_id"), (0, "formato evento_id"), (2, "falta usuario_id"), (3, "formato contenido_id"),
        (4, "formato ocurrido_en"), (5, "formato segundos")]
    balance = {r.lote: (r.recibidas, r.aceptadas, r.rechazadas, r.repetidas)
               for r in lake.lot_balance(spark.createDataFrame(rows, cols), good, bad).collect()}
    assert balance == {"l1": (9, 1, 6, 2), "l2": (2, 1, 1, 0)}


def test_calendar(spark):
    rows = {r.fecha_key: r for r in lake.dim_date(spark, "2024-03-01", "2024-03-04").collect()}
    assert sorted(rows) == [20240301, 20240302, 20240303, 20240304]
    assert (rows[20240302].dia_semana, rows[20240302].es_fin_semana, rows[20240304].dia_semana) == (6, True, 1)


def test_failure_before_listing_leaves_the_old_version(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "v")
    one = spark.createDataFrame([(1,)], "x int")
    L.load_all_or_nothing({"t": one}, folder)

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(L, "_point_to", broken)
        with pytest.raises(OSError):
            L.load_all_or_nothing({"t": one.withColumn("x", F.lit(2))}, folder)
    assert L.read_loaded(spark, folder, "t").first().x == 1
    L.load_all_or_nothing({"t": one.withColumn("x", F.lit(3))}, folder)
    assert L.read_loaded(spark, folder, "t").first().x == 3


def test_insert_if_absent_picks_the_smallest_of_several(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "z"), (2, "c"), (2, "b")], "k int, v string")
    assert sorted(L.insert_if_absent(old, new, ["k"]).collect()) == [(1, "a"), (2, "b")]
