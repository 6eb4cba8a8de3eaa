import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedlake.operators import audit as A
from feedlake.operators import policy as P
from feedlake.operators import privacy as N

AS_OF = "2024-02-01 00:00:00"
T = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def contents(spark):
    rows = [(1, 7, "publicado", 0), (2, 7, "publicado", 2), (3, 8, "borrador", 0), (4, 7, "borrador", 0)]
    return spark.createDataFrame([(i, a, s, n, T, None) for i, a, s, n in rows],
                                 "id long, autor_id long, estado string, nivel_acceso int, fecha_publicacion timestamp_ntz, "
                                 "vigente_hasta timestamp_ntz")


@pytest.mark.parametrize("role,user,want", [
    ("lector", 7, [1]), ("api", None, [1]), ("editor", 7, [1, 2, 4]), ("editor", None, [1]), ("moderador", 7, [1, 2, 3, 4]),
    ("admin", None, [1, 2, 3, 4]), ("analista", 7, [])])
def test_content_policies(contents, role, user, want):
    assert sorted(r.id for r in P.apply_policy(contents, "contenidos", role, user, 1, AS_OF).collect()) == want


@pytest.mark.parametrize("role,user,n", [("lector", 1, 2), ("lector", None, 0), ("admin", None, 3), ("analista", 1, 0)])
def test_own_row_policies(spark, role, user, n):
    df = spark.createDataFrame([(1,), (1,), (2,)], "usuario_id long")
    assert P.apply_policy(df, "impresiones", role, user).count() == n


def test_writes_must_carry_the_declared_user(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (None, None)], "usuario_id long, declarado long")
    good, bad = P.split_writes(df, "declarado")
    assert good.count() == 1 and bad.count() == 2


def test_column_policy_fails_loudly(spark):
    df = spark.createDataFrame([(1, "a", "secreto")], "id int, codigo string, descripcion string")
    assert P.select_visible(df, "estrategias", "analista", ["id", "codigo"]).columns == ["id", "codigo"]
    with pytest.raises(PermissionError):
        P.select_visible(df, "estrategias", "analista", df.columns)
    for role, table in (("analista", "usuarios"), ("analista", "impresiones"), ("lector", "otra"), ("nadie", "contenidos")):
        with pytest.raises(PermissionError):
            P.select_visible(df, table, role, ["id"])


def test_plan_of_view_ignores_dates_and_keeps_users_without(spark):
    users = spark.createDataFrame([(1,), (2,)], "id long")
    subs = spark.createDataFrame([(1, 1, "activa"), (2, 1, "vencida")], "usuario_id long, plan_id int, estado string")
    plans = spark.createDataFrame([(1, "premium")], "id int, codigo string")
    assert {r.id: r.plan for r in N.users_with_plan(users, subs, plans).collect()} == {1: "premium", 2: "sin_plan"}
    twice = subs.unionByName(subs.filter("usuario_id = 1"))
    assert N.users_with_plan(users, twice, plans).count() == 3  # two active plans fan out, as in the view


def test_salt_and_identifiers_are_checked(spark):
    df = spark.createDataFrame([(1, "x")], "id long, alias string")
    with pytest.raises(ValueError):
        N.check_no_direct_identifiers(df)
    for salt in (None, "corta"):
        with pytest.raises(ValueError):
            N.check_salt(salt)


def test_protected_users_have_no_clear_email(spark):
    users = spark.createDataFrame([(1, "A@b.c")], "id long, email string")
    out = N.protect_users(users, "k", "p", "s" * 32)
    assert "email" not in out.columns and out.first().seudonimo.startswith("U-")


def test_change_log_and_replay(spark):
    schema = "id long, nombre string"
    t0, t1 = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], schema), spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], schema)
    first = A.change_log(t0.filter(F.lit(False)), t0, "s", "t", "2024-01-01 00:00:00")
    second = A.change_log(t0, t1, "s", "t", "2024-01-02 00:00:00", user_app=9)
    rows = {r.registro_id: (r.accion, r.datos_anteriores, r.datos_nuevos, r.usuario_app) for r in second.collect()}
    assert rows == {"2": ("UPDATE", '{"id":2,"nombre":"b"}', '{"id":2,"nombre":"c"}', 9),
                    "3": ("DELETE", '{"id":3}', None, 9), "4": ("INSERT", None, '{"id":4,"nombre":"d"}', 9)}
    log = first.unionByName(second)
    state = lambda at: {r.registro_id for r in A.state_at(log, "t", at).collect()}
    assert state("2024-01-01 12:00:00") == {"1", "2", "3"} and state("2024-01-03 00:00:00") == {"1", "2", "4"}


def test_log_only_grows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, n string")
    log = A.change_log(df.filter(F.lit(False)), df, "s", "t", AS_OF)
    A.append_log(log, str(tmp_path / "log"))
    A.append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_changes_at_one_instant_go_by_sequence(spark):
    row = spark.createDataFrame([(1, "a")], "id long, nombre string")
    changed = spark.createDataFrame([(1, "b")], "id long, nombre string")
    none = row.filter(F.lit(False))
    steps = [A.change_log(none, row, "s", "t", AS_OF), A.change_log(row, changed, "s", "t", AS_OF, sequence=1),
             A.change_log(changed, none, "s", "t", AS_OF, sequence=2)]
    assert A.state_at(steps[1].unionByName(steps[0]), "t", AS_OF).first().datos == '{"id":1,"nombre":"b"}'
    assert A.state_at(steps[2].unionByName(steps[0]).unionByName(steps[1]), "t", AS_OF).count() == 0


def test_images_keep_their_own_columns(spark):
    before = spark.createDataFrame([(1, "a", 2)], "id long, nombre string, viejo int")
    after = spark.createDataFrame([(1, "a")], "id long, nombre string")
    log = A.change_log(before, after, "s", "t", AS_OF).first()
    assert log.accion == "UPDATE" and '"viejo":2' in log.datos_anteriores
