"""Rules that are easy to get wrong, each on hand-made rows."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedlake.operators import catalog as C
from feedlake.operators import metrics as M
from feedlake.operators import quality as Q
from feedlake.operators import ranking as K
from feedlake.sources.loading import LoadError

AS_OF = "2024-02-01 00:00:00"


def ts(s):
    return dt.datetime.fromisoformat(s) if s else None


@pytest.fixture(scope="module")
def contents(spark):
    rows = [  # id, section, state, level, published, valid until
        (1, 10, "publicado", 0, "2024-01-01", None), (2, 10, "publicado", 1, "2024-01-02", "2024-02-01"),
        (3, 20, "publicado", 2, "2024-02-01", None), (4, 20, "publicado", 0, "2024-02-02", None),
        (5, 20, "borrador", 0, None, None), (6, 31, "publicado", 0, "2024-01-05", "2024-03-01")]
    return spark.createDataFrame([(i, f"t{i}", None, 1, s, 7, st, lv, ts(p), ts(v)) for i, s, st, lv, p, v in rows],
                                 "id long, titulo string, bajada string, tipo_contenido_id int, seccion_id int, autor_id long, "
                                 "estado string, nivel_acceso int, fecha_publicacion timestamp_ntz, vigente_hasta timestamp_ntz")


@pytest.fixture(scope="module")
def sections(spark):  # 40 and 41 point at each other
    rows = [(1, None), (10, 1), (20, 1), (31, 20), (40, 41), (41, 40)]
    return spark.createDataFrame([(i, f"s{i}", f"S{i}", p) for i, p in rows], "id int, slug string, nombre string, seccion_padre_id int")


@pytest.fixture(scope="module")
def types(spark):
    return spark.createDataFrame([(1, "articulo", False), (2, "video", True)], "id int, codigo string, admite_duracion boolean")


def ids(df, col="contenido_id"):
    return sorted(r[col] for r in df.collect())


def test_publishable_bounds(contents, types, sections):
    # Valid-until is exclusive, the publication instant inclusive, drafts and later contents stay out.
    assert ids(C.publishable_contents(contents, types, sections, AS_OF)) == [1, 3, 6]


def test_tree_paths_and_cycles(sections):
    tree = {r.seccion_id: r for r in C.section_tree(sections).collect()}
    assert sorted(tree) == [1, 10, 20, 31]
    assert (tree[31].profundidad, tree[31].seccion_raiz_id, tree[31].camino) == (3, 1, "S1 > S20 > S31")


def test_contents_in_a_cycle_are_found(spark, contents, sections):
    lost = contents.withColumn("seccion_id", F.when(F.col("id") == 2, 40).otherwise(F.col("seccion_id")))
    assert ids(C.outside_tree(lost, C.section_tree(sections)), "id") == [2]


def test_section_veto_is_exact_unless_asked(spark, contents, sections):
    prefs = spark.createDataFrame([(1, 20, None, "no_interesa"), (2, None, "x", "no_interesa"), (3, 20, None, "sigue")],
                                  "usuario_id long, seccion_id int, etiqueta string, tipo_preferencia string")
    tags = spark.createDataFrame([(1, "x"), (6, "y")], "contenido_id long, etiqueta string")
    pairs = lambda df: sorted((r.usuario_id, r.contenido_id) for r in df.collect())
    assert pairs(C.user_vetoes(prefs, contents, tags)) == [(1, 3), (1, 4), (1, 5), (2, 1)]
    below = C.section_descendants(sections)
    assert pairs(C.user_vetoes(prefs, contents, tags, below)) == [(1, 3), (1, 4), (1, 5), (1, 6), (2, 1)]
    every = spark.createDataFrame([(u, c) for u in (1, 2, 3) for c in range(1, 7)], "usuario_id long, contenido_id long")
    for tree in (None, below):
        left = set(pairs(C.without_vetoed(every, prefs, contents, tags, tree)))
        assert left == set(pairs(every)) - set(pairs(C.user_vetoes(prefs, contents, tags, tree)))


def test_access_level_now_and_then(spark):
    plans = spark.createDataFrame([(1, "gratuito", 0), (3, "premium", 2)], "id int, codigo string, nivel_acceso int")
    users = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    subs = spark.createDataFrame(
        [(1, 3, ts("2023-01-10"), ts("2024-01-15"), "activa"), (1, 1, ts("2024-01-15"), None, "activa"),
         (2, 3, ts("2023-06-01"), None, "cancelada")],
        "usuario_id long, plan_id int, desde timestamp_ntz, hasta timestamp_ntz, estado string")
    now = {r.usuario_id: r.nivel_acceso for r in C.access_level_now(users, subs, plans, AS_OF).collect()}
    assert now == {1: 0, 2: 0, 3: 0}
    facts = spark.createDataFrame([(1, 1, ts("2024-01-14 23:59:59")), (2, 1, ts("2024-01-15")), (3, 1, ts("2022-12-31")),
                                   (4, 2, ts("2023-06-01")), (5, 3, ts("2023-06-01"))], "id int, usuario_id long, t timestamp_ntz")
    then = {r.id: r.nivel_entonces for r in C.access_level_at(facts, "t", subs, plans).collect()}
    assert then == {1: 2, 2: 0, 3: 0, 4: 2, 5: 0}


def test_cold_users_include_those_without_events(spark):
    users = spark.createDataFrame([(1,), (2,)], "id long")
    events = spark.createDataFrame([(1, c) for c in (1, 2, 3, 4, 4)], "usuario_id long, contenido_id long")
    got = {r.usuario_id: (r.contenidos_distintos, r.frio) for r in C.cold_users(users, events).collect()}
    assert got == {1: (4, False), 2: (0, True)}


def test_trending_window_decay_and_ties(spark, contents, types, sections):
    rows = [(1, 1, "2024-01-31 12:00:00", True), (2, 1, "2024-01-30 12:00:00", True), (3, 3, "2024-01-24 12:00:00", False),
            (4, 3, "2024-01-24 11:59:59", True), (5, 6, "2024-01-31 00:00:00", False), (6, 4, "2024-01-31 01:00:00", True)]
    imp = spark.createDataFrame([(i, c, ts(t), k) for i, c, t, k in rows],
                                "id long, contenido_id long, mostrado_en timestamp_ntz, clic boolean")
    pub = C.publishable_contents(contents, types, sections, AS_OF)
    got = {r.contenido_id: r for r in K.trending_by_section(imp, pub).collect()}
    assert sorted(got) == [1, 3, 6]  # 4 is not publishable yet
    assert got[1].score == pytest.approx(1 + 2.718281828 ** -1, abs=1e-6)
    # The seven-day bound is inclusive and unclicked impressions count.
    assert (got[3].impresiones, got[3].clics, got[3].score, got[3].posicion_en_seccion) == (1, 0, 0.0, 1)


def test_clickthrough_stays_in_range(spark):
    imp = spark.createDataFrame([(1, "home", 1, 1, True), (1, "home", 2, 1, False), (2, "home", 2, 3, False)],
                                "estrategia_id int, superficie string, contenido_id long, usuario_id long, clic boolean")
    st = spark.createDataFrame([(1, "a", "1.0", "duckdb"), (2, "b", "1.0", "neo4j")], "id int, codigo string, version string, motor string")
    rows = {r.estrategia: r for r in M.strategy_performance(imp, st).collect()}
    assert rows["a"].ctr == 0.5 and rows["a"].contenidos_distintos == 2 and rows["a"].usuarios_alcanzados == 1
    assert rows["b"].ctr == 0.0


def test_row_rules_pass_on_null_and_count_violations(spark):
    df = spark.createDataFrame([(None,), (1919,), (1920,), (2013,)], "anio_nacimiento int")
    assert Q.check_rows("usuarios", df).first().violaciones == 2
    prefs = spark.createDataFrame([("sigue", 0.5, 1, None), ("sigue", 0.5, 1, 2), ("otro", 1.5, None, None)],
                                  "tipo_preferencia string, peso double, seccion_id int, etiqueta_id int")
    got = {r.regla: r.violaciones for r in Q.check_rows("preferencias_usuario", prefs).collect()}
    assert got == {"tipo": 1, "peso": 1, "seccion_o_etiqueta": 2}


def test_there_are_fifty_five_row_rules():
    assert sum(len(r) for r in Q.ROW_RULES.values()) == 55


def test_keys_and_references_ignore_nulls(spark):
    df = spark.createDataFrame([(1, 10), (1, 10), (None, 11), (None, 11), (2, 99)], "k int, ref int")
    parent = spark.createDataFrame([(10,), (11,)], "id int")
    assert Q.check_key("t", df, ["k"]).first().violaciones == 1
    assert Q.check_foreign_key("t", df, "ref", parent).first().violaciones == 1


def test_a_broken_rule_stops_the_job(spark):
    bad = spark.createDataFrame([("t", "r", 2), ("t", "s", 0)], "tabla string, regla string, violaciones long")
    with pytest.raises(LoadError, match="t.r: 2"):
        Q.require_clean(bad)
    assert Q.require_clean(bad.filter("violaciones = 0")).count() == 1


def test_required_fields_name_the_first_missing(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (None, None)], "x int, y string")
    good, bad = Q.split_required(df, ["x", "y"])
    assert good.count() == 1 and [r.motivo_rechazo for r in bad.collect()] == ["falta x", "falta x"]


def test_reconcile_keeps_one_sided_groups(spark):
    a = spark.createDataFrame([(1, 5), (2, 7)], "k int, n long")
    b = spark.createDataFrame([(1, 5), (3, 1)], "k int, n long")
    rows = {r.k: r.n_dif for r in Q.reconcile(a, b, ["k"], ["n"]).collect()}
    assert rows == {1: 0, 2: 7, 3: -1}
    with pytest.raises(LoadError):
        Q.require_equal(Q.reconcile(a, b, ["k"], ["n"]), ["n"])


def test_schema_contract_lists_differences(spark):
    from pyspark.sql.types import StructType

    df = spark.createDataFrame([(1, "x")], "id int, extra string")
    rows = {r.columna: (r.declarado, r.encontrado, r.cumple)
            for r in Q.check_schema("t", df, StructType.fromDDL("id BIGINT, falta DATE")).collect()}
    assert rows == {"id": ("bigint", "int", False), "extra": ("-", "string", False), "falta": ("date", "-", False)}


def veto_rows(spark, users=40, items=60):
    """Users and contents with several, one, no and repeated terms, and one of each without an id."""
    prefs = [(u, 10 + u % 4, None, "no_interesa") for u in range(users)] + [(u, None, "abc"[u % 3], "no_interesa") for u in range(0, users, 2)]
    prefs += prefs[:9] + [(None, 11, None, "no_interesa"), (None, None, "a", "no_interesa"), (99, 12, None, "sigue"), (98, None, None, "no_interesa")]
    contents = [(c, 10 + c % 5 if c % 7 else None) for c in range(items)] + [(3, 11), (3, 12), (None, 11)]
    tags = [(c, t) for c in range(0, items, 2) for t in ("ab", "bc", "c", "x")[c % 4]] + [(None, "a"), (5, None)]
    pairs = {(u, c) for u, s, t, kind in prefs if kind == "no_interesa"
             for c in [c for c, at in contents if s is not None and at == s] + [c for c, tag in tags if t is not None and tag == t]}
    return (spark.createDataFrame(prefs, "usuario_id long, seccion_id int, etiqueta string, tipo_preferencia string"),
            spark.createDataFrame(contents, "id long, seccion_id int"), spark.createDataFrame(tags, "contenido_id long, etiqueta string"), pairs)


@pytest.mark.parametrize("users,items,rows", [(1, 1, 1), (3, 4, 5), (20_000, 4_000, 200_000)])
def test_each_vetoed_pair_is_made_once_in_blocks_of_any_size(spark, monkeypatch, users, items, rows):
    for name, n in (("VETO_USERS", users), ("VETO_CONTENTS", items), ("VETO_ROWS", rows)):
        monkeypatch.setattr(C, name, n)
    prefs, contents, tags, want = veto_rows(spark)
    out = C.user_vetoes(prefs, contents, tags)
    assert Counter(tuple(r) for r in out.select("usuario_id", "contenido_id").collect()) == Counter(want)
    # The pairs are made after the last exchange: neither an aggregate nor a shuffle has them all.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") and "Aggregate" not in plan[:plan.index("MapInArrow")]


def test_vetoes_among_given_pairs(spark):
    prefs, contents, tags, want = veto_rows(spark)
    asked = [(u, c) for u in [*range(0, 40, 3), None, 77] for c in [*range(0, 60, 2), None, 500]] * 2
    among = spark.createDataFrame(asked, "usuario_id long, contenido_id long")
    found = C.user_vetoes(prefs, contents, tags, among=among)
    assert Counter(tuple(r) for r in found.collect()) == Counter(want & set(asked))
    left = {tuple(r) for r in among.subtract(found).collect()}
    assert left == set(asked) - want


def section_vetoes(spark, users, items):
    """Every user vetoes the one section that all contents are in."""
    prefs = spark.range(users).selectExpr("id * 7 AS usuario_id", "10 AS seccion_id", "CAST(NULL AS STRING) AS etiqueta", "'no_interesa' AS tipo_preferencia")
    return prefs, spark.range(items).selectExpr("id * 3 AS id", "10 AS seccion_id"), spark.createDataFrame([], "contenido_id long, etiqueta string")


def test_files_of_vetoed_pairs_stay_small(spark, tmp_path):
    C.user_vetoes(*section_vetoes(spark, 2_000, 3_001)).write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    assert pairs.count() == 2_000 * 3_001
    assert pairs.agg(F.bit_xor(F.xxhash64("usuario_id", "contenido_id"))).first() == spark.range(2_000).select((F.col("id") * 7).alias("u")).join(
        spark.range(3_001).select((F.col("id") * 3).alias("c"))).agg(F.bit_xor(F.xxhash64("u", "c"))).first()
    # A pair has sixteen bytes; in pairs of one user after another with all of a block, it took one byte.
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.3 * 2_000 * 3_001


def test_vetoes_travel_in_lists(spark, monkeypatch):
    for name in ("VETO_USERS", "VETO_CONTENTS"):
        monkeypatch.setattr(C, name, 50)
    kept = []
    monkeypatch.setattr(C, "cut_lineage", lambda df, cut=C.cut_lineage: kept.append(cut(df)) or kept[-1])
    prefs, contents, tags = section_vetoes(spark, 500, 900)
    out = C.user_vetoes(prefs, contents, tags.union(spark.range(900).selectExpr("id * 3", "'no one vetoes this'")))
    users, items = kept
    # What is sent to each block of the other side: a list for some fifty ids, and none for a tag without a veto.
    assert 0 < users.count() <= 10 and 0 < items.count() <= 18
    assert out.distinct().count() == out.count() == 500 * 900
