"""Declared rules, keys and references: every one runs, finds what is planted, and equals a plain count."""

import datetime as dt
from collections import Counter

import pytest

from feedlake.operators import quality as Q
from feedlake.plans import declared
from feedlake.sources.domain import Domain

FOLDER = "/root/testdata/sf0.001"


def test_every_declared_table_has_a_frame(spark):
    d = Domain(spark, FOLDER)
    for table in Q.ROW_RULES.keys() | Q.KEYS.keys():
        columns = set(declared.frame(d, table).columns)
        assert {c for key in Q.KEYS.get(table, []) for c in key} <= columns, table


def test_a_declared_table_without_a_frame_stops_the_job(spark):
    with pytest.raises(KeyError, match="desconocida"):
        declared.frame(Domain(spark, FOLDER), "desconocida")


def test_every_row_rule_finds_what_is_planted(spark):
    from feedlake.plans import registry

    found = {(r.tabla, r.regla): r.violaciones for r in registry.jobs()["p1_row_rules"](spark, "/root/testdata/sf0.01").collect()}
    assert found.keys() == {(t, r) for t, rules in Q.ROW_RULES.items() for r in rules}
    assert not [rule for rule, n in found.items() if n == 0]


def test_keys_of_any_type_in_one_pass(spark):
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0, 1)
    # Instants one microsecond apart, texts that would run together, a null in a key: none of them collides.
    a = spark.createDataFrame([(1, "x,y", "z", t0), (2, "x", "y,z", t0), (2, "x", "y,z", t0 + dt.timedelta(microseconds=1)), (None, "q", "q", t0),
                               (None, "q", "r", t0)], "id int, p string, q string, t timestamp")
    b = spark.createDataFrame([], "id int")
    got = {(r.tabla, r.regla): r.violaciones for r in Q.check_keys([("a", a, [["id"], ["p", "q"], ["id", "t"]]), ("b", b, [["id"]])]).collect()}
    assert got == {("a", "unica_id"): 1, ("a", "unica_p_q"): 1, ("a", "unica_id_t"): 0, ("b", "unica_id"): 0}


def test_keys_equal_a_plain_count_with_a_hot_value(spark):
    rows = [(7 if i % 3 == 0 else i, i % 11) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, j long").repartition(13)
    got = {r.regla: r.violaciones for r in Q.check_keys([("t", df, [["k"], ["k", "j"], ["j"]])]).collect()}
    plain = lambda values: sum(n > 1 for n in Counter(values).values())
    assert got == {"unica_k": plain(k for k, _ in rows), "unica_k_j": plain(rows), "unica_j": plain(j for _, j in rows)}


def test_references_equal_a_plain_count(spark):
    rows = [(i, 7 if i % 3 == 0 else i % 50, None if i % 5 == 0 else i % 9) for i in range(2000)]
    a = spark.createDataFrame(rows, "id long, x long, y int").repartition(5)
    users = spark.createDataFrame([(i,) for i in range(40) if i != 7], "id long")
    colours = spark.createDataFrame([(i,) for i in range(4)] * 2, "id int")
    nobody = spark.createDataFrame([], "id int")
    found = Q.check_references([("a", a, {"x": "users", "y": "colours"}), ("b", a, {"id": "users"}), ("c", a, {"y": "nobody"})],
                               {"users": (users, "id"), "colours": (colours, "id"), "nobody": (nobody, "id")})
    got = {(r.tabla, r.regla): r.violaciones for r in found.collect()}
    assert got == {("a", "fk_x"): sum(x == 7 or x >= 40 for _, x, _ in rows), ("a", "fk_y"): sum(y is not None and y > 3 for *_, y in rows),
                   ("b", "fk_id"): 2000 - 39, ("c", "fk_y"): sum(y is not None for *_, y in rows)}


def test_text_references_compare_as_text(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1), ("y", 2), (None, 3)], "code string, n int")
    codes = spark.createDataFrame([("x",)], "code string")
    numbers = spark.createDataFrame([(1,), (2,)], "id long")
    got = {r.regla: r.violaciones for r in Q.check_references([("a", a, {"code": "codes", "n": "numbers"})],
                                                              {"codes": (codes, "code"), "numbers": (numbers, "id")}).collect()}
    assert got == {"fk_code": 2, "fk_n": 1}


def test_the_reference_check_reads_each_table_once_and_joins_no_fact(spark):
    a = spark.range(10).selectExpr("id", "id AS x", "id AS y")
    plan = Q.check_references([("a", a, {"x": "t", "y": "t"})], {"t": (a, "id")})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range") == 2 and plan.count("Join") == 1


def test_profiles_of_users_without_consent(spark):
    users = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, consentimiento_personalizacion boolean")
    profiles = spark.createDataFrame([(1, 5), (2, 6), (2, 7), (3, 8), (4, 9)], "usuario_id long, cantidad_eventos long")
    # A consent that is not recorded is no refusal; an unknown user is a matter of the reference check.
    assert sorted(r.cantidad_eventos for r in Q.profiles_without_consent(profiles, users).collect()) == [6, 7]


def test_the_values_of_keys_are_held_without_the_names_of_their_rule(spark):
    """The widest part of an entry was two texts that are the same for all values of a rule."""
    df = spark.createDataFrame([(1, "[\"1\"]"), (1, "1"), (2, "1")], "k long, t string")
    out = Q.check_keys([("una_tabla", df, [["k"], ["t"], ["k", "t"]]), ("otra", df.limit(0), [["k"]])])
    assert {(r.tabla, r.regla): r.violaciones for r in out.collect()} == {
        ("una_tabla", "unica_k"): 1, ("una_tabla", "unica_t"): 1, ("una_tabla", "unica_k_t"): 0, ("otra", "unica_k"): 0}
    held = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x and "valor" in x]
    assert held and not any("tabla" in x or "regla" in x for x in held)
