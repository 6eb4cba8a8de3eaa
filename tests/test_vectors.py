"""Exact block search equals numpy brute force: clusters, ties, levels, caps, tiny blocks, many pivots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlake.operators import vectors as V


def data(seed, n=240, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    m = np.concatenate([centres[rng.integers(0, 5, n - 60)] + 0.2 * rng.normal(size=(n - 60, dim)),
                        np.repeat(centres[:1], 60, axis=0)])  # a quarter are copies of one vector
    level, grp = rng.integers(0, 3, n), rng.integers(0, 4, n)
    return m, level, grp


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def brute(qm, qlevel, m, level, grp, k, own, cap):
    sim = np.round(unit(qm) @ unit(m).T, 6)
    out = set()
    for q in range(len(qm)):
        used = {}
        ranked = sorted((-(sim[q, b]), b) for b in range(len(m)) if level[b] <= qlevel[q] and not (own and b == q))
        pos = 0
        for s, b in ranked:
            if cap and used.get(grp[b], 0) >= cap:
                continue
            used[grp[b]] = used.get(grp[b], 0) + 1
            pos += 1
            if pos > k:
                break
            out.add((q, b, pos))
    return out


@pytest.mark.parametrize("own,cap", [(True, None), (False, None), (False, 2)])
def test_nearest_equals_brute_force(spark, own, cap, monkeypatch):
    monkeypatch.setattr(V, "ROOTS", 0.8)
    m, level, grp = data(1)
    base = spark.createDataFrame([(i, m[i].tolist(), int(level[i]), int(grp[i])) for i in range(len(m))],
                                 "id long, v array<double>, level int, grp int")
    qm = m if own else m[::7] * 3.0
    qlevel = np.full(len(qm), 2) if own else np.arange(len(qm)) % 3
    q = spark.createDataFrame([(i, qm[i].tolist(), int(qlevel[i])) for i in range(len(qm))], "id long, v array<double>, level int")
    got = {(r.id, r.other, r.puesto) for r in V.nearest(q, base, 5, per_group=cap, same_space=own, block_rows=32).collect()}
    assert got == brute(qm, qlevel, m, level, grp, 5, own, cap)


def test_pruning_skips_far_cells(spark):
    rng = np.random.default_rng(9)
    centres = unit(rng.normal(size=(6, 8)))
    m = centres[rng.integers(0, 6, 200)] + 0.01 * rng.normal(size=(200, 8))
    base = spark.createDataFrame([(i, m[i].tolist(), 0, 0) for i in range(200)], "id long, v array<double>, level int, grp int")
    cells = V._in_cells(base, centres)
    visits = V._meeting_cells(base.select("id", "v", "level"), centres, V._Bounds(cells, 6, 3, None))
    assert visits.count() == 200  # each query needs its own cell only


def test_a_cap_by_group_still_skips_cells(spark):
    """With two rows a group and five groups in every cell, ten capped rows are near each pivot."""
    rng = np.random.default_rng(12)
    centres = unit(rng.normal(size=(6, 8)))
    cell = np.arange(240) % 6
    m = centres[cell] + 0.01 * rng.normal(size=(240, 8))
    grp = rng.integers(0, 5, 240)
    base = spark.createDataFrame([(i, m[i].tolist(), 0, int(grp[i])) for i in range(240)], "id long, v array<double>, level int, grp int")
    cells = V._in_cells(base, centres)
    visits = V._meeting_cells(base.select("id", "v", "level"), centres, V._Bounds(cells, 6, 4, None, 2))
    assert visits.count() == 240  # of 1440 meetings of a query and a cell
    few = V._meeting_cells(base.select("id", "v", "level"), centres, V._Bounds(cells, 6, 11, None, 2))
    assert few.count() == 1440  # eleven rows need more groups than a cell has
    got = {(r.id, r.other, r.puesto) for r in V.nearest(base.drop("grp"), base, 4, per_group=2, same_space=True, centres=centres).collect()}
    assert got == brute(m, np.zeros(240, int), m, np.zeros(240, int), grp, 4, True, 2)


def test_copies_of_the_base_do_not_grow_with_the_queries(spark):
    rng = np.random.default_rng(13)
    m = rng.normal(size=(50, 4))
    base = spark.createDataFrame([(i, m[i].tolist(), 0, 0) for i in range(50)], "id long, v array<double>, level int, grp long").withColumn(
        "cell", V.F.lit(0))
    held = []
    for n in (10, 2000):
        q = spark.range(n).selectExpr("id", "array(1d, 0d, 0d, 1d) AS v", "0 AS level", "0 AS cell")
        found = V._meet(q, base, np.array([50]), 64, lambda a, b: {"n": np.array([len(b.id)]), "q": np.array([len(a.id)])}, "n long, q long").collect()
        assert {r.n for r in found} == {50} and sum(r.q for r in found) == n
        plan = V._meet(q, base, np.array([50]), 64, None, "n long")._jdf.queryExecution().optimizedPlan().toString()
        held.append(plan.count("explode"))
    assert held[0] == held[1]


def test_near_duplicates_with_copies(spark, monkeypatch):
    monkeypatch.setattr(V, "ROOTS", 0.8)
    m, _, _ = data(3, n=150)
    emb = spark.createDataFrame([(i, m[i].tolist()) for i in range(len(m))], "contenido_id long, embedding array<double>")
    rep = {}
    for i, v in enumerate(map(tuple, m)):
        rep.setdefault(v, i)
    reps = sorted(rep.values())
    sim = np.round(unit(m) @ unit(m).T, 6)
    want = {(a, b) for a in reps for b in reps if a < b and sim[a, b] > 0.97}
    want |= {(rep[tuple(m[i])], i) for i in range(len(m)) if rep[tuple(m[i])] != i}
    got = {(r.contenido_a, r.contenido_b) for r in V.near_duplicates(emb, 0.97, block_rows=16).collect()}
    assert got == want


def test_profiles_need_consent_history_and_a_direction(spark):
    emb = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(1, 7)],
                                "contenido_id long, embedding array<double>")
    users = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)], "id long, consentimiento_personalizacion boolean")
    rows = [(1, c, "vista") for c in range(1, 5)] + [(2, c, "vista") for c in range(1, 5)] + [(3, 1, "vista"), (3, 2, "vista")]
    rows += [(4, c, "impresion") for c in range(1, 6)]  # weight zero: no direction, no profile
    events = spark.createDataFrame(rows, "usuario_id long, contenido_id long, tipo_evento string")
    got = V.user_profiles(events, emb, users).collect()
    assert [r.usuario_id for r in got] == [1]
    assert got[0].embedding == pytest.approx([2 ** -0.5, 2 ** -0.5]) and got[0].cantidad_eventos == 4


def test_opposite_weights_cancel_out(spark):
    emb = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(1, 8)], "contenido_id long, embedding array<double>")
    users = spark.createDataFrame([(1, True)], "id long, consentimiento_personalizacion boolean")
    events = spark.createDataFrame(
        [(1, 1, "reproduccion"), (1, 2, "no_me_interesa"), (1, 3, "reproduccion"), (1, 4, "no_me_interesa")],
        "usuario_id long, contenido_id long, tipo_evento string")
    assert V.user_profiles(events, emb, users).count() == 0


def test_hot_user_profile_is_merged_over_salts(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(300, 6))
    emb = spark.createDataFrame([(i, m[i].tolist()) for i in range(300)], "contenido_id long, embedding array<double>")
    users = spark.createDataFrame([(1, True), (2, True)], "id long, consentimiento_personalizacion boolean")
    events = spark.createDataFrame([(1, i, "vista") for i in range(300)] + [(2, i, "clic") for i in range(10)],
                                   "usuario_id long, contenido_id long, tipo_evento string")
    got = {r.usuario_id: r.embedding for r in V.user_profiles(events, emb, users, salts=5).collect()}
    assert got[1] == pytest.approx(unit(m.sum(axis=0, keepdims=True))[0].tolist())
    assert got[2] == pytest.approx(unit(m[:10].sum(axis=0, keepdims=True))[0].tolist())


def test_mixed_dimensions_are_reported(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0, 0.0], "b")],
                                "contenido_id long, embedding array<double>, modelo_embedding string")
    row = V.vector_sanity(emb).first()
    assert (row.modelos, row.dimensiones, row.coherente) == (2, 2, False)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_lists_reach_the_recall_asked_for_and_read_less(spark, spread):
    rng = np.random.default_rng(5)
    middles = unit(rng.normal(size=(12, 16)))
    m = unit(middles[rng.integers(0, 12, 900)] + spread * rng.normal(size=(900, 16)) / 4)
    base = spark.createDataFrame([(i, [float(x) for x in r], i % 3, 0) for i, r in enumerate(m)], "id long, v array<double>, level int, grp long").repartition(4)
    queries = base.select("id", "v", F.lit(1).alias("level"))
    approx, read = V.nearest_in_lists(queries, base, 5, middles, target=0.95, same_space=True)
    got = V.recall(V.nearest(queries, base, 5, same_space=True), approx).first()
    assert got.vecinos == 4500 and got.recall >= 0.95
    r = read.first()
    assert r.posibles == 900 * 900 and r.leidas < (0.5 if spread < 1 else 0.98) * r.posibles
    rows = approx.collect()
    assert all(x.other != x.id and x.other % 3 <= 1 for x in rows) and max(x.puesto for x in rows) == 5
    assert all(abs(x.sim - m[x.id] @ m[x.other]) < 1e-5 for x in rows)


def test_a_query_with_too_few_rows_reads_all_lists(spark):
    m = np.eye(6)
    base = spark.createDataFrame([(i, [float(x) for x in r], 0, 0) for i, r in enumerate(m)], "id long, v array<double>, level int, grp long")
    approx, read = V.nearest_in_lists(base.select("id", "v", "level"), base, 10, m, same_space=True)
    assert approx.count() == 30 and read.first().leidas == 36
    none, _ = V.nearest_in_lists(base.select("id", "v", "level").limit(0), base, 10, m)
    assert none.count() == 0


def test_queries_are_copied_by_groups_of_cells(spark):
    """Without structure every query must see every cell, and still goes once to each group only."""
    rng = np.random.default_rng(21)
    m = unit(rng.normal(size=(1600, 48)))
    base = spark.createDataFrame([(i, m[i].tolist(), 0, i % 4) for i in range(1600)], "id long, v array<float>, level int, grp long")
    visits, placed, sizes = V._arrange(base.drop("grp"), base, 5)
    assert placed.select("place").distinct().count() >= 16 and len(sizes) <= 4 and sizes.sum() == 1600
    assert 1600 <= visits.count() <= 1600 * len(sizes)
    m32 = m.astype(np.float32).astype(np.float64)
    got = {(r.id, r.other, r.puesto) for r in V.nearest(base.drop("grp"), base, 5, same_space=True, block_rows=300).collect()}
    assert got == brute(m32, np.zeros(1600, int), m32, np.zeros(1600, int), np.arange(1600) % 4, 5, True, None)


def test_rows_are_handed_on_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(V, "OUT_ROWS", 7)
    need = np.random.default_rng(3).random((30, 9)) < 0.8
    pieces = list(V._repeated(V.pd.DataFrame({"id": range(30)}), need, np.arange(30)))
    assert max(map(len, pieces)) <= 7
    assert [(r.id, r.cell, r.place) for p in pieces for r in p.itertuples()] == [(q, c, q) for q, c in zip(*np.nonzero(need))]


def test_blocks_of_a_part_bound_what_they_hold(monkeypatch):
    """Places of any size, a block of zero vectors among them: no row is more similar than its block's bound."""
    monkeypatch.setattr(V, "SCAN", 16)
    rng = np.random.default_rng(8)
    place = np.sort(rng.integers(0, 9, 200))
    v = unit(unit(rng.normal(size=(9, 6)))[place] + 0.3 * rng.normal(size=(200, 6)))
    v[place == 4] = 0.0
    rows = V._Rows(np.arange(200), np.zeros(200, int), np.zeros(200, int), np.zeros(200, bool), place, v)
    spans = rows.blocks[0]
    assert [i for a, b in spans for i in range(a, b)] == list(range(200)) and max(b - a for a, b in spans) <= 16
    reach = rows.reach(v)
    assert all((reach[:, [i]] >= v @ v[a:b].T).all() for i, (a, b) in enumerate(spans)) and (reach < 0.5).any()


def test_long_lists_are_made_for_fewer_queries_at_a_time(spark, monkeypatch):
    """What a task holds follows neither the depth of the lists nor the size of a part."""
    m = unit(np.random.default_rng(13).normal(size=(90, 6)))
    base = spark.createDataFrame([(i, m[i].tolist(), 0, i % 4) for i in range(90)], "id long, v array<double>, level int, grp long")
    monkeypatch.setattr(V, "HELD", 160)
    got = {(r.id, r.other, r.puesto) for r in V.nearest(base.drop("grp"), base, 40, same_space=True).collect()}
    assert got == brute(m, np.zeros(90, int), m, np.zeros(90, int), np.arange(90) % 4, 40, True, None)
    monkeypatch.setattr(V, "_best_in_block", lambda k, cap: lambda q, rows: iter([{"id": [len(q.id)], "other": [0], "sim": [0.0], "grp": [0]}]))
    assert {r.id for r in V.nearest(base.drop("grp"), base, 40).collect()} <= {1, 2, 3, 4}
    assert max(r.id for r in V.nearest(base.drop("grp"), base, 2).collect()) > 4


def test_pairs_are_handed_on_block_by_block(spark, monkeypatch):
    """A group of near copies, where every row is a pair with every other: no piece is larger than queries times a block."""
    monkeypatch.setattr(V, "SCAN", 8)
    sizes, meet = [], V._meet
    m = unit(np.ones((1, 6)) + 1e-3 * np.random.default_rng(5).normal(size=(60, 6)))

    def keep(queries, base, counts, block_rows, fn, schema):
        rows = V._Rows(np.arange(60), np.zeros(60, int), np.zeros(60, int), np.zeros(60, bool), np.zeros(60, int), m)
        sizes.extend(len(piece["similitud"]) for piece in fn(rows, rows))
        return meet(queries, base, counts, block_rows, fn, schema)

    monkeypatch.setattr(V, "_meet", keep)
    emb = spark.createDataFrame([(i, m[i].tolist()) for i in range(60)], "contenido_id long, embedding array<double>")
    assert V.near_duplicates(emb, 0.9).count() == 60 * 59 // 2 == sum(sizes) and max(sizes) <= 60 * 8
