"""Co-occurrence, paths, lists and blends against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest
from feedlake.operators import recommend as R


def skewed(seed, users=25, items=40):
    """One user holds about a third of the edges, two more are large."""
    rng = random.Random(seed)
    edges = {(0, i) for i in range(items)} | {(1, i) for i in range(0, items, 2)} | {(2, i) for i in range(5, 30)}
    for u in range(3, users):
        for i in rng.sample(range(items + 5), rng.randint(1, 4)):
            edges.add((u, i))
    return sorted(edges)


def frame(spark, edges):
    return spark.createDataFrame(edges + edges[:5], "usuario_id long, contenido_id long")


def brute_pairs(edges):
    by_user = defaultdict(set)
    for u, i in edges:
        by_user[u].add(i)
    n = Counter()
    for s in by_user.values():
        for i in s:
            for j in s:
                if i != j:
                    n[i, j] += 1
    return n, Counter(i for _, i in edges), by_user


@pytest.fixture(params=[(3, 10), (7, 50), (1000, 2_000_000)])
def chunk(request, monkeypatch):
    """Sizes of chunks and of sums: results must not depend on them."""
    monkeypatch.setattr(R, "CHUNK", request.param[0])
    monkeypatch.setattr(R, "PRODUCTS", request.param[1])


def test_cooccurrence_equals_brute_force(spark, chunk):
    edges, k = skewed(1), 4
    n, size, _ = brute_pairs(edges)
    want = {}
    for i in size:
        ranked = sorted(((-math.floor(n[a, b] / math.sqrt(size[b]) * 1e9 + 0.5), b) for a, b in n if a == i))[:k]
        want.update({(i, p): (j, n[i, j]) for p, (_, j) in enumerate(ranked, 1)})
    got = {(r.i, r.puesto): (r.j, r.n_ij) for r in R.item_cooccurrence(frame(spark, edges), k).collect()}
    assert got == want


def test_graph_neighbours_equal_brute_force(spark, chunk):
    edges = skewed(5)
    n, size, _ = brute_pairs(edges)
    want = {}
    for i in size:
        ranked = sorted((-(n[a, b] / size[a]), b) for a, b in n if a == i)[:3]
        want.update({(i, p): j for p, (_, j) in enumerate(ranked, 1)})
    assert {(r.i, r.puesto): r.j for r in R.graph_neighbours(frame(spark, edges), 3).collect()} == want
    assert {(r.i, r.j): r.n_ij for r in R.graph_neighbours(frame(spark, edges), 1000).collect()} == dict(n)


def test_co_viewing_equals_brute_force(spark, chunk):
    edges, k = skewed(7), 5
    n, size, by_user = brute_pairs(edges)
    want, of_few = {}, {}
    for u, own in by_user.items():
        paths = {j: sum(n[c, j] for c in own) for j in size if j not in own}
        ranked = sorted((-p, j) for j, p in paths.items() if p > 0)[:k]
        for pos, (p, j) in enumerate(ranked, 1):
            via = min((-n[c, j], c) for c in own)[1]
            want[u, pos] = (j, -p, via)
        of_few.update({(u, j): p for j, p in paths.items() if p > 0 and u > 20})
    rows = R.co_view_recommendations(frame(spark, edges), k).collect()
    assert {(r.u, r.puesto): (r.j, r.caminos, r.via) for r in rows} == want
    some = frame(spark, edges).where("usuario_id > 20")
    rows = R.co_view_recommendations(some, None, False, frame(spark, edges)).collect()
    assert {(r.u, r.j): r.caminos for r in rows} == of_few


def test_sparse_product_has_no_large_rows(spark, monkeypatch):
    """A column that holds a third of the entries on both sides, weights, and columns that only one side has."""
    monkeypatch.setattr(R, "CHUNK", 5)
    rng = random.Random(3)
    left = [(r, 0, r) for r in range(40)] + [(rng.randint(0, 30), k, 2) for k in range(1, 60)]
    right = [(0, c, c + 1) for c in range(30)] + [(k, rng.randint(0, 30), 3) for k in range(30, 90)]
    want = Counter()
    for r, k, x in left:
        for q, c, y in right:
            if k == q:
                want[r, c] += x * y
    a, b = spark.createDataFrame(left, "r long, k long, x long"), spark.createDataFrame(right, "k long, c long, y long")
    assert {(r.r, r.c): r.n for r in R.sparse_product(a, b).collect()} == dict(want)
    assert R.sparse_product(a.limit(0), b).collect() == []


def test_a_user_whose_first_candidates_are_all_refused_still_gets_a_full_list(spark):
    lists = {1: range(100), 2: range(100), 3: range(5), 4: range(100)}
    refused = {(1, j) for j in range(75)} | {(2, 0)} | {(4, j) for j in range(97)}
    depth = []

    def fetch(users, size):
        asked = set(lists) if users is None else {r.u for r in users.collect()}
        depth.append((size, sorted(asked)))
        rows = [(u, j, float(-j)) for u in asked for j in list(lists[u])[:size]]
        return spark.createDataFrame(rows, "u long, j long, score double")

    bad = spark.createDataFrame(sorted(refused), "u long, j long")
    other = spark.createDataFrame([(1, 3, 1), (1, 90, 1), (2, 0, 1), (2, 50, 4)], "u long, j long, score long")
    got = R.eligible_top({"b": other}, {"a": fetch}, lambda c: c.join(bad, ["u", "j"], "left_anti"), 10).collect()
    want = {("a", u, j) for u, js in lists.items() for j in [j for j in js if (u, j) not in refused][:10]} | {("b", 1, 90), ("b", 2, 50)}
    assert {(r.s, r.u, r.j) for r in got} == want and len(got) == len(want)
    assert depth == [(40, [1, 2, 3, 4]), (320, [1, 4])]


def test_shortest_path_and_its_nodes(spark):
    e = spark.createDataFrame([("U1", "C1"), ("U2", "C1"), ("U2", "C2"), ("U3", "C2"), ("U9", "C9")], "origen string, destino string")
    paths = R.shortest_paths(e, "U1").cache()
    hops = {r.nodo: r.saltos for r in paths.collect()}
    assert hops == {"U1": 0, "C1": 1, "U2": 2, "C2": 3, "U3": 4}
    assert [r.nodo for r in R.path_to(paths, "U3").orderBy("saltos").collect()] == ["U1", "C1", "U2", "C2", "U3"]
    assert {r.nodo for r in R.shortest_paths(e, "U1", 2).collect()} == {"U1", "C1", "U2"}


def test_cold_start_lists_only_unseen_contents(spark):
    contents = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "id long, titulo string")
    tags = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (2, "a"), (2, "b"), (3, "c"), (4, "b"), (5, "a"), (5, "b")],
                                 "contenido_id long, etiqueta string")
    views = spark.createDataFrame([(7, 1), (8, 1), (7, 2), (9, 4)], "usuario_id long, contenido_id long")
    got = [(r.contenido_id, r.puesto, r.parecido_id, r.comunes, r.lectores)
           for r in R.cold_start_similar(contents, tags, views, 2).orderBy("contenido_id", "puesto").collect()]
    assert got == [(0, 1, 2, 2, 1), (0, 2, 1, 1, 2), (5, 1, 2, 2, 1), (5, 2, 1, 1, 2)]


def test_blend_scales_each_list(spark):
    s = lambda rows: spark.createDataFrame(rows, "u long, j long, score double")
    out = R.blend({"popularidad": s([(1, 1, 10.0), (1, 2, 0.0)]), "grafo": s([(1, 2, 5.0)])}, {"popularidad": 0.5, "grafo": 0.25})
    assert {(r.j): r.score for r in out.collect()} == {1: 0.5, 2: 0.25}


def test_rank_fusion(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "q string, j long, puesto long")
    b = spark.createDataFrame([("q", 2, 1)], "q string, j long, puesto long")
    rows = R.reciprocal_rank_fusion([a, b], 5).orderBy("puesto").collect()
    assert [(r.j, r.listas) for r in rows] == [(2, 2), (1, 1)]
    assert rows[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-8)


def test_neighbour_table_is_keyed_by_source(spark):
    s = spark.createDataFrame([(1, 2, -0.5)], "i long, j long, score double")
    rows = R.neighbour_table({"embedding": s, "grafo": s}).collect()
    assert {(r.origen, r.score) for r in rows} == {("embedding", 0.0), ("grafo", 0.0)}


def test_bridges_have_no_own_section(spark):
    views = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "usuario_id long, contenido_id long")
    contents = spark.createDataFrame([(1, 10), (2, 20), (3, 20)], "id long, seccion_id int")
    rows = {(r.contenido_id, r.seccion_destino): (r.lectores, r.caminos) for r in R.bridge_contents(views, contents).collect()}
    assert rows == {(1, 20): (1, 2), (2, 10): (1, 1), (3, 10): (1, 1)}


def test_each_two_items_are_paired_once(spark, chunk):
    """Before the shuffle a pair is one row, the lesser item first, within a chunk and between chunks."""
    edges = skewed(11)
    n, _, _ = brute_pairs(edges)
    rows = R._half_pairs(R._edges(frame(spark, edges), "usuario_id", "contenido_id")).collect()
    assert len(rows) == len({(r.i, r.j) for r in rows}) and {(r.i, r.j): r.n for r in rows} == {(i, j): c for (i, j), c in n.items() if i < j}
    alone = spark.createDataFrame([(u, 5) for u in range(9)], "usuario_id long, contenido_id long")
    assert R._half_pairs(R._edges(alone, "usuario_id", "contenido_id")).collect() == []
    assert R.item_cooccurrence(alone, 3).collect() == []
