"""Collaborative, graph and hybrid recommendation over (group, item) edges.

Counting how often two items share a group is a product of the sparse matrix (item, group) with its transpose, and paths
from a user over contents and readers are one more product. Both go through ``sparse_product``: the column of each group
is cut in chunks, every two chunks that meet are one row of a join, and the tasks expand them in numpy and add up equal
pairs before anything is shuffled. A group that holds a third of all edges is many rows on many tasks; there is one way
for every size of group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import expressions as E
from feedlake.functions.ordering import top_per_group
from feedlake.session import cut_lineage

#: Entries of a column in one chunk, and products a task adds up at a time.
CHUNK = 1000
PRODUCTS = 2_000_000
# Scores are compared to nine decimals, so that equal quotients tie and the lower id goes first.
RANK_SCALE = 1e9
# Weight of each signal in the hybrid blend.
HYBRID_WEIGHTS = {"popularidad": 0.2, "embedding": 0.3, "coocurrencia": 0.3, "grafo": 0.2}


# ---- pairs of items that share groups -----------------------------------------------------------------

def _edges(df: DataFrame, group: str, item: str) -> DataFrame:
    return df.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()


def _chunks(entries: DataFrame, item: str, weight: str, name: str) -> DataFrame:
    """(k, parts, part, list): the entries (item, weight) of each column in chunks of about ``CHUNK``."""
    sizes = entries.groupBy("k").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    return (entries.join(sizes, "k").withColumn("part", F.pmod(F.xxhash64(item), F.col("parts")).cast("int"))
            .groupBy("k", "parts", "part").agg(F.collect_list(F.struct(F.col(item).alias("e"), F.col(weight).alias("w"))).alias(name)))


def _expand(batches):
    """Products of the chunks that meet, equal pairs added up. With a column ``same`` (the chunks are one) the lists are of one
    set of items: each two are one pair, the lesser first."""
    def entries(batch, name):
        column = batch.column(name)
        values = column.flatten()
        sizes = np.diff(np.asarray(column.offsets)).astype(np.int64)
        return sizes, np.asarray(values.field("e")).astype(np.int64), np.asarray(values.field("w")).astype(np.int64)

    def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)

    for batch in batches:
        (na, ea, wa), (nb, eb, wb) = entries(batch, "a"), entries(batch, "b")
        start_a, start_b, total = np.cumsum(na) - na, np.cumsum(nb) - nb, np.cumsum(na * nb)
        row = 0
        while row < len(na):
            done = total[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(total, done + PRODUCTS, "right")))
            left = ranges(start_a[row:stop], na[row:stop])
            others = np.repeat(nb[row:stop], na[row:stop])
            right = ranges(np.repeat(start_b[row:stop], na[row:stop]), others)
            left = np.repeat(left, others)
            x, y, w = ea[left], eb[right], wa[left] * wb[right]
            if "same" in batch.schema.names:
                same = batch.column("same").to_numpy(zero_copy_only=False)[row:stop]
                once = (x < y) | ~np.repeat(same, na[row:stop] * nb[row:stop])
                x, y, w = np.minimum(x, y)[once], np.maximum(x, y)[once], w[once]
            rows, r = np.unique(x, return_inverse=True)
            columns, c = np.unique(y, return_inverse=True)
            cells, cell = np.unique(r * max(len(columns), 1) + c, return_inverse=True)
            n = np.zeros(len(cells), np.int64)
            np.add.at(n, cell, w)
            if not len(cells):
                row = stop
                continue
            yield pa.RecordBatch.from_arrays([pa.array(rows[cells // len(columns)]), pa.array(columns[cells % len(columns)]), pa.array(n)], ["r", "c", "n"])
            row = stop


def sparse_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """(r, c, n): n is the sum over k of x * y, from entries ``left`` (r, k, x) and ``right`` (k, c, y), all whole numbers.

    A chunk of the left column goes to each chunk of the right one, so a column that is long on both sides is dealt out by
    its right chunks. No row holds more than two chunks.
    """
    a, b = _chunks(left, "r", "x", "a"), _chunks(right, "c", "y", "b")
    ahead = a.join(b.select("k", F.col("parts").alias("others")).distinct(), "k").select(
        "k", "a", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("part"))
    met = ahead.join(b.select("k", "part", "b"), ["k", "part"]).select("a", "b")
    return met.mapInArrow(_expand, "r long, c long, n long").groupBy("r", "c").agg(F.sum("n").alias("n"))


def _half_pairs(edges: DataFrame) -> DataFrame:
    """(i, j, n) for all i < j that share n groups.

    The product of a matrix with its own transpose: chunks are made once, and a chunk meets itself where it lies. Only groups
    of several chunks are joined, each two chunks once.
    """
    chunks = cut_lineage(_chunks(edges.select(F.col("g").alias("k"), "i", F.lit(1).cast("long").alias("w")), "i", "w", "a"))
    several = chunks.where("parts > 1")
    ahead = several.where("part < parts - 1").select("k", "a", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("part"))
    across = ahead.join(several.select("k", "part", F.col("a").alias("b")), ["k", "part"]).select("a", "b", F.lit(False).alias("same"))
    met = chunks.select("a", F.col("a").alias("b"), F.lit(True).alias("same")).unionByName(across)
    return met.mapInArrow(_expand, "r long, c long, n long").groupBy("r", "c").agg(F.sum("n").alias("n")).toDF("i", "j", "n")


def _pairs(edges: DataFrame) -> DataFrame:
    """(i, j, n) for all i <> j that share n groups."""
    return _both_ways(_half_pairs(edges)).select("i", "j", "n")


def _both_ways(half: DataFrame, *swapped: tuple[str, str]) -> DataFrame:
    """Rows (i, j, …) and the same as (j, i, …); pairs of columns in ``swapped`` change places too."""
    names = {"i": "j", "j": "i"} | dict(swapped) | {b: a for a, b in swapped}
    there, back = F.struct(*half.columns), F.struct(*[F.col(names.get(c, c)).alias(c) for c in half.columns])
    return half.select(F.explode(F.array(there, back)).alias("p")).select("p.*")


def _rank_key(n: Column, f: Column) -> Column:
    return F.floor(n * f * RANK_SCALE + 0.5)


def top_cooccurring(df: DataFrame, group: str, item: str, k: int, factor: Callable[[Column], Column],
                    score: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Top ``k`` partners of every item: (i, j, n_ij, score, puesto).

    For one item, partners are ranked by n_ij * factor(n_j), then lower partner id; ``score`` is what is reported
    and must follow that order. Group and item are whole numbers.
    """
    edges = cut_lineage(_edges(df, group, item))
    n = edges.groupBy("i").agg(F.count("*").alias("n_i"))
    nj = n.select(F.col("i").alias("j"), F.col("n_i").alias("n_j"))
    counted = _both_ways(_half_pairs(edges).join(n, "i").join(nj, "j"), ("n_i", "n_j"))
    scored = counted.select(
        "i", "j", F.col("n").alias("n_ij"), score(F.col("n"), F.col("n_i"), F.col("n_j")).alias("score"),
        _rank_key(F.col("n"), factor(F.col("n_j"))).alias("__r"))
    return top_per_group(scored, ["i"], [F.col("__r").desc(), F.col("j").asc()], k, "puesto").drop("__r")


def item_cooccurrence(events: DataFrame, k: int) -> DataFrame:
    """Neighbours by co-occurrence in users' histories, normalised by cosine."""
    return top_cooccurring(
        events, "usuario_id", "contenido_id", k, lambda n_j: 1.0 / F.sqrt(n_j.cast("double")),
        lambda n_ij, n_i, n_j: n_ij / F.sqrt((n_i * n_j).cast("double")))


def graph_neighbours(views: DataFrame, k: int) -> DataFrame:
    """Neighbours by two hops through a shared reader; the score is the share of the item's own readers."""
    return top_cooccurring(views, "usuario_id", "contenido_id", k, lambda n_j: F.lit(1.0), lambda n_ij, n_i, n_j: n_ij / n_i)


def related_tags(content_tags: DataFrame, tags: DataFrame, k: int) -> DataFrame:
    """Tags that share the most contents. ``tags`` numbers the tag names (etiqueta, etiqueta_id) in their order."""
    numbered = content_tags.join(tags, "etiqueta").select("contenido_id", "etiqueta_id")
    top = top_cooccurring(numbered, "contenido_id", "etiqueta_id", k, lambda n_j: F.lit(1.0), lambda n_ij, n_i, n_j: n_ij * F.lit(1.0))
    a, b = tags.toDF("etiqueta", "i"), tags.toDF("etiqueta_afin", "j")
    return top.join(a, "i").join(b, "j").select("etiqueta", "etiqueta_afin", F.col("n_ij").alias("comunes"), "puesto")


def neighbour_table(sources: dict[str, DataFrame]) -> DataFrame:
    """Unified similar-items table from frames with (i, j, score), keyed by source."""
    parts = [df.select(F.col("i").alias("contenido_id"), F.col("j").alias("contenido_similar_id"),
                       F.lit(name).alias("origen"), F.round(F.greatest("score", F.lit(0.0)), 6).alias("score"))
             for name, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def source_diversity(neighbour_rows: DataFrame, contents: DataFrame) -> DataFrame:
    """By source: items with neighbours, pairs, and distinct sections among an item's neighbours."""
    place = contents.select(F.col("id").alias("contenido_similar_id"), "seccion_id")
    per_item = neighbour_rows.join(place, "contenido_similar_id").groupBy("origen", "contenido_id").agg(
        F.count("*").alias("n"), F.countDistinct("seccion_id").alias("s"))
    return per_item.groupBy("origen").agg(
        F.count("*").alias("contenidos"), F.sum("n").alias("pares"),
        (F.sum("s") / F.count("*")).alias("secciones_por_contenido"))


# ---- graph ------------------------------------------------------------------------------------------

def _node(label: str, col: str) -> Column:
    return F.concat(F.lit(label), F.col(col).cast("string"))


def graph_nodes(users_with_plan: DataFrame, publishable: DataFrame, tree: DataFrame, tags: DataFrame) -> DataFrame:
    """Nodes (nodo, etiqueta, propiedades as JSON). A user node holds country and plan and nothing that identifies."""
    roots = tree.select("seccion_id", "seccion_raiz")

    def nodes(df: DataFrame, name: Column, label: str, *props) -> DataFrame:
        return df.select(name.alias("nodo"), F.lit(label).alias("etiqueta"), F.to_json(F.struct(*props)).alias("propiedades"))

    return reduce(DataFrame.unionByName, [
        nodes(users_with_plan, _node("U", "id"), "Usuario", F.col("id").alias("usuario_id"), "pais", "plan"),
        nodes(publishable.join(roots, "seccion_id", "left"), _node("C", "contenido_id"), "Contenido", "contenido_id", "titulo",
              "seccion", "seccion_raiz", F.col("tipo_contenido").alias("tipo"), "nivel_acceso", "fecha_publicacion"),
        nodes(tree, _node("S", "seccion_id"), "Seccion", "slug", "nombre", F.col("seccion_raiz").alias("raiz")),
        nodes(tags, _node("E", "etiqueta"), "Etiqueta", F.col("etiqueta").alias("nombre")),
    ])


def graph_edges(events: DataFrame, contents: DataFrame, content_tags: DataFrame, preferences: DataFrame,
                similar: DataFrame) -> DataFrame:
    """All relations, one row each: (origen, relacion, destino, veces, ultima_vez, completo, peso, fuente).

    ``peso`` is a tag's relevance or a similarity score, ``fuente`` the source of the similarity.
    """
    empty = {"veces": F.lit(1).cast("long"), "ultima_vez": F.lit(None).cast("timestamp_ntz"), "completo": F.lit(False),
             "peso": F.lit(None).cast("double"), "fuente": F.lit(None).cast("string")}

    def rel(df: DataFrame, a: Column, name: str, b: Column, **props: Column) -> DataFrame:
        values = {**empty, **props}
        return df.select(a.alias("origen"), F.lit(name).alias("relacion"), b.alias("destino"),
                         *[c.alias(n) for n, c in values.items()])

    user, content = _node("U", "usuario_id"), _node("C", "contenido_id")
    seen = events.filter(F.col("tipo_evento").isin("vista", "completado")).groupBy("usuario_id", "contenido_id").agg(
        F.count("*").alias("veces"), F.max("ocurrido_en").alias("ultima_vez"),
        F.max(F.col("tipo_evento") == "completado").alias("completo"))
    saved = events.filter(F.col("tipo_evento") == "guardado").select("usuario_id", "contenido_id").distinct()
    on_section = preferences.filter(F.col("seccion_id").isNotNull())
    return reduce(DataFrame.unionByName, [
        rel(seen, user, "VIO", content, veces=F.col("veces"), ultima_vez=F.col("ultima_vez"), completo=F.col("completo")),
        rel(saved, user, "GUARDO", content),
        rel(on_section.filter("tipo_preferencia = 'sigue'"), user, "SIGUE", _node("S", "seccion_id")),
        rel(on_section.filter("tipo_preferencia = 'no_interesa'"), user, "NO_LE_INTERESA", _node("S", "seccion_id")),
        rel(contents, _node("U", "autor_id"), "ESCRIBIO", _node("C", "id")),
        rel(contents, _node("C", "id"), "PERTENECE_A", _node("S", "seccion_id")),
        rel(content_tags, content, "TIENE_ETIQUETA", _node("E", "etiqueta"), peso=F.col("relevancia").cast("double")),
        rel(similar, content, "SIMILAR_A", _node("C", "contenido_similar_id"), peso=F.col("score").cast("double"),
            fuente=F.col("origen")),
    ])


def shortest_paths(edges: DataFrame, source: str, max_hops: int = 6) -> DataFrame:
    """Hops from one node to every node within ``max_hops``, with the lowest predecessor: (nodo, saltos, previo).

    Breadth-first search over undirected edges; each level is written to the shared folder, so a lost
    executor repeats one level and not the whole walk.
    """
    both = edges.select(F.col("origen").alias("a"), F.col("destino").alias("b"))
    both = cut_lineage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    start = both.sparkSession.createDataFrame([(source, 0, None)], "nodo string, saltos int, previo string")
    visited, frontier = start, start
    for hop in range(1, max_hops + 1):
        step = (frontier.select(F.col("nodo").alias("a")).join(both, "a")
                .groupBy(F.col("b").alias("nodo")).agg(F.min("a").alias("previo"))
                .join(visited.select("nodo"), "nodo", "left_anti")
                .select("nodo", F.lit(hop).alias("saltos"), "previo"))
        frontier = cut_lineage(step)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def path_to(paths: DataFrame, target: str, max_hops: int = 6) -> DataFrame:
    """The nodes on the path to one target, walking predecessors back: at most ``max_hops`` + 1 rows."""
    step = paths.filter(F.col("nodo") == target)
    out = step
    for _ in range(max_hops):
        back = step.select(F.col("previo").alias("nodo"))
        step = paths.join(back, "nodo", "left_semi")
        out = out.unionByName(step)
    return out


def co_view_recommendations(views: DataFrame, k: int | None, explain: bool = True, readers: DataFrame | None = None) -> DataFrame:
    """Per user, unseen contents by number of user-content-reader-content paths: (u, j, caminos, puesto, via).

    Paths are counted as the sum, over the user's contents, of the readers each shares with the candidate: items
    are paired first, so users are never paired with users. ``readers`` (views) are all whose reading counts, if lists are
    wanted only for the users of ``views``. With ``k`` None: every candidate, unranked.
    """
    edges = cut_lineage(_edges(views, "usuario_id", "contenido_id"))
    pairs = cut_lineage(_pairs(edges if readers is None else cut_lineage(_edges(readers, "usuario_id", "contenido_id"))))
    seen = edges.select(F.col("g").alias("u"), "i")
    scored = sparse_product(edges.select(F.col("g").alias("r"), F.col("i").alias("k"), F.lit(1).cast("long").alias("x")),
                            pairs.select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("n").alias("y")))
    scored = scored.select(F.col("r").alias("u"), F.col("c").alias("j"), F.col("n").alias("caminos"))
    unseen = scored.join(seen.select("u", F.col("i").alias("j")), ["u", "j"], "left_anti")
    if k is None:
        return unseen
    top = top_per_group(unseen, ["u"], [F.col("caminos").desc(), F.col("j").asc()], k, "puesto")
    if not explain:
        return top
    # Explanation, only for what is shown: the content of the user's own list that brings most paths.
    steps = top.join(seen, "u").join(pairs, ["i", "j"], "left")
    return steps.groupBy("u", "j", "caminos", "puesto").agg(
        F.max_by("i", F.struct(F.coalesce("n", F.lit(0)).alias("t"), (-F.col("i")).alias("d"))).alias("via"))


def bridge_contents(views: DataFrame, contents: DataFrame) -> DataFrame:
    """How a content links its section to others: readers shared and paths per other section.

    Each reader is summed up by section first, so contents are never paired inside a reader's history.
    """
    place = contents.select(F.col("id").alias("contenido_id"), "seccion_id")
    seen = views.select("usuario_id", "contenido_id").distinct().join(place, "contenido_id")
    per_section = seen.groupBy("usuario_id", F.col("seccion_id").alias("seccion_destino")).agg(F.count("*").alias("n"))
    return (seen.join(per_section, "usuario_id").filter(F.col("seccion_id") != F.col("seccion_destino"))
            .groupBy("contenido_id", "seccion_id", "seccion_destino")
            .agg(F.count("*").alias("lectores"), F.sum("n").alias("caminos")))


def cold_start_similar(contents: DataFrame, content_tags: DataFrame, views: DataFrame, k: int) -> DataFrame:
    """For contents nobody has seen: the seen contents sharing most tags, then with most readers.

    Contents are grouped by their set of tags; sets are compared once, and only the ``k`` most read contents
    of each set can appear in a list. The number of distinct sets follows the editorial vocabulary.
    """
    readers = views.select("usuario_id", "contenido_id").distinct().groupBy("contenido_id").agg(
        F.count("*").alias("lectores"))
    sets = content_tags.groupBy("contenido_id").agg(F.sort_array(F.collect_set("etiqueta")).alias("tags"))
    known = sets.join(readers, "contenido_id")
    new = contents.select(F.col("id").alias("contenido_id")).join(readers, "contenido_id", "left_anti").join(
        sets, "contenido_id")
    best = top_per_group(known, ["tags"], [F.col("lectores").desc(), F.col("contenido_id").asc()], k, "__p").select(
        F.col("tags").alias("t2"), F.col("contenido_id").alias("parecido_id"), "lectores")
    a = new.select("tags").distinct().select("tags", F.explode("tags").alias("e"))
    b = best.select("t2").distinct().select("t2", F.explode("t2").alias("e"))
    linked = a.join(b, "e").groupBy("tags", "t2").agg(F.count("*").alias("comunes"))
    lists = top_per_group(linked.join(best, "t2"), ["tags"], [
        F.col("comunes").desc(), F.col("lectores").desc(), F.col("parecido_id").asc()], k, "puesto")
    return new.join(lists, "tags").select("contenido_id", "parecido_id", "comunes", "lectores", "puesto")


# ---- blends -------------------------------------------------------------------------------------------

def from_neighbours(seen: DataFrame, neighbour_rows: DataFrame, k: int | None) -> DataFrame:
    """Per user, unseen contents by the summed score of being a neighbour of what was seen: (u, j, score); all of them if
    ``k`` is None."""
    have = seen.select(F.col("usuario_id").alias("u"), F.col("contenido_id").alias("i")).distinct()
    scored = have.join(neighbour_rows.select("i", "j", "score"), "i").groupBy("u", "j").agg(
        F.round(F.sum("score"), 6).alias("score"))
    unseen = scored.join(have.select("u", F.col("i").alias("j")), ["u", "j"], "left_anti")
    return unseen if k is None else top_per_group(unseen, ["u"], [F.col("score").desc(), F.col("j").asc()], k, "puesto")


def eligible_top(whole: dict[str, DataFrame], lists: dict[str, Callable[[DataFrame | None, int], DataFrame]],
                 eligible: Callable[[DataFrame], DataFrame], n: int) -> DataFrame:
    """The ``n`` best eligible candidates of every strategy and user: (s, u, j, score).

    ``whole`` has all candidates (u, j, score) of a strategy. ``lists`` has functions of (users, size) that give the ``size``
    best of the users (u; None: all) from a list that can be read to any depth. Users who have fewer than ``n`` left after the
    filter, and whose list goes on, are read again eight times as deep; nobody else is. The filter runs once a round over all
    strategies. Each round is written, and the depth grows to the whole list, so nothing eligible is missed however many
    candidates are refused.
    """
    def named(parts: dict[str, DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [df.select(F.lit(s).alias("s"), "u", "j", F.col("score").cast("double").alias("score"))
                                              for s, df in parts.items()])

    size, users, done = 4 * n, None, []
    while True:
        read = {s: fetch(None if users is None else users.where(F.col("s") == s).select("u"), size) for s, fetch in lists.items()}
        got = cut_lineage(named(read if done else whole | read))
        best = cut_lineage(top_per_group(eligible(got), ["s", "u"], [F.col("score").desc(), F.col("j").asc()], n, "puesto").drop("puesto"))
        full = got.where(F.col("s").isin(*lists)).groupBy("s", "u").agg(F.count("*").alias("n")).where(F.col("n") >= size).select("s", "u")
        enough = best.groupBy("s", "u").agg(F.count("*").alias("n")).where(F.col("n") >= n).select("s", "u")
        short = cut_lineage(full.join(enough, ["s", "u"], "left_anti"))
        more = {r.s for r in short.select("s").distinct().collect()}
        if not more:
            return reduce(DataFrame.unionByName, [*done, best])
        done.append(best.join(short, ["s", "u"], "left_anti"))
        users, size, lists = short, 8 * size, {s: f for s, f in lists.items() if s in more}


def blend(signals: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of the strategies' own top lists (u, j, score), each scaled to 0..1."""
    return blend_lists(reduce(DataFrame.unionByName, [df.select(F.lit(s).alias("s"), "u", "j", "score") for s, df in signals.items()]), weights)


def blend_lists(lists: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """As ``blend``, of one table (s, u, j, score) of all strategies' lists."""
    w = weights or HYBRID_WEIGHTS
    span = lists.groupBy("s", "u").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    weight = F.create_map(*[F.lit(x) for pair in w.items() for x in pair])[F.col("s")]
    return lists.join(span, ["s", "u"]).groupBy("u", "j").agg(F.round(F.sum(scaled * weight), 6).alias("score"))


def reciprocal_rank_fusion(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Fuse ranked lists (q, j, puesto) by the sum of 1 / (constant + rank)."""
    every = reduce(DataFrame.unionByName, [df.select("q", "j", "puesto") for df in lists])
    fused = every.groupBy("q", "j").agg(
        F.round(F.sum(1.0 / (F.col("puesto") + constant)), 8).alias("score"), F.count("*").alias("listas"))
    return top_per_group(fused, ["q"], [F.col("score").desc(), F.col("j").asc()], k, "puesto")


def list_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per query, sizes of two result lists (q, j) and of their intersection."""
    na = a.groupBy("q").agg(F.count("*").alias("primera"))
    nb = b.groupBy("q").agg(F.count("*").alias("segunda"))
    both = a.select("q", "j").intersect(b.select("q", "j")).groupBy("q").agg(F.count("*").alias("comunes"))
    zero = F.lit(0)
    return na.join(nb, "q", "full_outer").join(both, "q", "left").select(
        "q", F.coalesce("primera", zero).alias("primera"), F.coalesce("segunda", zero).alias("segunda"),
        F.coalesce("comunes", zero).alias("comunes"))
