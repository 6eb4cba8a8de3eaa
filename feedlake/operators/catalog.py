"""Catalogue rules: publishable contents, section tree, feeds, vetoes, access levels, keep-unmatched reports.

No join here carries a broadcast hint. Spark broadcasts a side only below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond it, with skewed partitions split at run time.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import expressions as E
from feedlake.functions.ordering import top_per_group
from feedlake.session import cut_lineage

VETO = "no_interesa"
#: Users and contents of one term in a block, pairs that one row stands for (and ids handed on at a time), contents in a stripe. A Parquet
#: writer packs 504 values at a time and keeps 131 072 ids of a row group in its dictionary: a stripe is a third of the one, so that the
#: same stripe for one user after another compresses well, and the ids of the 16 blocks in a row group are fewer than the other.
VETO_USERS, VETO_CONTENTS, VETO_ROWS, VETO_STRIPE = 8_064, 8_064, 32_256, 168


def publishable_filter(as_of):
    """Row predicate: published, already out, not expired at ``as_of``."""
    now = E.literal_ts(as_of)
    return (
        (F.col("estado") == "publicado")
        & (F.col("fecha_publicacion") <= now)
        & (F.col("vigente_hasta").isNull() | (F.col("vigente_hasta") > now))
    )


def publishable_contents(contents: DataFrame, types: DataFrame, sections: DataFrame, as_of) -> DataFrame:
    """Publishable contents with type and section resolved; unresolved rows drop out."""
    t = types.select(F.col("id").alias("tipo_contenido_id"), F.col("codigo").alias("tipo_contenido"))
    s = sections.select(F.col("id").alias("seccion_id"), F.col("slug").alias("seccion_slug"),
                        F.col("nombre").alias("seccion"))
    keep = ["titulo", "bajada", "nivel_acceso", "idioma", "duracion_seg", "fecha_publicacion", "vigente_hasta",
            "metadatos", "autor_id"]
    return (
        contents.filter(publishable_filter(as_of))
        .join(t, "tipo_contenido_id")
        .join(s, "seccion_id")
        .select(F.col("id").alias("contenido_id"), *[c for c in keep if c in contents.columns],
                "tipo_contenido", "seccion_id", "seccion_slug", "seccion")
    )


def _lineage(sections: DataFrame) -> DataFrame:
    """(id, ids, nombres): every section with the chain from its root down to itself. Cycles have no root."""
    return sections.sparkSession.sql(
        """
        WITH RECURSIVE linaje AS (
            SELECT id, array(id) AS ids, array(nombre) AS nombres FROM {sections} WHERE seccion_padre_id IS NULL
            UNION ALL
            SELECT hija.id, array_append(l.ids, hija.id), array_append(l.nombres, hija.nombre)
            FROM linaje l INNER JOIN {sections} hija ON hija.seccion_padre_id = l.id
        )
        SELECT id, ids, nombres FROM linaje
        """, sections=sections)


def section_tree(sections: DataFrame) -> DataFrame:
    """Depth, root and path of every section reachable from a root, all read off its chain."""
    chain = _lineage(sections).select(
        F.col("id").alias("seccion_id"), F.size("ids").alias("profundidad"),
        F.element_at("ids", 1).alias("seccion_raiz_id"), F.element_at("nombres", 1).alias("seccion_raiz"),
        F.array_join("nombres", " > ").alias("camino"))
    own = sections.select(F.col("id").alias("seccion_id"), "slug", "nombre", "seccion_padre_id")
    return own.join(chain, "seccion_id").select(
        "seccion_id", "slug", "nombre", "seccion_padre_id", "profundidad", "seccion_raiz_id", "seccion_raiz", "camino")


def outside_tree(contents: DataFrame, tree: DataFrame) -> DataFrame:
    """Contents whose section cannot be reached from a root."""
    return contents.join(tree.select("seccion_id"), "seccion_id", "left_anti")


def within_level(contents: DataFrame, level: int) -> DataFrame:
    return contents.filter(F.col("nivel_acceso") <= level)


def visible_count_by_user(contents: DataFrame, levels: DataFrame) -> DataFrame:
    """Contents each user's level opens, per content level first so that no user-content pair is built."""
    per_level = contents.groupBy(F.col("nivel_acceso").alias("de")).agg(F.count(F.lit(1)).alias("n"))
    # A handful of rows on either side: one for each level in use.
    steps = levels.select(F.col("nivel_acceso").alias("nivel")).distinct().join(per_level, F.col("de") <= F.col("nivel"))
    opened = steps.groupBy("nivel").agg(F.sum("n").alias("contenidos_visibles"))
    return levels.join(opened, levels.nivel_acceso == opened.nivel, "left").select(
        "usuario_id", "nivel_acceso", F.coalesce("contenidos_visibles", F.lit(0)).alias("contenidos_visibles"))


def chronological_feed(contents: DataFrame, n: int, section_id: int | None = None,
                       level: int | None = None) -> DataFrame:
    """Newest published contents, optionally of one section and up to one access level."""
    out = contents.filter((F.col("estado") == "publicado") & F.col("fecha_publicacion").isNotNull())
    if section_id is not None:
        out = out.filter(F.col("seccion_id") == section_id)
    if level is not None:
        out = within_level(out, level)
    return out.orderBy(F.col("fecha_publicacion").desc(), F.col("id").asc()).limit(n)


def metadata_contains(df: DataFrame, column: str, pairs: dict[str, str]) -> DataFrame:
    return df.filter(E.json_contains(F.col(column), pairs))


def metadata_has_key(df: DataFrame, column: str, key: str) -> DataFrame:
    return df.filter(E.json_has_key(F.col(column), key))


def between_instants(impressions: DataFrame, low, high) -> DataFrame:
    """Half-open time range. With a month partition column present, both predicates reach the scan."""
    lo, hi = E.literal_ts(low), E.literal_ts(high)
    out = impressions.filter((F.col("mostrado_en") >= lo) & (F.col("mostrado_en") < hi))
    if "mes" in impressions.columns:
        out = out.filter((F.col("mes") >= E.month_text(lo)) & (F.col("mes") <= E.month_text(hi)))
    return out


def retained(df: DataFrame, ts: str, as_of, days: int) -> DataFrame:
    return df.filter(F.col(ts) >= E.literal_ts(as_of) - F.make_dt_interval(F.lit(days)))


def moderator_inbox(comments: DataFrame) -> DataFrame:
    return comments.filter(F.col("estado_moderacion") == "pendiente").orderBy("creado_en", "comentario_id")


def with_block_of_type(bodies: DataFrame, kind: str) -> DataFrame:
    return bodies.filter(F.exists("bloques", lambda b: b["tipo"] == kind))


def playable(contents: DataFrame, types: DataFrame) -> DataFrame:
    t = types.filter("admite_duracion").select(F.col("id").alias("tipo_contenido_id"),
                                               F.col("codigo").alias("tipo_contenido"))
    return contents.filter(F.col("duracion_seg").isNotNull()).join(t, "tipo_contenido_id")


# ---- users: levels, history, gates --------------------------------------------------------------

def access_level_now(users: DataFrame, subscriptions: DataFrame, plans: DataFrame, as_of) -> DataFrame:
    """Highest level among the subscriptions that are active and in date; 0 where there is none."""
    now = E.literal_ts(as_of)
    valid = subscriptions.filter(
        (F.col("estado") == "activa") & (F.col("desde") <= now)
        & (F.col("hasta").isNull() | (F.col("hasta") > now)))
    p = plans.select(F.col("id").alias("plan_id"), "nivel_acceso")
    best = valid.join(p, "plan_id").groupBy("usuario_id").agg(F.max("nivel_acceso").alias("nivel_acceso"))
    return users.select(F.col("id").alias("usuario_id")).join(best, "usuario_id", "left").select(
        "usuario_id", F.coalesce("nivel_acceso", F.lit(0)).alias("nivel_acceso"))


def access_level_at(facts: DataFrame, ts: str, subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """Level each fact's user had at the fact's own instant (half-open validity); adds ``nivel_entonces``.

    The range condition is turned into an equi-join on (user, month): every interval is listed once per
    month it touches, within the months the facts cover. Facts are reduced to distinct (user, instant)
    first, so a busy user neither multiplies rows nor lands in one task.
    """
    moments = facts.select("usuario_id", F.col(ts).alias("__t")).distinct()
    span = facts.agg(F.struct(F.trunc(F.min(ts).cast("date"), "month").alias("lo"),
                              F.trunc(F.max(ts).cast("date"), "month").alias("hi")).alias("span")).scalar()
    lo, hi = span["lo"], span["hi"]
    p = plans.select(F.col("id").alias("plan_id"), "nivel_acceso")
    start = F.greatest(F.trunc(F.col("desde").cast("date"), "month"), lo)
    end = F.least(F.coalesce(F.trunc(F.col("hasta").cast("date"), "month"), hi), hi)
    intervals = (
        subscriptions.join(p, "plan_id").select("usuario_id", "nivel_acceso", "desde", "hasta",
                                                start.alias("a"), end.alias("b"))
        .filter(F.col("a") <= F.col("b"))
        .withColumn("__m", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))))
        .drop("a", "b")
    )
    keyed = moments.withColumn("__m", F.trunc(F.col("__t").cast("date"), "month"))
    hit = keyed.join(intervals, ["usuario_id", "__m"]).filter(
        (F.col("desde") <= F.col("__t")) & (F.col("hasta").isNull() | (F.col("__t") < F.col("hasta"))))
    level = hit.groupBy("usuario_id", "__t").agg(F.max("nivel_acceso").alias("nivel_entonces"))
    joined = facts.join(level.withColumnRenamed("usuario_id", "__u"),
                        (F.col("usuario_id") == F.col("__u")) & (F.col(ts) == F.col("__t")), "left")
    return joined.withColumn("nivel_entonces", F.coalesce("nivel_entonces", F.lit(0))).drop("__u", "__t")


def latest_per_user(impressions: DataFrame, ts: str, ident: str, n: int) -> DataFrame:
    return top_per_group(impressions, ["usuario_id"], [F.col(ts).desc(), F.col(ident).desc()], n, "orden")


def cold_users(users: DataFrame, events: DataFrame, minimum: int = 4) -> DataFrame:
    """Every user with the number of distinct contents; ``frio`` where it is below ``minimum``."""
    seen = events.groupBy("usuario_id").agg(F.countDistinct("contenido_id").alias("contenidos_distintos"))
    return users.select(F.col("id").alias("usuario_id")).join(seen, "usuario_id", "left").select(
        "usuario_id", F.coalesce("contenidos_distintos", F.lit(0)).alias("contenidos_distintos"),
        (F.coalesce("contenidos_distintos", F.lit(0)) < minimum).alias("frio"))


def consenting(users: DataFrame) -> DataFrame:
    return users.filter("consentimiento_personalizacion").select(F.col("id").alias("usuario_id"))


# ---- vetoes -------------------------------------------------------------------------------------

def section_descendants(sections: DataFrame) -> DataFrame:
    """(ancestor, section) pairs over the whole tree, each section paired with itself too."""
    return _lineage(sections).select(F.explode("ids").alias("antepasado_id"), F.col("id").alias("seccion_id"))


def _veto_sections(preferences: DataFrame, descendants: DataFrame | None) -> DataFrame:
    own = preferences.filter((F.col("tipo_preferencia") == VETO) & F.col("seccion_id").isNotNull()).select(
        "usuario_id", "seccion_id")
    if descendants is not None:
        own = own.withColumnRenamed("seccion_id", "antepasado_id").join(descendants, "antepasado_id").select(
            "usuario_id", "seccion_id")
    return own.distinct()


def _veto_tags(preferences: DataFrame) -> DataFrame:
    return preferences.filter((F.col("tipo_preferencia") == VETO) & F.col("etiqueta").isNotNull()).select(
        "usuario_id", "etiqueta").distinct()


def _veto_terms(preferences: DataFrame) -> DataFrame:
    """(usuario_id, termino): what each user vetoes, a section or a tag, as one text."""
    sections = _veto_sections(preferences, None).select("usuario_id", _term("s", "seccion_id"))
    return sections.unionByName(_veto_tags(preferences).select("usuario_id", _term("t", "etiqueta")))


def _content_terms(contents: DataFrame, content_tags: DataFrame, descendants: DataFrame | None) -> DataFrame:
    """(contenido_id, termino): by which vetoes each content is covered. With ``descendants``: by those of every ancestor."""
    place = contents.select(F.col("id").alias("contenido_id"), "seccion_id")
    if descendants is not None:
        place = place.join(descendants, "seccion_id").select("contenido_id", F.col("antepasado_id").alias("seccion_id"))
    tagged = content_tags.select("contenido_id", _term("t", "etiqueta"))
    return place.select("contenido_id", _term("s", "seccion_id")).unionByName(tagged).filter("termino IS NOT NULL")


def _term(kind: str, column: str) -> Column:
    return F.concat(F.lit(kind), F.col(column).cast("string")).alias("termino")


def _dealt(terms: DataFrame, ident: str, part: str, size: int) -> DataFrame:
    """(termino, part, parts, menores, ids): the ids of each term, those with the same lesser terms in lists; parts have about ``size`` ids."""
    whole = terms.groupBy(ident).agg(F.array_sort(F.collect_set("termino")).alias("todos"))
    each = whole.select(F.col(ident).alias("id"), F.posexplode("todos").alias("n", "termino"), "todos").select(
        "id", "termino", F.slice("todos", F.lit(1), F.col("n")).alias("menores"))
    few = min(size, VETO_STRIPE)
    lists = each.groupBy("termino").agg(F.ceil(F.count("*") / few).cast("int").alias("listas"))
    of = F.floor(F.col("lista") / (size // few)).cast("int")
    listed = each.join(lists, "termino").withColumn("lista", F.pmod(F.xxhash64("id"), F.col("listas")).cast("int")).groupBy(
        "termino", "lista", "listas", "menores").agg(F.array_sort(F.collect_list(F.struct("id"))["id"]).alias("ids"))
    return listed.select("termino", of.alias(part), F.ceil(F.col("listas") / (size // few)).cast("int").alias(f"{part}s"), "menores", "ids")


def _alike(side: list[pa.RecordBatch]) -> tuple[pa.Array, dict[tuple, np.ndarray]]:
    """The ids of one side of a block, and their places by their list of lesser terms."""
    places: dict[tuple, list[np.ndarray]] = {}
    stop = 0
    for batch in side:
        for terms, n in zip(batch.column("menores").to_pylist(), batch.column("ids").value_lengths().to_pylist(), strict=True):
            places.setdefault(tuple(terms), []).append(np.arange(stop, stop + n))
            stop += n
    return pa.concat_arrays([x.column("ids").flatten() for x in side]), {terms: np.concatenate(at) for terms, at in places.items()}


def _pair_up(batches):
    """Lists of users and of contents, to be paired each with each: the pairs of a block that share no lesser term."""
    key, sides = None, ([], [])
    for batch in batches:
        if not batch.num_rows:
            continue
        term = batch.column("termino").dictionary_encode()
        marks = np.stack([np.asarray(x).astype(np.int64) for x in (term.indices, *(batch.column(c) for c in ("c", "u", "usuario")))])
        cuts = np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(axis=0)])
        for at, stop in itertools.pairwise([*cuts, batch.num_rows]):
            here = (term.dictionary[marks[0, at]].as_py(), marks[1, at], marks[2, at])
            if here != key:
                yield from _block(*sides)
                key, sides = here, ([], [])
            sides[marks[3, at]].append(batch.slice(at, stop - at))
    yield from _block(*sides)


def _block(items: list[pa.RecordBatch], users: list[pa.RecordBatch]):
    """One stripe of contents after the other, with the users to whom the same of it are open."""
    if not items or not users:
        return
    (ids, covered), (people, vetoed) = _alike(items), _alike(users)
    order, terms = np.concatenate(list(covered.values())), [t for t, at in covered.items() for _ in at]
    made, held = [], 0
    for first in range(0, len(order), VETO_STRIPE):
        stripe, shared = order[first:first + VETO_STRIPE], {}
        for i, lesser in enumerate(terms[first:first + VETO_STRIPE]):
            for term in lesser:
                shared.setdefault(term, []).append(i)
        closed: dict[tuple, list[np.ndarray]] = {}
        for lesser, who in vetoed.items():
            closed.setdefault(tuple(sorted({i for term in lesser for i in shared.get(term, ())})), []).append(who)
        for some, who in closed.items():
            mine, who = np.delete(stripe, some), np.concatenate(who)
            step = max(1, VETO_ROWS // max(len(mine), 1))
            for i in range(0, len(who) if len(mine) else 0, step):
                made.append((who[i:i + step], mine))
                held += len(made[-1][0]) + len(mine)
                if held >= VETO_ROWS:
                    yield _lists(people, ids, made)
                    made, held = [], 0
    if made:
        yield _lists(people, ids, made)


def _lists(people: pa.Array, ids: pa.Array, made: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    def taken(values: pa.Array, places: tuple[np.ndarray, ...]) -> pa.Array:
        return pa.ListArray.from_arrays(np.cumsum([0, *map(len, places)], dtype=np.int32), values.take(pa.array(np.concatenate(places))))

    users, contents = zip(*made, strict=True)
    return pa.RecordBatch.from_arrays([taken(people, users), taken(ids, contents)], ["usuarios", "contenidos"])


def user_vetoes(preferences: DataFrame, contents: DataFrame, content_tags: DataFrame,
                descendants: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """All (user, content) pairs a user must not receive, by exact section or by tag, each once.

    With ``descendants`` (see ``section_descendants``) given, a section veto also covers every section below it. With
    ``among`` (usuario_id, contenido_id) given: only the pairs found there, work proportional to them; NULL ids match.

    Users and contents meet at the terms (section or tag) they share, a block of users with a block of contents. A pair that
    shares several terms is made at the least of them only, as each list of ids names its lesser terms; so pairs are unique as they
    are made and are never shuffled. What is shuffled is lists of users, once for each block of contents, and of contents, once for each
    block of users. Pairs leave a task a stripe of contents at a time, the same for many users, so that files of them stay small.
    """
    vetoed, covered = _veto_terms(preferences), _content_terms(contents, content_tags, descendants)
    if among is not None:
        asked = among.select("usuario_id", "contenido_id").distinct()
        terms = asked.join(covered.toDF("__c", "__t"), F.col("contenido_id").eqNullSafe(F.col("__c"))).drop("__c")
        mine = vetoed.toDF("__u", "termino")
        return terms.join(mine, F.col("usuario_id").eqNullSafe(F.col("__u")) & (F.col("__t") == F.col("termino")), "left_semi").select(
            "usuario_id", "contenido_id").distinct()
    users = cut_lineage(_dealt(vetoed, "usuario_id", "u", VETO_USERS))
    covered = covered.join(users.select("termino").distinct(), "termino", "left_semi")
    items = cut_lineage(_dealt(covered, "contenido_id", "c", VETO_CONTENTS))
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    ahead = users.join(items.select("termino", F.col("cs").alias("n")).distinct(), "termino").withColumn("c", every)
    held = items.join(users.select("termino", F.col("us").alias("n")).distinct(), "termino").withColumn("u", every)
    columns = ["termino", "c", "u", "usuario", "ids", "menores"]
    rows = held.withColumn("usuario", F.lit(0)).select(columns).union(ahead.withColumn("usuario", F.lit(1)).select(columns))
    # A given number of partitions: they must not be merged by their bytes, which say nothing about the pairs. By range: each task has
    # as many blocks, next to each other, so that its files name few ids.
    tasks = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spot = ["termino", "c", "u"]
    kinds = f"usuarios {users.schema['ids'].dataType.simpleString()}, contenidos {items.schema['ids'].dataType.simpleString()}"
    lists = rows.repartitionByRange(tasks, *spot).sortWithinPartitions(*spot, "usuario").mapInArrow(_pair_up, kinds)
    return lists.select(F.explode("usuarios").alias("usuario_id"), "contenidos").select("usuario_id", F.explode("contenidos").alias("contenido_id"))


def without_vetoed(candidates: DataFrame, preferences: DataFrame, contents: DataFrame,
                   content_tags: DataFrame, descendants: DataFrame | None = None) -> DataFrame:
    """Candidates (user, content, …) minus the user's vetoes, work proportional to the candidates."""
    section = contents.select(F.col("id").alias("contenido_id"), F.col("seccion_id").alias("__sec"))
    vs = _veto_sections(preferences, descendants).withColumnRenamed("seccion_id", "__sec")
    kept = candidates.join(section, "contenido_id", "left").join(vs, ["usuario_id", "__sec"], "left_anti").drop("__sec")
    vt = _veto_tags(preferences)
    tagged = (kept.select("usuario_id", "contenido_id").join(vt.select("usuario_id").distinct(), "usuario_id", "left_semi")
              .join(content_tags.select("contenido_id", "etiqueta"), "contenido_id")
              .join(vt, ["usuario_id", "etiqueta"], "left_semi").select("usuario_id", "contenido_id").distinct())
    return kept.join(tagged, ["usuario_id", "contenido_id"], "left_anti")


def without_seen(candidates: DataFrame, events: DataFrame) -> DataFrame:
    return candidates.join(events.select("usuario_id", "contenido_id").distinct(),
                           ["usuario_id", "contenido_id"], "left_anti")


# ---- lookups and unmatched reports ---------------------------------------------------------------

def enrich(ids: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue fields for ids that come from another store; ids that are not publishable drop out."""
    return ids.join(catalogue, "contenido_id")


def tags_of_contents(contents: DataFrame, content_tags: DataFrame) -> DataFrame:
    return contents.select(F.col("id").alias("contenido_id"), "titulo").join(content_tags, "contenido_id")


def resolve_moderations(moderations: DataFrame, contents: DataFrame, comments: DataFrame) -> DataFrame:
    """Attach the moderated object: a content title or a comment text, NULL where it does not exist."""
    c = contents.select(F.col("id").alias("contenido_id"), F.col("titulo").alias("objeto"))
    on_content = moderations.filter(F.col("objeto_tipo") == "contenido").join(c, "contenido_id", "left")
    k = comments.select(F.col("comentario_id").cast("string").alias("objeto_id"), F.col("texto").alias("objeto"))
    on_comment = moderations.filter(F.col("objeto_tipo") == "comentario").join(k, "objeto_id", "left")
    cols = ["id", "objeto_tipo", "objeto_id", "accion", "objeto"]
    return on_content.select(*cols).unionByName(on_comment.select(*cols))


def activity_with_idle(users: DataFrame, events: DataFrame) -> DataFrame:
    n = events.groupBy("usuario_id").agg(F.count(F.lit(1)).alias("eventos"))
    return users.select(F.col("id").alias("usuario_id")).join(n, "usuario_id", "left").select(
        "usuario_id", F.coalesce("eventos", F.lit(0)).alias("eventos"))


def never_shown(contents: DataFrame, impressions: DataFrame) -> DataFrame:
    return contents.select(F.col("id").alias("contenido_id"), "titulo").join(
        impressions.select("contenido_id").distinct(), "contenido_id", "left_anti")
