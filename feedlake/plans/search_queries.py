"""Queries: literal search, fusion with semantic search, overlap of result lists."""

from pyspark.sql import functions as F

from feedlake.operators import recommend as R
from feedlake.operators import search as S
from feedlake.operators import vectors as V
from feedlake.plans.catalog_queries import publishable
from feedlake.plans.registry import query

# Parameters of the searches: what a reader typed.
SEARCHES = [(1, "ción mente"), (2, "chelle tione"), (3, "mercados ados"), (4, "ring large"), (5, "eaux tion")]


def _stem(word: str) -> str:
    return f"CASE WHEN length({word}) >= 5 THEN regexp_replace({word}, '(es|s)$', '') ELSE {word} END"


def _words(source: str) -> str:
    return f"""(SELECT id, {_stem('w')} AS termino FROM (SELECT id, unnest(list_filter(regexp_split_to_array(lower(texto),
        '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS w FROM {source}))"""


def search_sql(docs: str, searches: str, k: int) -> str:
    return f"""
        SELECT q, j, score, puesto FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, j) AS puesto FROM (
            SELECT t.q, h.id AS j, round(sum((1 + ln(h.tf::DOUBLE)) * ln(1.0::DOUBLE + n.n / f.df)), 6) AS score
            FROM (SELECT DISTINCT id AS q, termino FROM {_words(searches)}) t
            JOIN (SELECT id, termino, count(*) AS tf FROM {_words(docs)} GROUP BY 1, 2) h USING (termino)
            JOIN (SELECT termino, count(DISTINCT id)::DOUBLE AS df FROM {_words(docs)} GROUP BY 1) f USING (termino),
            (SELECT count(*) AS n FROM {docs}) n GROUP BY 1, 2)) WHERE puesto <= {k}"""


_VALUES = "(SELECT * FROM (VALUES " + ", ".join(f"({q}, '{t}')" for q, t in SEARCHES) + ") v(id, texto))"
_TITLES = "(SELECT id, titulo || ' ' || coalesce(bajada, '') AS texto FROM contenidos)"
_BODIES = "(SELECT doc_id AS id, text AS texto FROM documents)"
_TAGS = "(SELECT DISTINCT etiqueta AS id, etiqueta AS texto FROM contenidos_etiquetas)"
_PUB = "(SELECT contenido_id AS id, titulo || ' ' || coalesce(bajada, '') AS texto FROM publicables)"
LITERAL_SQL = search_sql(_PUB, _TAGS, 20)
SEMANTIC_SQL = f"""
    SELECT q, j, puesto FROM (SELECT c.q, e.contenido_id AS j, row_number() OVER (PARTITION BY c.q
        ORDER BY round(list_cosine_similarity(c.v, e.embedding), 6) DESC, e.contenido_id) AS puesto
    FROM (SELECT q, list(x ORDER BY pos) AS v FROM (SELECT t.etiqueta AS q, pos, sum(x) AS x FROM contenidos_etiquetas t
        JOIN (SELECT contenido_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings_c) e
          ON e.contenido_id = t.contenido_id GROUP BY 1, 2) GROUP BY 1) c,
        embeddings_c e WHERE e.contenido_id IN (SELECT contenido_id FROM publicables)) WHERE puesto <= 20"""


def _searches(d):
    return d.spark.createDataFrame(SEARCHES, "q long, texto string")


def _text_of(df, ident):
    return df.select(F.col(ident).alias("id"), F.concat_ws(" ", "titulo", F.coalesce("bajada", F.lit(""))).alias("texto"))


@query("r12_literal_search_titles", search_sql(_TITLES, _VALUES, 10))
def _(d):
    return S.literal_search(_text_of(d.contenidos, "id"), _searches(d), 10)


@query("r12_literal_search_bodies", search_sql(_BODIES, _VALUES, 10))
def _(d):
    docs = d.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("texto"))
    return S.literal_search(docs, _searches(d), 10)


@query("r12_inverted_index", f"""
    SELECT termino, count(DISTINCT id) AS documentos, count(*) AS apariciones FROM {_words(_BODIES)} GROUP BY 1""")
def _(d):
    docs = d.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("texto"))
    return S.postings(docs, None).groupBy("termino").agg(
        F.count("*").alias("documentos"), F.sum("tf").alias("apariciones"))


def _lists(d):
    """Literal and semantic lists of every tag: the tag as text, and the centroid of the contents that carry it."""
    pub = publishable(d)
    tags = d.contenidos_etiquetas.select(F.col("etiqueta").alias("q"), F.col("etiqueta").alias("texto")).distinct()
    literal = S.literal_search(_text_of(pub, "contenido_id"), tags, 20, language=None)
    numbered = tags.select("q", F.xxhash64("q").alias("id"))
    centroid = V.group_centroids(d.contenidos_etiquetas.join(numbered.select(F.col("q").alias("etiqueta"), "id"), "etiqueta"),
                                 d.embeddings, "id")
    found = V.nearest(V.as_queries(centroid, "id", "embedding"), V.as_base(d.embeddings, pub), 20)
    semantic = found.join(numbered, "id").select("q", F.col("other").alias("j"), "puesto")
    return literal, semantic


@query("r11_rank_fusion", f"""
    SELECT q, j, score, listas, puesto FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, j) AS puesto FROM (
        SELECT q, j, round(sum(1.0::DOUBLE / (puesto + 60)), 8) AS score, count(*) AS listas FROM (
            SELECT q, j, puesto FROM ({LITERAL_SQL}) UNION ALL SELECT q, j, puesto FROM ({SEMANTIC_SQL})) GROUP BY 1, 2)) WHERE puesto <= 10""")
def _(d):
    return R.reciprocal_rank_fusion(list(_lists(d)), 10)


@query("u04_list_overlap", f"""
    SELECT coalesce(a.q, b.q) AS q, coalesce(a.n, 0) AS primera, coalesce(b.n, 0) AS segunda, coalesce(c.n, 0) AS comunes
    FROM (SELECT q, count(*) AS n FROM ({LITERAL_SQL}) GROUP BY 1) a FULL JOIN (SELECT q, count(*) AS n FROM ({SEMANTIC_SQL}) GROUP BY 1) b ON a.q = b.q
    LEFT JOIN (SELECT l.q, count(*) AS n FROM ({LITERAL_SQL}) l JOIN ({SEMANTIC_SQL}) s ON l.q = s.q AND l.j = s.j GROUP BY 1) c
      ON c.q = coalesce(a.q, b.q)""")
def _(d):
    literal, semantic = _lists(d)
    return R.list_overlap(literal, semantic)
