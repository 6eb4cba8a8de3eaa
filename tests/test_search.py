import math

import pytest

from feedlake.operators import search as S


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "Rojo rojo azul"), (2, "azul verde"), (3, "el verde y los árboles"), (4, "")], "id long, texto string")


def run(spark, docs, text, **kw):
    q = spark.createDataFrame([(1, text)], "q long, texto string")
    return [(r.j, r.score) for r in S.literal_search(docs, q, 10, **kw).orderBy("puesto").collect()]


def test_rank_by_frequency_and_rarity(spark, docs):
    got = run(spark, docs, "azul ROJO")
    idf = lambda df: math.log(1 + 4 / df)
    assert got == [(1, pytest.approx((1 + math.log(2)) * idf(1) + idf(2), abs=1e-6)), (2, pytest.approx(idf(2), abs=1e-6))]


def test_stop_words_and_plurals(spark, docs):
    assert run(spark, docs, "el") == []
    assert [j for j, _ in run(spark, docs, "el", language=None)] == [3]
    assert [j for j, _ in run(spark, docs, "árbol")] == [3]


def test_the_end_of_a_long_text_counts(spark):
    long = spark.createDataFrame([(1, "relleno " * 50000 + "aguja")], "id long, texto string")
    assert [j for j, _ in run(spark, long, "aguja")] == [1]
