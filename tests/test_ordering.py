"""Sliced numbering and look-back equal the plain window, a hot group included."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedlake.functions.ordering import number_in_slices, previous_in_slices
from feedlake.operators.ranking import position_in_section


def rows(seed=1, n=600):
    rng = random.Random(seed)
    return [(i, 1 if rng.random() < 0.5 else rng.randint(2, 6), rng.randint(0, 50), rng.choice("abc")) for i in range(n)]


def test_number_in_slices(spark):
    df = spark.createDataFrame(rows(), "id long, g int, t int, v string")
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("t", "id")))
    cut = number_in_slices(df, ["g"], F.floor(F.col("t") / 7), "asc", [F.col("t").asc(), F.col("id").asc()], "n")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.collect()))


def test_previous_in_slices(spark):
    df = spark.createDataFrame(rows(2), "id long, g int, t int, v string")
    plain = df.withColumn("p", F.lag("v").over(Window.partitionBy("g").orderBy("t", "id")))
    cut = previous_in_slices(df, ["g"], F.floor(F.col("t") / 9), ["t", "id"], {"p": "v"})
    key = lambda r: (r[0],)
    assert sorted(map(tuple, plain.collect()), key=key) == sorted(map(tuple, cut.select(plain.columns).collect()), key=key)


def test_position_in_section_with_ties_and_zero_scores(spark):
    rng = random.Random(3)
    data = [(i, rng.randint(1, 2), rng.choice([0.0, 0.0, 0.5, 1.25, 3.0, 1e-6]), f"2024-01-{rng.randint(1, 9):02d} 0{rng.randint(0, 9)}:00:00")
            for i in range(300)]
    df = spark.createDataFrame(data, "contenido_id long, seccion_id int, score double, f string").withColumn(
        "fecha_publicacion", F.col("f").cast("timestamp_ntz"))
    got = {r.contenido_id: (r.seccion_id, r.posicion_en_seccion) for r in position_in_section(df).collect()}
    for s in (1, 2):
        mine = sorted((r for r in data if r[1] == s), key=lambda r: r[0])
        mine.sort(key=lambda r: (r[2], r[3]), reverse=True)
        for n, r in enumerate(mine, 1):
            assert got[r[0]] == (s, n)
