import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from feedlake.functions import expressions as E


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize("key", ["k", "0123456789abcdef" * 4, "x" * 100])
def test_keyed_hash_equals_the_standard_one(spark, key):
    got = one(spark, E.hmac_sha256(F.lit("1705"), key))
    assert got == hmac.new(key.encode(), b"1705", hashlib.sha256).hexdigest()


def test_pseudonym_shape(spark):
    salt = "ab" * 32
    want = "U-" + hmac.new(salt.encode(), b"42", hashlib.sha256).hexdigest()[:12]
    assert one(spark, E.pseudonym(F.lit(42), salt)) == want


def test_decay_is_efolding_not_half_life(spark):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, E.efolding(ts("2024-01-02"), ts("2024-01-01"))) == pytest.approx(math.exp(-1))


@pytest.mark.parametrize("year,band", [
    (None, "sin_dato"), (2009, "menor_de_18"), (2008, "18-25"), (2001, "18-25"), (2000, "26-35"), (1961, "56-65"),
    (1960, "66+")])
def test_age_bands(spark, year, band):
    assert one(spark, E.age_band(F.lit(year).cast("int"))) == band


@pytest.mark.parametrize("text,want", [("¡Política y Economía!", "politica-y-economia"), ("Niño  Ö", "nino--o"),
                                       ("e\u0301poca", "epoca"), ("Česká Ẽ", "ceska-e")])
def test_slug(spark, text, want):
    assert one(spark, E.slug(F.lit(text))) == want


def test_encryption_round_trip_is_salted(spark):
    df = spark.createDataFrame([("a@b.c",), ("a@b.c",)], "t string").select(E.encrypt_text(F.col("t"), "p").alias("c"))
    rows = df.select("c", E.decrypt_text(F.col("c"), "p").alias("t")).collect()
    assert {r.t for r in rows} == {"a@b.c"} and len({bytes(r.c) for r in rows}) == 2


def test_json_helpers(spark):
    doc = F.lit('{"a": 1, "b": true}')
    assert one(spark, E.json_contains(doc, {"a": "1", "b": "true"}))
    assert not one(spark, E.json_contains(doc, {"a": "2"}))
    assert one(spark, E.json_has_key(doc, "b")) and not one(spark, E.json_has_key(doc, "z"))
    assert not one(spark, E.json_has_key(F.lit(None).cast("string"), "b"))


def test_embedding_text_leaves_out_missing_parts(spark):
    none = F.lit(None).cast("string")
    full = E.embedding_text(F.lit("Mercados"), F.lit("Titulo"), F.lit("Bajada."), F.array(F.lit("b"), F.lit("a")))
    assert one(spark, full) == "Mercados. Titulo. Bajada. Temas: a, b"
    assert one(spark, E.embedding_text(F.lit("Mercados"), F.lit("Titulo"), none, F.array().cast("array<string>"))) == \
        "Mercados. Titulo"


def test_session_key(spark):
    assert one(spark, E.session_key(F.lit(842), F.lit("2026-07-15 08:42:11").cast("timestamp_ntz"))) == \
        "S-000842-2026071508"
