"""Every registered query against its SQL text on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from feedlake.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
# Approximate by design, so there is no exact SQL to compare with.
WITHOUT_SQL = {"x07_inverted_lists_recall"}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(registry.jobs()) - set(registry.sql_texts()) == WITHOUT_SQL
    assert set(registry.jobs()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.sql_texts()))
def test_query_equals_sql(spark, con, name):
    df = registry.jobs()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(registry.sql_texts()[name])
    names = rel.columns
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_approximate_recall_is_reported(spark):
    row = registry.jobs()["x07_inverted_lists_recall"](spark, FOLDER).first()
    assert 0 < row.hallados <= row.vecinos and 0 < row.recall <= 1
