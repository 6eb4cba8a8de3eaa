"""Ranked lexical search against plain scoring of all documents."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest

from feedlake.llm import lexical, sql
from feedlake.llm.queries import op13_lexical
from tests.llm.helpers import docs, odd_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, items):
    words = [TERM.findall((t or "").translate(LOWER)) for _, t in rows]
    count, total = sum(bool(w) for w in words), sum(map(len, words))
    tf = [collections.Counter(w) for w in words]
    df = collections.Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        asked = set(TERM.findall((text or "").translate(LOWER))) & set(df)
        scored = []
        for (doc, _), w, c in zip(rows, words, tf):
            m = 50 + 50 * len(w) * count // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if c[t])
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, k + 1, doc, -score) for k, (score, _, _, doc) in enumerate(sorted(scored, key=lambda s: s[:3])[:50])]
    return sorted(out, key=repr)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "item_id long, text string, doc_id string, rank int")


def check(spark, rows, asked):
    got = [tuple(r) for r in lexical.search(docs(spark, rows), items(spark, asked)).collect()]
    assert sorted(got, key=repr) == brute([r[:2] for r in rows], asked)


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Ünï", "日本", "A1"]
    text = lambda size: " ".join(vocabulary[min(int(rng.expovariate(0.02)), 302)] for _ in range(size))
    rows = [(k, text(rng.randint(0, 60))) for k in range(n)]
    return rows + rows[:80], [(k, text(rng.choice([3, 20, 150, 400]))) for k in range(12)]


@pytest.mark.parametrize("block,pack", [(2048, 128), (16, 2)])
def test_equals_plain_scoring(spark, monkeypatch, block, pack):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "PACK", pack)
    check(spark, *corpus(block))


def test_odd_rows(spark):
    asked = [(1, "one two alpha"), (1, "one two alpha"), (None, "ok"), (2, None), (3, ""), (4, "..."), (5, "unknown"), (6, "日本語 ① x")]
    check(spark, odd_rows() + [(None, "two two"), (9, "two two"), (9, "two two")], asked)
    check(spark, [], asked)
    check(spark, odd_rows(), [])
    check(spark, [(1, None), (2, "--")], asked)


def test_unsafe_masks_only(spark):
    """A mask is left out only if its bound is below the last score that is kept."""
    rng = np.random.default_rng(1)
    size, count = 3000, 90
    places = [np.flatnonzero(rng.random(size) < rng.choice([0.01, 0.5])) for _ in range(count)]
    parts = [rng.integers(1, 10**6, len(p)) for p in places]
    weights = rng.integers(0, 9000, count).tolist()
    ids = rng.permutation(size)
    score = np.zeros(size, np.int64)
    for p, q, w in zip(places, parts, weights):
        score[p] += w * q
    order = np.lexsort((ids, -score))[:50]
    got = lexical.best(places, parts, weights, size, ids, (np.empty(0, np.int64), np.empty(0, np.int64)))
    assert got[0].tolist() == score[order].tolist() and got[1].tolist() == ids[order].tolist()


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{folder}/{t}.parquet").select(c, "text").collect()]
    got = op13_lexical(spark, folder)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == brute(read("documents", "doc_id"), read("benchmark", "item_id"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    assert sorted(con.sql(sql.SEARCH).fetchall(), key=repr) == rows
