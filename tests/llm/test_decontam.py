"""Greedy string tiling against brute force."""

import random

import numpy as np

from feedlake.llm import decontam
from tests.llm.helpers import docs, odd_rows, prose


def plain_tiles(a, b, least):
    """Length of the greedy tiling by trying all places."""
    ta, tb, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in ta and j + n not in tb:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        ta.update(range(i, i + n))
        tb.update(range(j, j + n))
        total += n


def test_tiles_equal_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        a = [rng.randrange(4) for _ in range(rng.randint(3, 25))]
        b = [rng.randrange(4) for _ in range(rng.randint(3, 40))]
        found = decontam.tiles(np.array(a), np.array(b), 3)
        assert sum(n for _, _, n in found) == plain_tiles(a, b, 3)
        for i, j, n in found:
            assert a[i:i + n] == b[j:j + n]


def test_hashes_tell_windows_apart():
    ids = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4])
    for width in (1, 2, 3, 5, 6):
        h = decontam.hashes(ids, width)
        windows = [tuple(ids[i:i + width]) for i in range(len(ids) - width + 1)]
        assert all((h[i] == h[j]) == (windows[i] == windows[j]) for i in range(len(h)) for j in range(len(h)))


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


def test_passages_whole_reordered_and_partly(spark):
    item = prose(1, 40)
    w = item.split()
    reordered = " ".join(w[20:40]) + " filler words between. " + " ".join(w[:20])
    table = [(1, f"{prose(2, 200)} {item.upper()}! {prose(3, 50)}"), (2, f"{prose(4)} {reordered}"), (3, f"{prose(5)} {' '.join(w[:20])}"),
             (4, prose(6, 300)), (5, " ".join(f"{x}," for x in w))]
    found = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs(spark, table), bench(spark, [(7, item), (8, prose(9, 30))])).collect()}
    assert set(found) == {(1, 7), (2, 7), (5, 7)}
    assert (found[2, 7].n_tiles, found[2, 7].matched_words, found[2, 7].coverage) == (2, 40, 1.0)


def test_odd_rows_short_items_and_repeats(spark):
    items = [(1, None), (2, ""), (3, "ok"), (4, "one two three"), (4, "one two three"), (None, "beta gamma alpha beta gamma alpha"), (6, " !! ")]
    found = sorted(((r.doc_id, r.item_id) for r in decontam.leaks(docs(spark, odd_rows()), bench(spark, items)).collect()), key=repr)
    assert found == sorted([(4, 3), (None, 4), (None, 4), (6, None)], key=repr)
    assert decontam.leaks(docs(spark, odd_rows()), bench(spark, [])).count() == 0
    assert decontam.leaks(docs(spark, []), bench(spark, items)).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    items = [(k, prose(k, 20)) for k in range(9)]
    table = docs(spark, [(k, f"{prose(50 + k)} {prose(k, 20)}") for k in range(9)])
    whole = sorted(decontam.leaks(table, bench(spark, items)).collect())
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 45)
    assert sorted(decontam.leaks(table, bench(spark, items)).collect()) == whole and len(whole) == 9
