"""The Jaccard class join against brute force."""

import random
import re

import pytest

from feedlake.llm import jaccard
from feedlake.llm.components import connected
from tests.llm.helpers import docs, odd_rows, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, text in rows:
        w = WORDS.findall((text or "").translate(LOWER))
        k = min(5, len(w))
        sets.append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set())
    ids = [r[0] for r in rows]
    rank = {i: (i is not None, i or 0) for i in ids}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(ids[a]), find(ids[b])), key=rank.get)
                parent[y] = x
    return sorted(((i, len(s), find(i)) for i, s in zip(ids, sets)), key=repr)


def got(spark, rows):
    found = jaccard.classes(docs(spark, rows)).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr)


def edited(text, rng, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_chains_and_shared_passages(spark, seed):
    rng = random.Random(seed)
    base, passage = prose(seed, 80), prose(seed + 100, 40)
    rows = [(k, edited(base, rng, rng.randint(0, 5))) for k in range(120)]
    rows += [(200 + k, f"{passage} {prose(300 + k, rng.randint(4, 20))}") for k in range(60)]
    chain = prose(seed + 7, 100).split()
    rows += [(400 + k, " ".join(chain[k * 4:k * 4 + 60])) for k in range(10)]
    rows += [(500 + k, prose(600 + k, rng.randint(1, 30))) for k in range(40)]
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_exactly_three_quarters_links(spark):
    # Shared, own: 6 of 8 shingles link, 5 of 7 do not.
    a = prose(1, 12).split()
    rows = [(1, " ".join(a[:10])), (2, " ".join(a)), (3, " ".join(prose(2, 9).split())), (4, " ".join(prose(2, 9).split() + ["x", "y"]))]
    assert [r[2] for r in brute(rows)] == [1, 1, 3, 4]
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [r[:2] for r in odd_rows()] + [(9, "ONE two\tthree"), (10, "one two three"), (11, "OK"), (12, "ÄÖ x"), (13, "äö x")]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (500, 500)]
    found = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}, 500: 500}


def test_long_text_is_used_whole():
    head = prose(1, 30_000)
    assert len(jaccard.shingles(head + " tail of words here now")) == len(jaccard.shingles(head)) + 5


def test_a_doc_id_with_several_texts_joins_their_classes(spark):
    a, b = prose(31), prose(32)
    assert got(spark, [(1, a), (2, b), (10, a), (10, b)]) == brute([(1, a), (2, b), (10, a), (10, b)])
    assert {(i, c) for i, _, c in got(spark, [(1, a), (2, b), (10, a), (10, b)])} == {(1, 1), (2, 1), (10, 1)}
