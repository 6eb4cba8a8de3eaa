"""Repeated passages against a count of all windows."""

import collections
import hashlib
import random

import pytest

from feedlake.llm import repeats
from feedlake.llm.queries import op12_repeats
from tests.llm.helpers import docs, odd_rows, prose


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[k:k + 400] for r in raws for k in range(len(r) - 399))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - 399):
            if seen[r[k:k + 400]] > 1:
                gone[k:k + 400] = b"\1" * 400
        spans = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows):
    got = repeats.remove(docs(spark, rows)).collect()
    want = [(r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows]))]
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert len(r["spans"]) == r["n_spans"] and sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]
    return got


def corpus(seed=1):
    rng = random.Random(seed)
    shared = [prose(1000 + k, n) for k, n in enumerate((70, 90, 150, 400))]
    rows = []
    for k in range(60):
        parts = [prose(k, rng.randint(1, 150))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 60)
            parts.append(s[a:len(s) - rng.randint(0, 60)])
            parts.append(prose(rng.random(), rng.randint(0, 60)))
        rows.append((k, rng.choice(["", " "]).join(parts)))
    return rows + [(100, rows[3][1]), (3, rows[3][1]), (3, rows[5][1][:500])]


def test_equals_a_count_of_windows(spark):
    check(spark, corpus())


@pytest.mark.parametrize("family", [1, 3])
def test_large_families_are_split(spark, monkeypatch, family):
    monkeypatch.setattr(repeats, "FAMILY", family)
    check(spark, corpus(2))


def test_families_stay_whole_when_a_join_by_key_is_dealt_anew(spark):
    # A join planned by sorting that adaptive execution turns into a broadcast of the keys, not of the contexts: as on larger tables.
    settings = {"spark.sql.autoBroadcastJoinThreshold": "256KB", "spark.sql.adaptive.autoBroadcastJoinThreshold": "256KB",
                "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "64KB",
                "spark.sql.files.openCostInBytes": "64KB"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        check(spark, [(k, " ".join([prose(k, 30), prose(1000 + k // 2, 150), prose(3000 + k, 30), prose(2000 + (k + 1) // 2 % 150, 150)]))
                      for k in range(300)])
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_odd_rows(spark):
    check(spark, [r[:2] for r in odd_rows() if r[0] != 6] + [(None, None)])
    long = "alpha beta gamma " * 300
    check(spark, [(1, long), (2, "a" * 399), (3, "b" * 400), (4, "b" * 401), (5, "é日" * 200 + "x"), (6, "y" + "é日" * 200), (7, prose(1, 100)[:400]),
                  (8, prose(1, 100)[:400]), (9, prose(2, 100)[:399]), (10, prose(2, 100)[:399])])
    assert repeats.remove(docs(spark, [])).collect() == []


def test_long_periodic_text(spark):
    long = "alpha beta gamma " * 40_000
    got = {r["doc_id"]: r for r in repeats.remove(docs(spark, [(1, long), (2, "delta " + prose(3))])).collect()}
    assert got[1]["n_removed"] == len(long) and got[1]["n_spans"] == 1 and got[2]["n_removed"] == 0


def test_groups_list_all_occurrences(spark):
    rng = random.Random(5)
    a, b = prose(1, 120), prose(2, 120)
    rows = [(k, prose(10 + k, 30) + "#" + (a if k % 2 else b) + "#" + prose(rng.random(), 30)) for k in range(9)]
    texts = repeats.distinct_texts(docs(spark, rows))
    found = repeats.occurrences(texts).collect()
    text = {r["tid"]: r["text"].encode() for r in texts.collect()}
    groups = collections.defaultdict(set)
    for r in found:
        groups[r["group"]].add((r["tid"], r["start"], r["length"]))
    for group, own in groups.items():
        strings = {text[t][s:s + n] for t, s, n in own}
        assert len(strings) == 1 and hashlib.blake2b(strings.pop(), digest_size=16).digest() == group
    below = collections.defaultdict(set)
    for r in found:
        if r["parent"]:
            below[r["parent"]].add(r["group"])

    def places(group):
        return {(t, s) for t, s, _ in groups[group]}.union(*map(places, below[group]))

    for group, own in list(groups.items()):
        t, s, n = next(iter(own))
        string = text[t][s:s + n]
        assert places(group) == {(t, s) for t, raw in text.items() for s in range(len(raw) - n + 1) if raw[s:s + n] == string}
    assert {4, 5} <= {len(places(g)) for g in list(groups)} and set(below) <= {r["group"] for r in found}


def test_suffix_array_and_intervals_against_all_pairs():
    rng = random.Random(8)
    base = bytes(rng.choice(b"ab") for _ in range(460))
    strings = [base[rng.randint(0, 30):rng.randint(435, 460)] + bytes(rng.choice(b"abc") for _ in range(30)) for _ in range(14)]
    strings = list(dict.fromkeys(strings))
    starts = [(o, s) for o, x in enumerate(strings) for s in range(max(0, len(x) - 399))]
    array = repeats.SuffixArray(strings, [range(max(0, len(x) - 399)) for x in strings])
    suffixes = [strings[o][s:] for o, s in zip(array.owner, array.start)]
    assert suffixes == sorted(suffixes) and len(suffixes) < len(starts)

    def shared(x, y):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    assert array.common.tolist() == [0, *map(shared, suffixes, suffixes[1:])]
    places = set()
    for k, length, above in array.maximal():
        assert length >= 400 and (above == 0 or 400 <= above < length)
        o, s = int(array.owner[k]), int(array.start[k])
        places |= {(o, at) for at in range(s, s + length)}
    want = set()
    for o, s in starts:
        n = max((shared(strings[o][s:], strings[p][t:]) for p, t in starts if (p, t) != (o, s)), default=0)
        if n >= 400:
            want |= {(o, at) for at in range(s, s + n)}
    assert places == want and want


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = op12_repeats(spark, folder)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = [(r["doc_id"], *b) for r, b in zip(rows, brute([r["text"] for r in rows]))]
    assert sorted(map(tuple, got.collect())) == sorted(want)
