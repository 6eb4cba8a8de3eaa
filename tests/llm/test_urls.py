"""URL rules and the character model against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from feedlake.llm import urls

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
DDL = "page_id long, url string, html string, host string, score double, rule string"


def table(spark, rows):
    return spark.createDataFrame([(i, u, "h", "clash", 0.0, "r") for i, u in rows], DDL)


@pytest.mark.parametrize("url, host, path, rule", [
    ("http://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/"), ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/"), ("http://x.com/de/", "x.com", "/de/", "com/de/"), ("http://x.com/design", "x.com", "/design", None), ("http://com/fr/a", "com", "/fr/a", "com/fr/"),
    ("http://x.org", "x.org", "", None), ("http://x.org?q=/a", "x.org", "", None), ("no scheme.org/", "", "", None), ("", "", "", None), (None, "", "", None),
    ("http://x.net/a#b?c", "x.net", "/a", None), ("a?u=http://x.org/p", "x.org", "/p", "org/"), ("http://ÄX.org/\n/é", "Äx.org", "/\n/é", "org/"), ("://", "", "", None)])
def test_hosts_paths_and_longest_rule(spark, url, host, path, rule):
    r = urls.with_rules(table(spark, [(1, url)]), RULES).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)
    assert r.verdict == {t: v for v, t in RULES}.get(rule)


def plain_model(texts):
    """Witten-Bell blend of orders 0 to ORDER by dictionaries."""
    counts = Counter()
    for t in texts:
        s = [0] * urls.ORDER + [int(urls._SYMBOL[b]) for b in t.encode()]
        for k in range(urls.ORDER, len(s)):
            for order in range(urls.ORDER + 1):
                counts[tuple(s[k - order:k + 1])] += 1
    total, kinds = Counter(), Counter()
    for gram, n in counts.items():
        total[gram[:-1], len(gram)] += n
        kinds[gram[:-1], len(gram)] += 1

    def p(gram):
        lower = p(gram[1:]) if len(gram) > 1 else 1 / urls.SYMBOLS
        n, t = total[gram[:-1], len(gram)], kinds[gram[:-1], len(gram)]
        return (counts[gram] + t * lower) / (n + t) if n else lower

    return p


def test_scores_equal_a_plain_model(spark):
    rng = random.Random(1)
    good = ["http://" + "".join(rng.choice("abc/") for _ in range(12)) for _ in range(50)]
    bad = ["http://" + "".join(rng.choice("bcd-") for _ in range(12)) for _ in range(40)]
    rows = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "url string, accepted boolean")
    ratio = urls.learn(rows)
    p1, p0 = plain_model(good), plain_model(bad)
    for text in ["http://abc/", "zz9", "é"]:
        s = [0] * urls.ORDER + [int(urls._SYMBOL[b]) for b in text.encode()]
        grams = [tuple(s[k - urls.ORDER:k + 1]) for k in range(urls.ORDER, len(s))]
        want = sum(math.log(p1(g)) - math.log(p0(g)) for g in grams) / len(grams)
        cell, which = urls.cells(pa.array(["", text, None]))
        assert set(which) == {1} and abs(ratio[cell].mean() - want) < 1e-4


def test_threshold_is_the_best_split(spark):
    rows = [(s / 10, s >= 12) for s in range(40)] + [(0.5, True), (3.0, False)]
    limit = urls.threshold(spark.createDataFrame(rows, "score double, accepted boolean"))
    error = lambda t: np.mean([s < t for s, a in rows if a]) + np.mean([s >= t for s, a in rows if not a])
    assert error(limit) <= min(error(s / 10) for s in range(41)) + 1e-9


def test_verdicts_follow_the_model(spark):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        kind = k % 4
        site = "".join(rng.choice("aeiou") for _ in range(9)) if kind in (0, 2) else "".join(rng.choice("xzqkw") for _ in range(9))
        rows.append((k, f"http://{site}.org/en/{site}" if kind == 0 else f"http://{site}.com/de/{site}" if kind == 1 else f"http://{site}.net/{site}"))
    found = {r.page_id: r for r in urls.judge(table(spark, rows), RULES).collect()}
    assert len(found) == 400
    assert np.mean([found[k].verdict == ("allow" if k % 4 in (0, 2) else "block") for k in range(400)]) > 0.97
    assert all((found[k].score is None) == (found[k].rule is not None) for k in range(400))


def test_nothing_learned_nulls_and_empty(spark):
    found = urls.judge(table(spark, [(1, None), (2, ""), (None, "http://x.net/"), (3, "http://x.org/"), (3, "http://x.org/")]), RULES).collect()
    assert len(found) == 5 and all(r.verdict == "allow" and r.score is None for r in found)
    assert urls.judge(table(spark, []), RULES).count() == 0
