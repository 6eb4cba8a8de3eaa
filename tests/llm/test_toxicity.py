"""Toxicity: features, held-out accuracy and odd rows."""

import random

from feedlake.llm import toxicity
from tests.llm.helpers import docs, odd_rows, prose

BAD = ["gronk", "blarfing", "snudge"]


def rows(n, seed):
    rng = random.Random(seed)
    out, labels = [], []
    for k in range(n):
        words = prose(seed * 10_000 + k, rng.randint(20, 60)).split()
        toxic = int(rng.random() < 0.4)
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["you", "du", "the"]) + " " + rng.choice([*BAD, "gr0nk!", "sn.udge"]))
        out.append((seed * 10_000 + k, " ".join(words)))
        labels.append((seed * 10_000 + k, toxic, 1, "clash"))
    return out, labels


LABELS = "doc_id long, toxic int, quality int, text string"


def test_features_of_a_text():
    f = toxicity.Features({"gronk": 2.0, "blarf*": 1.5})
    names = dict(zip(toxicity.FEATURES, f("You GRONK! the blarfing g.r.0.n.k 12")))
    assert names["density"] == 50 and names["variety"] == 2 and names["heaviest"] == 2.0 and names["near_reader"] == 1
    assert names["obfuscated"] == 1 / 6 and names["capitals"] > 0 and names["exclamation"] > 0
    assert all(v == 0 for v in f(None)) and f("") == f(None)
    assert toxicity.plain("1d10t!!") == ("idiot", True) and toxicity.plain("(1999)") == ("1999", False)


def test_held_out_accuracy_and_odd_rows(spark):
    train, labels = rows(700, 1)
    fresh, truth = rows(300, 2)
    odd = [(10**6 + k, r[1]) for k, r in enumerate(odd_rows())] + [(None, "x y")]
    labelled = labels + labels[:20] + [(None, 1, 1, "x"), (5, None, 1, "x"), (6, 7, 1, "x")]
    model = toxicity.fit(docs(spark, train), spark.createDataFrame(labelled, LABELS))
    assert {"gronk", "snudge"} <= set(model.lexicon)
    scores = {r.doc_id: r.score for r in model.score(docs(spark, fresh + odd)).collect()}
    assert len(scores) == len(fresh) + len(odd) and all(0 <= s <= 1 for s in scores.values())
    assert sum((scores[i] >= 0.5) == bool(t) for i, t, _, _ in truth) > 0.95 * len(truth)
    assert scores[10**6] == scores[10**6 + 1] < 0.5


def test_nothing_to_learn(spark):
    train, labels = rows(10, 3)
    empty = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.fit(docs(spark, train), empty).score(docs(spark, train)).collect()} == {0.0}
    share = sum(x[1] for x in labels) / 10
    assert {r.score for r in toxicity.fit(docs(spark, train), spark.createDataFrame(labels, LABELS)).score(docs(spark, train)).collect()} == {share}
    assert toxicity.fit(docs(spark, []), empty).score(docs(spark, [])).count() == 0
