"""Rank-order profiles."""

import random
from collections import Counter

import regex

from feedlake.llm import language
from tests.llm.helpers import LONG, docs, odd_rows

EN = "the and of to in that is was for with house water morning people thing another should".split()
DE = "der die und das ist nicht ein mit auf für haus wasser morgen leute schön sprechen über".split()


def text(words, seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


def plain_grams(body):
    words = regex.findall(r"[\p{L}\p{M}]+", body.lower()) if regex.search(r"\p{L}", body.lower()) else []
    padded = [f"_{w}_" for w in words]
    return Counter(p[i:i + n] for p in padded for n in (1, 2, 3) for i in range(len(p) - n + 1) if p[i:i + n] != "_")


def plain_profile(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:language.PROFILE]]


def test_grams_equal_a_plain_count():
    for body in ["Ab 12 b_AB!", "", "...", "a", "é日本 x²y", "12 a", "a 12", LONG[:500], "\n a\tb "]:
        grams, counts = language.gram_counts(body)
        assert dict(zip(grams.tolist(), counts.tolist())) == {language.number(g): n for g, n in plain_grams(body).items()}


def test_profiles_equal_a_plain_count(spark):
    table = [(k, text(EN, k), "en", "s") for k in range(30)] + [(50 + k, text(DE, k), "de", "s") for k in range(30)]
    found = language.learn(docs(spark, table))
    for lang in ("en", "de"):
        total = sum((plain_grams(r[1]) for r in table if r[2] == lang), Counter())
        assert found[lang] == [language.number(g) for g in plain_profile(total)]


def test_prediction_and_plain_distance(spark):
    table = [(k, text(EN, k), "en", "s") for k in range(30)] + [(50 + k, text(DE, k), "de", "s") for k in range(30)]
    profiles = language.learn(docs(spark, table))
    plain = {lang: plain_profile(sum((plain_grams(r[1]) for r in table if r[2] == lang), Counter())) for lang in ("en", "de")}
    fresh = [(k, text(EN if k % 2 else DE, 1000 + k, 15)) for k in range(40)]
    found = {r.doc_id: r for r in language.predict(docs(spark, fresh), profiles).collect()}
    for k, body in fresh:
        own = plain_profile(plain_grams(body))
        cost = {lang: sum(abs(i - p.index(g)) if g in p else language.PROFILE for i, g in enumerate(own)) for lang, p in plain.items()}
        assert found[k].lang_pred == min(cost, key=cost.get) == ("en" if k % 2 else "de")
        assert abs(found[k].score - (1 - min(cost.values()) / max(cost.values()))) < 1e-12


def test_odd_rows_and_nothing_learned(spark):
    table = docs(spark, odd_rows() + [(20, "12 + 34 !", "en", "s")])
    profiles = language.learn(table)
    assert set(profiles) == {"en", "ja"}
    found = language.predict(table, profiles).collect()
    assert len(found) == 11
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {1, 2, 3, 20}
    assert all(0 <= r.score <= 1 for r in found)
    assert all(r.lang_pred == "und" and r.score == 0 for r in language.predict(table, {}).collect())
    assert language.learn(docs(spark, [])) == {} and language.predict(docs(spark, []), profiles).count() == 0


def test_ties_go_by_name():
    assert language.identify("x", language.Profiles({"b": [language.number("_x")], "a": [language.number("_x")]})) == ("a", 0.0)


def test_texts_without_letters_have_no_language(spark):
    rows = [(k, t) for k, t in enumerate(["½", "² ³", "①", "12 + 3", "́ ̂", "🙂", "", None])]
    profiles = {"en": language.gram_counts("the house and the water")[0].tolist()}
    assert {(r.lang_pred, r.score) for r in language.predict(docs(spark, rows), profiles).collect()} == {("und", 0.0)}
    assert language.predict(docs(spark, [(1, "é the")]), profiles).first().lang_pred == "en"
