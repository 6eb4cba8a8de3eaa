"""Small tables with the awkward rows that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, d2 double, n long, key string"
LONG = "alpha beta gamma " * 40_000


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(n))


def docs(spark, rows):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source), with columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", 1.0, 2, "k") for r in rows]
    return spark.createDataFrame(full, DOCS)


def odd_rows():
    return [(1, None, None, None), (2, "", "en", None), (3, " \n\t ", None, "s"), (None, "one two three", "en", "s"), (4, "ok", "en", "s"),
            (5, prose(5), "en", "s"), (5, prose(5), "en", "s"), (6, LONG, "en", "s"), (7, "ﬁne ① 日本語 ▁   x", "ja", "s"), (8, "a  b \n c", "en", "s")]
