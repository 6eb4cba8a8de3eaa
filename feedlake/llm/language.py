"""Language identification by rank-order profiles and out-of-place distance.

A profile is the list of a language's ``PROFILE`` most frequent letter n-grams (n up to ``ORDER``, words padded with an
underscore on both sides). A document's own most frequent n-grams are compared with each profile: an n-gram costs the
difference of its two ranks, or ``PROFILE`` if the language does not list it; the nearest language wins.

An n-gram is held as one 63-bit number, 21 bits a character from the top, so numbers sort like the strings; counting is a
sort of numbers. Profiles are counted over all training rows: each task adds up counts by language and hands them on when it
holds many, so a language that holds a third of the rows is summed from partial counts. Only the profiles (``PROFILE``
numbers a language) reach the driver.

Null, empty or letterless text: ``und`` with score 0. Ties of ranks go by the n-gram's characters, ties of distances by the language's
name. Nothing learned (empty table, or no known language): every row is ``und``. Repeated rows are predicted one by one.
Texts are used whole. Only doc_id, text and the training language are read, so other columns may have any name.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER, PROFILE = 3, 400
BITS, PAD = 21, ord("_")
FAR = 10**9
#: Counts held by a task before it hands them on; a limit on memory, nothing is dropped.
FLUSH = 1_000_000
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Of each code point: 2 for letters, 1 for marks (accents and vowel signs, which are part of a word that has a letter), else 0."""
    if not _LETTER:
        kinds = (unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1))
        _LETTER.append(np.fromiter(({"L": 2, "M": 1}.get(k, 0) for k in kinds), np.uint8, sys.maxunicode + 1))
    return _LETTER[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams of a whole text as numbers, and how often each occurs."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    kind = letters()[points]
    if not (kind == 2).any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    letter = kind > 0
    # One pad before, between and after words.
    padded = np.r_[PAD, np.where(letter, points, PAD)[letter | np.r_[False, letter[:-1]]] if len(points) else points, PAD]
    if len(padded) > 2 and padded[-2] == PAD:
        padded = padded[:-1]
    keys, inner = [], np.zeros(len(padded), bool)
    gram = padded << (BITS * (ORDER - 1))
    keys.append(gram[padded != PAD])
    for n in range(1, ORDER):
        # Grams with a pad inside would span two words.
        inner = inner[:-1] | (padded[n - 1:-1] == PAD if n > 1 else False)
        gram = gram[:-1] | (padded[n:] << (BITS * (ORDER - 1 - n)))
        keys.append(gram[~inner])
    if not len(keys[0]):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    return found[first], np.diff(np.r_[first, len(found)])


def ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Most frequent first, equals by their characters."""
    return grams[np.argsort(-counts, kind="stable")[:PROFILE]]


def number(gram: str) -> int:
    return sum(ord(c) << (BITS * (ORDER - 1 - k)) for k, c in enumerate(gram))


class Profiles:
    """Ranks of all languages, one row of a matrix for each n-gram that any of them lists; unlisted ranks are far away."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        listed = [np.array(profiles[name], np.int64) for name in self.names]
        self.grams = np.unique(np.concatenate(listed)) if listed else np.empty(0, np.int64)
        self.rank = np.full((len(self.grams) + 1, len(self.names)), FAR)
        for k, own in enumerate(listed):
            self.rank[np.searchsorted(self.grams, own), k] = np.arange(len(own))

    def distances(self, own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        cost = np.abs(self.rank[at] - np.arange(len(own))[:, None])
        return np.where(cost >= FAR // 2, PROFILE, cost).sum(axis=0)


def _count_batches(batches):
    found: dict[str, list] = defaultdict(list)
    held = 0

    def flush():
        for lang, parts in found.items():
            grams, which = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            n = np.bincount(which, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])
        found.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            grams, counts = gram_counts(text.as_py())
            if len(grams):
                found[lang].append((grams, counts))
                held += len(grams)
            if held > FLUSH:
                yield from flush()
                held = 0
    yield from flush()


def learn(rows: DataFrame) -> dict[str, list[int]]:
    """Profile of each language in ``rows`` (text, lang); rows without text or language teach nothing."""
    counted = rows.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull()).mapInArrow(
        _count_batches, "lang string, gram long, n long")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").toLocalIterator():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def identify(text: str | None, profiles: Profiles) -> tuple[str, float]:
    """Nearest language and how much nearer it is than the next one: 1 - nearest / next distance."""
    own = ranked(*gram_counts(text))
    if not len(own) or not profiles.names:
        return "und", 0.0
    cost = profiles.distances(own)
    order = np.argsort(cost, kind="stable")
    nearest = int(cost[order[0]])
    limit = int(cost[order[1]]) if len(order) > 1 else PROFILE * len(own)
    return profiles.names[order[0]], (1.0 - nearest / limit if limit else 0.0)


def predict(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    ranks = Profiles(profiles)

    def run(batches):
        for batch in batches:
            out = [identify(t.as_py(), ranks) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
