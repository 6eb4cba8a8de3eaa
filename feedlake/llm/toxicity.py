"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: density, number, variety and weight of lexicon hits, share of hits near a word that addresses
the reader, density of such words, rates of capitals, punctuation, exclamation marks and obfuscated words, and length.
The lexicon is learned: words and word beginnings whose log-odds of being in a toxic text are surely high. Obfuscated
words (digits or signs for letters) are looked up as the words that they stand for.

The classifier is fitted on at most ``SAMPLE`` labelled rows of each class, those with the smallest hash of doc_id.
They are dealt in parts by doc_id: two teach the lexicon, one the trees, one the calibration, so none of these sees its
own training rows again. Class weights undo the unequal sampling. Every document is scored, in one pass.

A label given twice counts once, as toxic if either says so; labels other than 0 and 1 teach nothing. Null and empty
texts get the score of a text without words. With fewer than ``LEAST`` rows of either class in a part, nothing is learned and
every score is the share of toxic labels (0 without labels). Only doc_id and text are read of the documents.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.session import cut_lineage

SAMPLE, LEAST, TERMS, TREES, DEPTH = 20_000, 5, 2000, 20, 3
#: Words that address the reader.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer "
    "usted ustedes tú ti contigo vosotros vuestro sie ihnen tus".split())
NEAR = 5
#: Signs and digits commonly put for letters.
STANDS_FOR = str.maketrans("013457@$!|", "oieastasil")
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’‘…¡¿"
FEATURES = ["density", "hits", "variety", "weight", "heaviest", "near_reader", "second_person", "capitals", "punctuation",
            "exclamation", "obfuscated", "length"]
REMEMBERED = 200_000

_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c] = 2
_CLASS[ord("!")] = 3


def plain(word: str) -> tuple[str, bool]:
    """The word that a lower-cased token stands for, and whether it was obfuscated."""
    core = word.strip(EDGE)
    if core.isalpha() or not core:
        return core, False
    undone = core.translate(STANDS_FOR)
    letters = "".join(c for c in undone if c.isalpha())
    odd = any(c.isalpha() for c in core) and len(letters) > 2
    return (letters if odd else core), odd


def terms(word: str) -> list[str]:
    """What a word is looked up by: itself, then its beginnings."""
    return [word] + [word[:n] + "*" for n in (6, 5, 4) if len(word) > n]


class Features:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, tuple[float, str, bool, bool]] = {}

    def __getstate__(self):
        return {"lexicon": self.lexicon, "known": {}}

    def look(self, token: str):
        word, odd = plain(token)
        term = next((t for t in terms(word) if t in self.lexicon), "")
        found = (self.lexicon.get(term, 0.0), term, odd, word in SECOND_PERSON)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(token) <= 40:
            self.known[token] = found
        return found

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        get, look = self.known.get, self.look
        hits, readers, seen, odd, weight, heaviest = [], [], set(), 0, 0.0, 0.0
        tokens = text.lower().split()
        for k, token in enumerate(tokens):
            w, term, is_odd, reader = get(token) or look(token)
            if w:
                hits.append(k)
                seen.add(term)
                weight += w
                heaviest = max(heaviest, w)
            if reader:
                readers.append(k)
            odd += is_odd
        n = max(1, len(tokens))
        near = 0
        if hits and readers:
            at = np.array(readers)
            place = np.searchsorted(at, hits)
            before = np.array(hits) - at[np.maximum(place - 1, 0)]
            after = at[np.minimum(place, len(at) - 1)] - np.array(hits)
            near = int(((np.abs(before) <= NEAR) | (np.abs(after) <= NEAR)).sum())
        raw = text.encode("utf-8", "surrogatepass")
        kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=4) if raw else np.zeros(4)
        size = max(1, len(raw))
        return [100 * len(hits) / n, math.log1p(len(hits)), float(len(seen)), weight / n, heaviest, near / max(1, len(hits)),
                len(readers) / n, kinds[1] / size, (kinds[2] + kinds[3]) / size, kinds[3] / size, odd / n, math.log1p(len(tokens))]


def _term_counts(batches):
    """Documents of each class with a term."""
    counts = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            found: set[str] = set()
            for token in set((text.as_py() or "").lower().split()):
                found.update(terms(plain(token)[0]))
            found.discard("")
            counts[toxic].update(found)
    names = list(counts[0].keys() | counts[1].keys())
    for k in range(0, len(names), 50_000):
        part = names[k:k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[1][t] for t in part], pa.int64()),
                                          pa.array([counts[0][t] for t in part], pa.int64())], ["term", "toxic", "clean"])


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Weights of at most ``TERMS`` terms, from ``rows`` (text, toxic): the lower end (two standard errors) of the
    log-odds that a text with the term is toxic, where above 1."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = rows.select("text", "toxic").mapInArrow(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where("t >= 4")
    t, c = F.col("t"), F.col("c")
    n_t, n_c = sizes.get(1, 0), sizes.get(0, 0)
    odds = F.log((t + 0.5) / (n_t - t + 0.5)) - F.log((c + 0.5) / (n_c - c + 0.5))
    error = F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
    found = counts.select("term", (odds - 2 * error).alias("weight")).where("weight > 1").orderBy(F.desc("weight"), "term").limit(TERMS)
    return {r["term"]: float(r["weight"]) for r in found.collect()}


def _featured(rows: DataFrame, lexicon: dict[str, float], carry: dict[str, str]) -> DataFrame:
    def run(batches):
        features = Features(lexicon)
        for batch in batches:
            for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                values = np.array([features(t.as_py()) for t in part.column("text")], np.float64).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * len(FEATURES), pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), lists], [*carry, "features"])

    ddl = ", ".join(f"{c} {t}" for c, t in carry.items()) + ", features array<double>"
    return rows.select(*carry, "text").mapInArrow(run, ddl).withColumn("features", array_to_vector("features"))


class Model:
    """Lexicon, trees and calibration; or a constant score."""

    def __init__(self, lexicon=None, trees=None, calibration=None, constant=None):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id and score of every row."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        if self.constant is not None:
            return rows.select("doc_id", F.lit(self.constant).alias("score"))
        raw = self.trees.transform(_featured(rows, self.lexicon, {"doc_id": "long"}))
        raw = raw.select("doc_id", vector_to_array("probability")[1].alias("raw"))
        calibrated = self.calibration.transform(raw).select("doc_id", "raw", "prediction")
        # The step function ties many scores; a hundredth of the trees' own probability orders them.
        return calibrated.select("doc_id", (F.col("prediction") * 0.99 + F.col("raw") * 0.01).alias("score"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``labels`` (doc_id, toxic) of ``docs``."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = cut_lineage(known)
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    chosen = None
    for kind in (0, 1):
        part = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE)
        chosen = part if chosen is None else chosen.union(part)
    part = F.pmod(F.xxhash64(F.lit("part"), "label_id"), F.lit(4))
    # At most 2 * SAMPLE ids.
    sample = cut_lineage(docs.select("doc_id", "text").join(F.broadcast(chosen.withColumn("part", part)), F.col("doc_id") == F.col("label_id"))
                         .select("text", "toxic", "part"))
    found = {(r["part"], r["toxic"]): r["n"] for r in sample.groupBy("part", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(found.get((p, kind), 0) < LEAST for p in range(4) for kind in (0, 1)):
        return Model(constant=sizes.get(1, 0) / total if total else 0.0)
    lexicon = learn_lexicon(sample.where("part < 2"))
    weight = F.when(F.col("toxic") == 1, max(1.0, sizes[1] / SAMPLE)).otherwise(max(1.0, sizes[0] / SAMPLE))
    featured = _featured(sample.where("part >= 2"), lexicon, {"toxic": "int", "part": "long"})
    rows = featured.select(vector_to_array("features").alias("values"), F.col("toxic").cast("double").alias("label"), "part", weight.alias("weight"))
    rows = cut_lineage(rows).select(array_to_vector("values").alias("features"), "label", "part", "weight")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=64, seed=1, weightCol="weight").fit(rows.where("part = 2"))
    raw = trees.transform(rows.where("part = 3")).select(vector_to_array("probability")[1].alias("raw"), "label", "weight")
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(raw)
    return Model(lexicon, trees, calibration)
