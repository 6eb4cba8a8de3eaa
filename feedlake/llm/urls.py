"""URL filters: rules on hosts and paths, and for the rest a character language-model ratio.

A rule fits its host and all subdomains if the path starts with the rule's; the longest fitting rule decides. Urls that no
rule fits are judged by two smoothed Markov models of variable order, one of accepted and one of rejected urls: the
difference of their log-likelihoods by character, held against a threshold. The models learn from urls that rules decide,
and the threshold is calibrated on every tenth of those (by hash of the url), which the models do not see: it is where the
mean of the two classes' error rates is least.

Urls become strings of 32 symbols (letters without case, any digit, . - / _ and "other"). Probabilities of order k blend
the counts behind a context with those of order k - 1 (Witten-Bell), so long contexts count where they were seen often.
With ``ORDER`` 3 a model has at most 32**4 cells, whatever the input: that bounds what the driver and tasks hold. Counts
are gathered over all urls, summed in each task first.

Null urls and those without :// have an empty host and path, fit no rule, and are judged like any other by the model. If no rule
fits any url of a class, the models know nothing and the verdict is ``DEFAULT``. Ties at the threshold are accepted. Equal urls
get equal verdicts. Only page_id and url are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import LOWER, UPPER

ALLOW, BLOCK, DEFAULT = "allow", "block", "allow"
ORDER, SYMBOLS, BINS, RANGE = 3, 32, 4000, 8.0
CELLS = SYMBOLS ** (ORDER + 1)
#: Symbol of each byte: 0 stands before the first character, 1-26 letters, 27 digits, 28-31 the rest.
_SYMBOL = np.full(256, 31, np.uint8)
for _k, (_up, _low) in enumerate(zip(UPPER, LOWER), 1):
    _SYMBOL[ord(_up)] = _SYMBOL[ord(_low)] = _k
_SYMBOL[ord("0"):ord("9") + 1] = 27
for _k, _c in enumerate("./-", 28):
    _SYMBOL[ord(_c)] = _k


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rules(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, url, host, path, rule and verdict (null where no rule fits); ``rules`` are (verdict, host/path)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, rest = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return rows.withColumns({"rule": none if rule is None else rule, "verdict": none if verdict is None else verdict})


def cells(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cell of every character (its context of ``ORDER`` symbols, then itself) and the index of its url."""
    urls = urls.cast(pa.large_string()).fill_null("")
    _, offsets, data = urls.buffers()
    at = np.frombuffer(offsets, np.int64)[urls.offset:urls.offset + len(urls) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.empty(0, np.uint8)
    size = np.diff(at)
    which = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(raw)) - np.repeat(at[:-1] - at[0], size)
    symbol = _SYMBOL[raw].astype(np.int64)
    cell = symbol.copy()
    for k in range(1, ORDER + 1):
        back = np.zeros(len(raw), np.int64)
        back[k:] = symbol[:-k] if k < len(raw) else 0
        cell += np.where(place >= k, back, 0) * SYMBOLS ** k
    return cell, which


def learn(rows: DataFrame) -> np.ndarray | None:
    """Log-ratio of the two models for every cell, from ``rows`` (url, accepted); None if a class is missing."""
    def run(batches):
        total = np.zeros((2, CELLS), np.int64)
        for batch in batches:
            accepted = batch.column("accepted").to_numpy(zero_copy_only=False).astype(np.int64)
            cell, which = cells(batch.column("url"))
            total += np.bincount(accepted[which] * CELLS + cell, minlength=2 * CELLS).reshape(2, CELLS)
        kind, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(cell, pa.int32()), pa.array(total[kind, cell])], ["kind", "cell", "n"])

    counts = np.zeros((2, CELLS))
    summed = rows.select("url", "accepted").mapInArrow(run, "kind int, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n"))
    for row in summed.toLocalIterator():
        counts[row["kind"], row["cell"]] = row["n"]
    if not counts.sum(axis=1).all():
        return None
    return (np.log(_smoothed(counts[1])) - np.log(_smoothed(counts[0]))).astype(np.float32)


def _smoothed(counts: np.ndarray) -> np.ndarray:
    """Probability of the last symbol of every cell, orders blended from 0 up by Witten-Bell weights."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for k in range(ORDER + 1):
        # Counts of order k: sum over the symbols further back, which lead the cell's number.
        c = counts.reshape(-1, SYMBOLS ** k, SYMBOLS).sum(axis=0)
        n, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        lower = np.tile(p.reshape(-1, SYMBOLS), (SYMBOLS if k else 1, 1))[:SYMBOLS ** k]
        p = np.where(n > 0, (c + kinds * lower) / np.maximum(n + kinds, 1), lower)
    return p.ravel()


def with_scores(rows: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``rows`` with the mean log-ratio by character, 0 for an empty url."""
    def run(batches):
        for batch in batches:
            cell, which = cells(batch.column("url"))
            n = np.bincount(which, minlength=batch.num_rows)
            total = np.bincount(which, weights=ratio[cell], minlength=batch.num_rows)
            score = pa.array(total / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, "score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{ddl}, score double")


def threshold(scored: DataFrame) -> float:
    """Score from which urls are accepted: least mean error rate of both classes, nearest to 0 of equals; ``scored`` has
    accepted and score. Scores are counted in ``BINS`` bins."""
    bin_of = F.floor((F.least(F.greatest("score", F.lit(-RANGE)), F.lit(RANGE)) + RANGE) / (2 * RANGE) * BINS)
    counts = np.zeros((2, BINS + 1))
    for row in scored.groupBy(F.col("accepted").cast("int").alias("kind"), bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["kind"], row["bin"]] = row["n"]
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    # Error if bins from k on are accepted: accepted ones below k, rejected ones from k on.
    error = np.r_[0, np.cumsum(share[1])] + np.r_[np.cumsum(share[0][::-1])[::-1], 0]
    best = np.flatnonzero(error <= error.min() + 1e-12)
    k = best[np.argmin(np.abs(best - BINS / 2))]
    return float(k / BINS * 2 * RANGE - RANGE)


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule decides or nothing was learned)."""
    rows = with_rules(pages, rules)
    decided = rows.where(F.col("verdict").isNotNull() & F.col("url").isNotNull()).select("url", (F.col("verdict") == ALLOW).alias("accepted"))
    tenth = F.pmod(F.xxhash64("url"), F.lit(10)) == 0
    ratio = learn(decided.where(~tenth))
    if ratio is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    limit = threshold(with_scores(decided.where(tenth), ratio))
    judged = F.when(F.col("score") >= limit, ALLOW).otherwise(BLOCK)
    return with_scores(rows, ratio).select("page_id", "host", "path", "rule", F.coalesce("verdict", judged).alias("verdict"),
                                           F.when(F.col("rule").isNull(), F.col("score")).alias("score"))
