"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased. A benchmark item and a document that share a run of ``TILE`` words
(of all its words, if the item is shorter) are a candidate. Greedy string tiling then marks the longest run of words
that both have unmarked, again and again down to ``TILE`` words; Karp-Rabin hashes find each run and the words are
compared. The share of the item's words under tiles is its coverage: passages whose parts were reordered keep it. Items
covered to ``COVERAGE`` or more are reported with the document.

The benchmark is the query set: it is taken in blocks of at most ``BLOCK_WORDS`` words, each sent to all tasks and held
against all documents. Documents are streamed, never shuffled or grouped.

Ties of equally long runs go by the place in the item, then in the document. Null or empty documents and items without a
word match nothing. A repeated row is reported again; items with one id are separate items. An empty benchmark gives no
rows. Only doc_id, text, item_id and text are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.jaccard import mix
from feedlake.session import cut_lineage

TILE, COVERAGE = 5, 0.75
BLOCK_WORDS = 1_000_000
RUN = re.compile(r"[^\W_]+")
_BASE = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[str]:
    return RUN.findall(text.lower()) if text else []


def hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes modulo 2**64 of all windows of ``width`` ids, by doubling the width."""
    powers = {1: mix(ids.astype(np.uint64) + np.uint64(1))}
    done = 1
    while done * 2 <= width:
        h = powers[done]
        powers[done * 2] = h[:-done] * np.uint64(pow(_BASE, done, 2**64)) + h[done:] if len(h) > done else h[:0]
        done *= 2
    total, at = None, 0
    for size in sorted(powers, reverse=True):
        if at + size > width:
            continue
        part = powers[size][at:]
        total = part if total is None else total[:len(part)] * np.uint64(pow(_BASE, size, 2**64)) + part[:len(total)]
        at += size
    return total[:max(0, len(ids) - width + 1)]


def _free(marked: np.ndarray, width: int) -> np.ndarray:
    """Windows without a marked word."""
    c = np.r_[0, np.cumsum(marked)]
    return c[width:] == c[:-width] if len(marked) >= width else np.zeros(0, bool)


def _common(a, b, taken_a, taken_b, width):
    """Places of the first run of ``width`` unmarked words that both have, or None."""
    at_a, at_b = np.flatnonzero(_free(taken_a, width)), np.flatnonzero(_free(taken_b, width))
    if not len(at_a) or not len(at_b):
        return None
    ha, hb = hashes(a, width)[at_a], hashes(b, width)[at_b]
    for k in np.flatnonzero(np.isin(ha, hb)):
        i = at_a[k]
        for j in at_b[hb == ha[k]]:
            if np.array_equal(a[i:i + width], b[j:j + width]):
                return int(i), int(j)
    return None


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the greedy tiling; negative ids match nothing."""
    taken_a, taken_b = a < 0, b < 0
    found, longest = [], min(len(a), len(b))
    while True:
        low, high, best = least, longest, None
        while low <= high:
            mid = (low + high) // 2
            at = _common(a, b, taken_a, taken_b, mid)
            if at is None:
                high = mid - 1
            else:
                best, low = (*at, mid), mid + 1
        if best is None:
            return found
        i, j, n = best
        taken_a[i:i + n] = taken_b[j:j + n] = True
        found.append(best)
        longest = n


class Block:
    """Items of one block, their vocabulary and the hashes of their seeds, one sorted list for each seed width."""

    def __init__(self, items: list[tuple[int | None, list[str]]], coverage: float):
        self.coverage = coverage
        self.vocabulary: dict[str, int] = {}
        self.items = []
        for item_id, w in items:
            self.items.append((item_id, np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], np.int64)))
        by_width: dict[int, list] = {}
        for k, (_, ids) in enumerate(self.items):
            h = hashes(ids, width := min(TILE, len(ids)))
            by_width.setdefault(width, []).append((h, np.full(len(h), k), np.arange(len(h))))
        self.seeds = {}
        for width, parts in by_width.items():
            h, item, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            self.seeds[width] = h[order], item[order], place[order]

    def matches(self, text: str | None):
        """(item_id, words of the item, tiles, words under tiles) of every item covered enough."""
        get = self.vocabulary.get
        w = words(text)
        ids = np.array([get(x, -1) for x in w], np.int64)
        for width, (seed, item, place) in self.seeds.items():
            at = np.flatnonzero(_free(ids < 0, width))
            if not len(at):
                continue
            h = hashes(ids, width)[at]
            low = np.searchsorted(seed, h, "left")
            hit = (low < len(seed)) & (seed[np.minimum(low, len(seed) - 1)] == h)
            if not hit.any():
                continue
            at, low = at[hit], low[hit]
            count = np.searchsorted(seed, h[hit], "right") - low
            which = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            places = np.repeat(at, count)
            for k in np.unique(item[which]):
                own = item[which] == k
                item_id, a = self.items[k]
                under = np.zeros(len(a) + 1, np.int64)
                starts = np.unique(place[which[own]])
                np.add.at(under, starts, 1)
                np.add.at(under, starts + width, -1)
                if np.count_nonzero(np.cumsum(under)[:-1]) < self.coverage * len(a):
                    continue
                # Only words inside a seed can lie under a tile; the rest of the document shrinks to single barriers.
                inside = np.zeros(len(ids) + 1, np.int64)
                starts = np.unique(places[own])
                np.add.at(inside, starts, 1)
                np.add.at(inside, starts + width, -1)
                inside = np.cumsum(inside)[:-1] > 0
                keep = inside | np.r_[False, inside[:-1]]
                found = tiles(a, np.where(inside, ids, -1)[keep], width)
                under_tiles = sum(n for _, _, n in found)
                if under_tiles >= self.coverage * len(a):
                    yield item_id, len(a), len(found), under_tiles


def blocks(benchmark: DataFrame, coverage: float):
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        w = words(row["text"])
        if w:
            held.append((row["item_id"], w))
            size += len(w)
        if size >= BLOCK_WORDS:
            yield Block(held, coverage)
            held, size = [], 0
    if held:
        yield Block(held, coverage)


DDL = "doc_id long, item_id long, test_words long, n_tiles long, matched_words long, coverage double"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("test_words", pa.int64()), ("n_tiles", pa.int64()),
                    ("matched_words", pa.int64()), ("coverage", pa.float64())])


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row for each document and benchmark item that it covers to ``coverage`` or more."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in blocks(benchmark, coverage):
        def scan(batches, block=block):
            for batch in batches:
                found = [(doc_id, item_id, n, t, m, m / n) for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"))
                         for item_id, n, t, m in block.matches(text.as_py())]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), SCHEMA)], schema=SCHEMA)
        part = cut_lineage(rows.mapInArrow(scan, DDL))
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], DDL) if out is None else out
