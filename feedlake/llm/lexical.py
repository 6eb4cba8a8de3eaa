"""Ranked lexical search by presence masks: for each item the documents are grouped by which of its terms they hold.

Documents are packed in blocks of ``BLOCK`` with the postings of the terms that items may hold, and items in packs of
``PACK``; a block meets a pack in one row of a join. In it, each document gets a bit mask of the item's terms (one "or" a
term over its postings), equal masks form a group, and a mask's largest possible score is the sum over its terms of weight
times the block's largest term part. Masks are scored by falling bound, and the item is done with the block when the next
bound is below the ``TOP``-th best score that the task has seen. Each task returns at most ``TOP`` documents an item, of
which the best are taken. All scores are 64-bit integers and exact.

Which terms a block keeps is decided by a bitmap of fixed size over the hashes of all items' terms; a term kept by an
equal hash is in no item and does no harm. Counts (documents, terms, documents a term) are over all documents.

Terms are the longest runs of letters A-Z (lower-cased), digits and characters beyond ASCII. Null and empty texts have no terms: such
documents do not count, such items return nothing. Every row is a document or an item of its own, so repeated rows are
ranked and returned each time; null doc_ids come first among equal scores. An empty table gives an empty result. Very long texts
count like any other. Only doc_id, item_id and text are read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedlake.session import cut_lineage

TOP, BLOCK, PACK = 50, 2048, 128
#: Slots of the bitmap of terms; words that a task remembers, and their longest length.
SLOTS, KNOWN, LONGEST = 1 << 20, 300_000, 40
NULL_ID = -2**63
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def _item_terms(batches):
    for batch in batches:
        found = [sorted(set(terms(t.as_py()))) for t in batch.column(2)]
        which = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]).astype(np.int64))
        flat = [t for f in found for t in f]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(flat, pa.binary()),
                                          pa.array([zlib.crc32(t) % SLOTS for t in flat], pa.int32())], ["item", "item_id", "term", "slot"])


BLOCKS = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()),
                    ("terms", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("at", pa.binary()), ("tf", pa.binary())])
BLOCKS_DDL = "block long, n long, total long, ids binary, lengths binary, terms array<binary>, sizes array<int>, at binary, tf binary"


def _blocks(bitmap: bytes):
    bits = np.frombuffer(bitmap, bool)

    def build(batches):
        known: dict[bytes, bool] = {}
        ids, lengths, postings = [], [], {}

        def close():
            order = sorted(postings)
            at = [np.array(postings[t][0], np.int32) for t in order]
            tf = [np.array(postings[t][1], np.int64) for t in order]
            row = {"block": zlib.crc32(np.array(ids, np.int64).tobytes()), "n": sum(x > 0 for x in lengths), "total": sum(lengths),
                   "ids": np.array(ids, np.int64).tobytes(), "lengths": np.array(lengths, np.int64).tobytes(), "terms": order,
                   "sizes": [len(a) for a in at], "at": b"".join(a.tobytes() for a in at), "tf": b"".join(t.tobytes() for t in tf)}
            return pa.RecordBatch.from_pylist([row], BLOCKS)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = Counter(terms(text.as_py()))
                lengths.append(counts.total())
                for term, times in counts.items():
                    keep = known.get(term)
                    if keep is None:
                        keep = bool(bits[zlib.crc32(term) % SLOTS])
                        if len(term) <= LONGEST:
                            if len(known) >= KNOWN:
                                known.clear()
                            known[term] = keep
                    if keep:
                        own = postings.get(term)
                        if own is None:
                            own = postings[term] = ([], [])
                        own[0].append(len(ids))
                        own[1].append(times)
                ids.append(NULL_ID if doc is None else doc)
                if len(ids) >= BLOCK:
                    yield close()
                    ids, lengths, postings = [], [], {}
        if ids:
            yield close()

    return build


def masks(places: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, distinct masks as rows of bits, mask number of each document) of those in any of the posting lists."""
    words = np.zeros((size, -(-len(places) // 64)), np.uint64)
    for k, at in enumerate(places):
        words[at, k // 64] |= np.uint64(1 << (k % 64))
    docs = np.flatnonzero(words.any(axis=1))
    if words.shape[1] == 1:
        distinct, number = np.unique(words[docs, 0], return_inverse=True)
        distinct = distinct[:, None]
    else:
        distinct, number = np.unique(words[docs], axis=0, return_inverse=True)
    bits = np.unpackbits(np.ascontiguousarray(distinct).view(np.uint8), axis=1, bitorder="little")[:, :len(places)]
    return docs, bits, number.ravel()


def best(places, parts, weights, size: int, ids: np.ndarray, top: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ``TOP`` best (scores, ids) of a block's documents and of ``top``; ``places`` and ``parts`` are the item's postings."""
    docs, bits, number = masks(places, size)
    bound = bits.astype(np.int64) @ np.array([w * int(p.max()) for w, p in zip(weights, parts)], np.int64)
    order = np.argsort(-bound, kind="stable")
    amount = np.cumsum(np.bincount(number, minlength=len(order))[order])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    begin, wish = 0, 2 * TOP
    while begin < len(order) and not (len(top[0]) >= TOP and bound[order[begin]] < top[0][-1]):
        end = int(np.searchsorted(amount, (amount[begin - 1] if begin else 0) + wish)) + 1
        chosen = np.zeros(size, bool)
        mine = docs[(rank[number] >= begin) & (rank[number] < end)]
        chosen[mine] = True
        scores = np.zeros(size, np.int64)
        for at, part, weight in zip(places, parts, weights):
            pick = chosen[at]
            scores[at[pick]] += weight * part[pick]
        all_scores, all_ids = np.r_[top[0], scores[mine]], np.r_[top[1], ids[mine]]
        keep = np.lexsort((all_ids, -all_scores))[:TOP]
        keep = keep[all_scores[keep] > 0]
        top = (all_scores[keep], all_ids[keep])
        begin, wish = end, 2 * wish
    return top


RANKED = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _rank(count: int, total: int):
    """``count`` documents with terms, ``total`` terms."""

    def run(batches):
        current, tops = None, {}

        def close():
            rows = [(item, doc, score) for item, (scores, ids) in tops.items() for score, doc in zip(scores.tolist(), ids.tolist())]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], schema=RANKED)

        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in ("pack", "ids", "lengths", "at", "tf")}
                if row["pack"].as_py() != current:
                    if tops:
                        yield close()
                    current, tops = row["pack"].as_py(), {}
                ids, lengths, at, tf = (np.frombuffer(row[c].as_py(), t) for c, t in (("ids", np.int64), ("lengths", np.int64), ("at", np.int32), ("tf", np.int64)))
                m = np.array([50 + 50 * n * count // total for n in lengths.tolist()], np.int64)
                part = 1_000_000_000 * tf // (1000 * tf + 20 * m[at])
                ends = np.cumsum(np.array(batch.column("sizes")[k].as_py(), np.int64)).tolist()
                where = {t: (a, b) for t, a, b in zip(batch.column("terms")[k].as_py(), [0, *ends], ends)}
                for item in batch.column("items")[k].as_py():
                    own = [(*where[t["term"]], t["weight"]) for t in item["terms"] if t["term"] in where]
                    if own:
                        none = np.empty(0, np.int64)
                        tops[item["item"]] = best([at[a:b] for a, b, _ in own], [part[a:b] for a, b, _ in own], [w for *_, w in own],
                                                  len(ids), ids, tops.get(item["item"], (none, none)))
        if tops:
            yield close()

    return run


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``TOP`` best documents."""
    spark = docs.sparkSession
    numbered = cut_lineage(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    id_type = numbered.schema["item_id"].dataType.simpleString()
    asked = cut_lineage(numbered.mapInArrow(_item_terms, f"item long, item_id {id_type}, term binary, slot int"))
    bitmap = np.zeros(SLOTS, bool)
    wide = F.shiftrightunsigned("slot", 5).alias("word")
    for word, bits in asked.groupBy(wide).agg(F.expr("bit_or(shiftleft(1L, slot % 32))").alias("bits")).collect():
        bitmap[32 * word:32 * word + 32] = [bits >> k & 1 for k in range(32)]
    blocks = cut_lineage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_blocks(bitmap.tobytes()), BLOCKS_DDL))
    count, total = blocks.agg(F.sum("n"), F.sum("total")).first()
    if not count:
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    held = blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.sizes").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * count + 2)) / (2 * F.col("df") + 1)))
    weighted = asked.join(held, "term").select("item", "term", weight.alias("weight"))
    whole = weighted.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    amount = max(1, -(-numbered.count() // PACK))
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packs = whole.groupBy(F.pmod(F.xxhash64("item"), F.lit(amount)).cast("int").alias("pack")).agg(
        F.collect_list(F.struct("item", "terms")).alias("items"))
    # A pack is copied to every share, so that no share holds more than its part of the blocks however few packs there are.
    packs = cut_lineage(packs).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    rows = blocks.select("ids", "lengths", "terms", "sizes", "at", "tf", F.pmod("block", F.lit(shares)).cast("int").alias("share"),
                         F.explode(F.sequence(F.lit(0), F.lit(amount - 1))).alias("pack"))
    met = rows.join(packs, ["pack", "share"]).sortWithinPartitions("pack")
    found = met.mapInArrow(_rank(int(count), int(total)), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return numbered.select("item", "item_id").join(top, "item").select(
        "item_id", "rank", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "score")
