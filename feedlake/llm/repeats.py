"""Repeated passages by common-prefix interval trees of enhanced suffix arrays, over bounded groups of contexts.

A byte goes when a string of ``WIDTH`` bytes over it also starts elsewhere, in any document, as given. The work:

1. Texts that are equal are folded to one, with the number of their copies.
2. Of each window of ``WIDTH`` bytes the smallest hash of ``GRAM`` bytes is its anchor (the leftmost of several). Equal windows
   have equal anchors at equal places, so a window whose anchor hash occurs once is not repeated. Hashes are counted; some
   one in 180 bytes is an anchor.
3. Around each repeated anchor the bytes of its windows are cut out: a context. Equal contexts are folded too, so the
   inside of a passage that a third of all documents share is one row.
4. Contexts with one hash are a family. Families of at most ``FAMILY`` contexts are packed together and get a suffix
   array with longest common prefixes. Runs of common prefixes of ``WIDTH`` bytes or more are scanned with
   a stack that builds the tree of common-prefix intervals; an interval whose suffixes follow different bytes is a maximal
   repeat, and all its suffixes are its occurrences. Each suffix is listed with its deepest interval, whose ``parent`` is the
   next shorter repeat it belongs to.
5. A larger family is split by where the anchor lies in the window: windows with the anchor in the first half of its range
   share the bytes all of them have in common, and so for the second half. Each half is cut to its bytes, folded and
   gathered by the shared bytes again. A range of one place leaves equal windows only, so after nine rounds no family is
   left, however many documents share a passage; no group ever has to be held in one task.

Null and empty texts have no bytes. Copies of one text are elsewhere to each other, so all of their bytes go if they have
``WIDTH``. Rows with repeated or null doc_id are documents of their own. An empty table gives an empty result. Texts may be
of any length; what is found in one is merged in one task. Hashes only choose what to compare; digests of 128 bits name equal
contexts. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.session import cut_lineage

WIDTH, GRAM = 400, 32
PLACES = WIDTH - GRAM
#: Contexts a suffix array may take from one family, and bytes that are sorted together.
FAMILY, BATCH = 500, 1 << 19
#: Windows whose anchors are found together (their places have 16 bits).
CHUNK = 1 << 14
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, big end first."""
    x = raw.astype(np.uint64)
    for k in (1, 2, 4):
        x = (x[:-k] << np.uint64(8 * k)) | x[k:]
    return x


def _hashes(raw: np.ndarray) -> np.ndarray:
    w = words(raw)
    n = len(raw) - GRAM + 1
    h = w[:n] * _MUL[0]
    for k in range(8, GRAM, 8):
        h = (h + w[k:k + n]) * _MUL[0]
    h ^= h >> np.uint64(32)
    h *= _MUL[1]
    return h ^ (h >> np.uint64(29))


def anchors(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, hash, place, low, high) of the anchors of texts that lie behind each other in ``raw``, each of at least
    WIDTH bytes: an anchor is that of the windows that start at place - high .. place - low."""
    windows = len(raw) - WIDTH + 1
    places, values = np.empty(windows, np.int64), np.empty(windows, np.int64)
    for at in range(0, windows, CHUNK):
        h = _hashes(raw[at:at + CHUNK + WIDTH - 1])
        # The upper 48 bits of a hash and, to take the leftmost of equal ones, its place in the chunk.
        low = (h & ~np.uint64(0xFFFF)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= PLACES + 1:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        rest = PLACES + 1 - span
        low = np.minimum(low[:len(low) - rest], low[rest:]) & np.uint64(0xFFFF)
        places[at:at + len(low)] = low.astype(np.int64) + at
        values[at:at + len(low)] = h.view(np.int64)[low]
    begin = np.cumsum(sizes) - sizes
    start = np.concatenate([np.arange(a, a + n - WIDTH + 1) for a, n in zip(begin.tolist(), sizes.tolist())])
    place = places[start]
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    text = np.searchsorted(begin, start[first], "right") - 1
    place = place[first]
    return text, values[start[first]], place - begin[text], place - start[last], place - start[first]


def _name(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def _number(*values: int) -> bytes:
    return b"".join(int(v).to_bytes(8, "little", signed=True) for v in values)


MARKS_DDL = "hash long, tid long, place long, low int, high int"


def _marks(batches):
    for batch in batches:
        tids = np.asarray(batch.column(0), np.int64)
        texts, first, size = [], 0, 0
        for k, text in enumerate(batch.column(1)):
            texts.append(text.as_py().encode())
            size += len(texts[-1])
            if size >= BATCH or k == batch.num_rows - 1:
                number, value, place, low, high = anchors(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(tids[first + number]), pa.array(place), pa.array(low.astype(np.int32)),
                                                  pa.array(high.astype(np.int32))], ["hash", "tid", "place", "low", "high"])
                texts, first, size = [], k + 1, 0


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


CUT = pa.schema([("cid", pa.binary()), ("tid", pa.int64()), ("place", pa.int64()), ("key", pa.binary()), ("low", pa.int32()),
                 ("high", pa.int32()), ("context", pa.binary())])
CUT_DDL = "cid binary, tid long, place long, key binary, low int, high int, context binary"


def _cut(batches):
    """Contexts of the marked places of each text; the bytes of a context are handed on where the task first meets it."""
    seen: set[bytes] = set()
    for batch in batches:
        rows = []
        for tid, text, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            raw = text.as_py().encode()
            for m in marks:
                place, low, high = m["place"], m["low"], m["high"]
                key, context = _number(m["hash"]), raw[place - high:place - low + WIDTH]
                cid = _name(key, _number(low, high), context)
                rows.append((cid, tid, place, key, low, high, None if cid in seen else context))
                seen.add(cid)
            if len(rows) >= 5000:
                yield _rows(CUT, rows)
                rows = []
            if len(seen) > 500_000:
                seen.clear()
        if rows:
            yield _rows(CUT, rows)


def windows(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the WIDTH bytes from each start: differences of running sums of byte * multiplier ** place, moved to place 0."""
    power = np.full(len(raw), _MUL[0])
    power[0] = 1
    power = np.cumprod(power)
    total = np.r_[np.uint64(0), np.cumsum(raw * power)]
    back = np.full(len(raw), _INVERSE)
    back[0] = 1
    return (total[starts + WIDTH] - total[starts]) * np.cumprod(back)[starts]


def common_prefix(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    differ = int.from_bytes(a[:size]) ^ int.from_bytes(b[:size])
    return size - (differ.bit_length() + 7) // 8


class SuffixArray:
    """Suffixes of several byte strings in order, with the common prefixes of neighbours, for suffixes at given starts.

    Suffixes whose first WIDTH bytes no other one has, or which all of those that have them continue to the left by the same
    byte, lie in no maximal repeat; they are left out, which a hash of the window decides without harm (equal windows have
    equal hashes).
    """

    def __init__(self, strings: list[bytes], starts: list[range]):
        sizes = np.array([len(s) for s in strings])
        begin = np.cumsum(sizes) - sizes
        joined = b"".join(strings)
        raw = np.frombuffer(joined, np.uint8)
        at = np.concatenate([np.arange(r.start, r.stop) + b for r, b in zip(starts, begin)])
        owner = np.repeat(np.arange(len(strings)), [len(r) for r in starts])
        left = np.where(at == begin[owner], -1 - owner, raw[at - 1].astype(np.int64))
        code = windows(raw, at)
        order = np.argsort(code)
        code, sorted_left = code[order], left[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        diverse = np.minimum.reduceat(sorted_left, first) != np.maximum.reduceat(sorted_left, first)
        chosen = order[np.repeat(diverse, np.diff(np.r_[first, len(code)]))]
        ends = (begin + sizes)[owner]
        suffixes = {k: joined[at[k]:ends[k]] for k in chosen.tolist()}
        order = np.array(sorted(suffixes, key=suffixes.get), np.int64)
        self.owner, self.start, self.left = owner[order], (at - begin[owner])[order], left[order]
        pairs = [(suffixes[a], suffixes[b]) for a, b in zip(order[:-1].tolist(), order[1:].tolist())]
        #: Bytes that suffix k shares with suffix k - 1; the first shares none.
        self.common = np.array([0, *(common_prefix(a, b) for a, b in pairs)][:len(order)], np.int64)

    def maximal(self):
        """(suffixes, length, node, parent) of the maximal repeats of WIDTH or more: each suffix with its deepest one."""
        long = self.common >= WIDTH
        first = np.flatnonzero(long & ~np.r_[False, long[:-1]]) - 1
        last = np.flatnonzero(long & ~np.r_[long[1:], False])
        for a, b in zip(first.tolist(), last.tolist()):
            left = self.left[a:b + 1]
            if left.min() != left.max():  # else all of the run goes on to the left
                yield from self._scan(a, self.common[a + 1:b + 1].tolist(), left.tolist())

    def _scan(self, at: int, common: list[int], left: list[int]):
        """Stack scan of one run: nodes [length, parent, least and greatest byte before]; parents end with smaller numbers."""
        nodes: list[list[int]] = []
        own = [-1] * len(left)
        stack: list[int] = []

        def close(length: int) -> None:
            """Finish the nodes longer than ``length``."""
            while stack and nodes[stack[-1]][0] > length:
                node = nodes[stack.pop()]
                if stack and nodes[stack[-1]][0] >= length:
                    above = stack[-1]
                else:
                    if length < WIDTH:
                        return
                    nodes.append([length, -1, node[2], node[3]])
                    above = len(nodes) - 1
                    stack.append(above)
                node[1] = above
                nodes[above][2] = min(nodes[above][2], node[2])
                nodes[above][3] = max(nodes[above][3], node[3])

        for k, length in enumerate([*common, 0]):
            # Suffix k belongs to the deeper of the prefixes it shares with its neighbours.
            before = common[k - 1] if k else 0
            if length > before:
                nodes.append([length, -1, left[k], left[k]])
                stack.append(len(nodes) - 1)
                own[k] = stack[-1]
            else:
                own[k] = stack[-1]
                node = nodes[own[k]]
                node[2], node[3] = min(node[2], left[k]), max(node[3], left[k])
                close(length)
        for k, node in enumerate(own):
            while node >= 0 and nodes[node][2] == nodes[node][3]:
                node = nodes[node][1]
            if node >= 0:
                above = nodes[node][1]
                yield at + k, nodes[node][0], nodes[above][0] if above >= 0 else 0


FOUND = pa.schema([("cid", pa.binary()), ("start", pa.int32()), ("length", pa.int32()), ("group", pa.binary()), ("parent", pa.binary())])
FOUND_DDL = "cid binary, start int, length int, group binary, parent binary"


def _families(batches):
    """Rows come sorted by family: its contexts' repeats, places counted from the anchor."""

    def rows():
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "cid", "low", "high", "n", "context")]
            yield from zip(*columns)

    def packs():
        pack, size = [], 0
        for _, family in itertools.groupby(rows(), key=lambda r: r[0]):
            own = list(family)
            pack.append(own)
            size += sum(len(r[5]) for r in own)
            if size >= BATCH:
                yield pack
                pack, size = [], 0
        if pack:
            yield pack

    for pack in packs():
        out = [(cid, -high, len(context), _name(context), None) for own in pack for _, cid, _, high, n, context in own if n > 1]
        several = [r for own in pack if len(own) > 1 for r in own]
        if several:
            array = SuffixArray([r[5] for r in several], [range(r[3] - r[2] + 1) for r in several])
            for k, length, above in array.maximal():
                _, cid, _, high, _, context = several[int(array.owner[k])]
                start = int(array.start[k])
                out.append((cid, start - high, length, _name(context[start:start + length]),
                            _name(context[start:start + above]) if above else None))
        if out:
            yield _rows(FOUND, out)


HALF = pa.schema([("parent", pa.binary()), ("cid", pa.binary()), ("key", pa.binary()), ("least", pa.int32()), ("most", pa.int32()),
                  ("low", pa.int32()), ("high", pa.int32()), ("n", pa.int64()), ("context", pa.binary())])
HALF_DDL = "parent binary, cid binary, key binary, least int, most int, low int, high int, n long, context binary"


def _halves(batches):
    """Each context of a large family cut to the windows of either half of the places that the family's anchor may have."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            middle = (r["least"] + r["most"]) // 2
            for least, most in ((r["least"], middle), (middle + 1, r["most"])):
                low, high = max(r["low"], least), min(r["high"], most)
                if low > high:
                    continue
                cut = r["high"] - high
                context = r["context"][cut:cut + high - low + WIDTH]
                core = context[high - least:high - most + WIDTH]
                key = _name(r["key"], _number(least), core)
                out.append((r["cid"], _name(key, _number(low, high), context), key, least, most, low, high, r["n"], context))
        if out:
            yield _rows(HALF, out)


def occurrences(texts: DataFrame) -> DataFrame:
    """(tid, start, length, group, parent) of the maximal repeats in ``texts`` (tid long, text of WIDTH bytes or more, all
    different): ``group`` names the repeated bytes, ``parent`` the next shorter repeat that this one lies in."""
    marks = cut_lineage(texts.select("tid", "text").mapInArrow(_marks, MARKS_DDL))
    # Written, so that the join has an exchange on either side and adaptive execution may split a hash that many places have.
    several = cut_lineage(marks.groupBy("hash").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("hash"))
    places = (marks.join(several, "hash", "left_semi").groupBy("tid")
              .agg(F.collect_list(F.struct("hash", "place", "low", "high")).alias("marks")))
    cut = cut_lineage(texts.select("tid", "text").join(places, "tid").select("tid", "text", "marks").mapInArrow(_cut, CUT_DDL))
    times = cut_lineage(cut.groupBy("cid").agg(F.count(F.lit(1)).alias("n")))
    folded = cut.where("context is not null").select("cid", "key", "low", "high", "context").distinct().join(times, "cid")
    level = folded.withColumns({"least": F.lit(0), "most": F.lit(PLACES)})
    found, links = [], []
    columns = ["cid", "key", "least", "most", "low", "high", "n", "context"]
    while True:
        level = cut_lineage(level.select(*columns))
        sizes = level.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        over = cut_lineage(sizes.where(F.col("size") > FAMILY).select("key"))
        # Dealt by a hash of the key: after a join by the key itself Spark takes repartition("key") for done and leaves it out, and
        # adaptive execution, which sees no need of mapInArrow, may then deal the join by its map tasks or split it, families too.
        small = level.join(over, "key", "left_anti").select(*columns).repartition(F.xxhash64("key"))
        found.append(small.sortWithinPartitions("key").mapInArrow(_families, FOUND_DDL))
        if over.isEmpty():
            break
        large = level.join(over, "key", "left_semi")
        halves = cut_lineage(large.select(*columns).mapInArrow(_halves, HALF_DDL))
        links.append(halves.select("cid", "parent"))
        level = halves.groupBy("cid", "key", "least", "most", "low", "high", "context").agg(F.sum("n").alias("n"))
    up = None
    for own, link in zip(reversed(found), [*reversed(links), None]):
        up = cut_lineage(own if up is None else own.union(up))
        if link is not None:
            up = up.join(link.withColumnRenamed("parent", "_over"), "cid").select(
                F.col("_over").alias("cid"), "start", "length", "group", "parent")
    return cut.select("cid", "tid", "place").join(up, "cid").select(
        "tid", (F.col("place") + F.col("start")).alias("start"), "length", "group", "parent")


CLEANED = pa.schema([("tid", pa.int64()), ("sha", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                     ("kept", pa.binary())])
SPANS_DDL = "tid long, sha string, spans array<struct<start: long, stop: long>>, kept binary"


def _merge(batches):
    for batch in batches:
        rows = []
        for tid, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            raw = text.as_py().encode()
            merged: list[list[int]] = []
            for start, stop in sorted((s["start"], s["stop"]) for s in spans):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], stop)
                else:
                    merged.append([start, stop])
            kept, at = [], 0
            for start, stop in merged:
                kept.append(raw[at:start])
                at = stop
            kept.append(raw[at:])
            rows.append((tid, hashlib.sha256(raw).hexdigest(), [{"start": a, "stop": b} for a, b in merged], b"".join(kept)))
        if rows:
            yield _rows(CLEANED, rows)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(tid, text, copies) of the texts of WIDTH bytes or more, written: the numbers stay."""
    texts = docs.select("text").where(F.octet_length("text") >= WIDTH).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return cut_lineage(texts.select(F.monotonically_increasing_id().alias("tid"), "text", "copies"))


def cleaned_texts(texts: DataFrame) -> DataFrame:
    """(sha, spans, kept) of the distinct texts that lose anything: sha-256 of the text, what goes, what stays."""
    gone = occurrences(texts).select("tid", "start", (F.col("start") + F.col("length")).alias("stop")).distinct()
    gone = gone.union(texts.where("copies > 1").select("tid", F.lit(0).cast("long"), F.octet_length("text").cast("long")))
    spans = gone.groupBy("tid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return texts.select("tid", "text").join(spans, "tid").select("tid", "text", "spans").mapInArrow(_merge, SPANS_DDL).drop("tid")


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every document."""
    cleaned = cleaned_texts(distinct_texts(docs)).select(
        "sha", "spans", F.octet_length("kept").alias("n_kept"), F.sha2("kept", 256).alias("kept_sha"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    none = F.array().cast("array<struct<start: long, stop: long>>")
    return rows.join(cut_lineage(cleaned), "sha", "left").select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.coalesce("n_kept", "n_bytes")).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256"),
        F.coalesce("spans", none).alias("spans"))
