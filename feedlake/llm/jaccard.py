"""N-gram Jaccard join by a token-group matrix: classes of documents linked by a chain of similar texts.

Texts are lower-cased (A-Z), cut in words, and become the set of their distinct shingles of ``SHINGLE`` words (the whole
sequence if shorter). Two documents link when 100 * intersection >= ``PERCENT`` * union. The result names each class by
its smallest doc_id. No pair of a class is listed:

1. Sets without a possible partner are put aside. With shingles in the order of their hashes, linked sets share at least
   k of their first n - overlap + k shingles, so a set with fewer shared ones among these has no link. Which are shared
   is found by counting hashes of all documents in ranges of the hash.
2. Equal sets are folded to one representative (smallest doc_id).
3. Similar representatives are partitioned into groups: those with the same smallest hash are compared with up to
   ``LEADERS`` leaders of the run, twice with different hashes; verified links are joined to groups.
4. The token-group matrix holds which group has which shingle. A group whose union shares too few shingles with all
   others is finished. For the rest, each query's rarest shingles name the groups it may link to; members are held in
   parts with the union of their shingles (of each two groups it is enough to open the sets that share nearly all); a part is opened only if |query n union| reaches the overlap that a link needs.
   One link joins two groups, whatever their sizes.

Steps 1 to 3 only save work; step 4 is exact for what they leave. Shingles are compared as 64-bit hashes.

Null or empty texts and texts without words have an empty set and are linked with nothing. Rows with one doc_id are one
document with several texts: its class joins all of them. A null doc_id is one such id. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedlake.llm.components import connected
from feedlake.session import cut_lineage

SHINGLE, PERCENT = 5, 75
LEADERS, PART, QUERIES = 8, 64, 256
#: Shingles a task gathers before it hands on a block, and shingles counted together in a range of the hash.
BLOCK, RANGE = 2_000_000, 2_000_000
NULL_ID = -2**63
MANY = -2**63 + 1
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    total = np.full(n, np.uint64(width))
    for k in range(width):
        total = mix(total ^ (h[k:k + n] * _MUL[k]))
    return np.unique(total)


def overlap(n) -> int:
    """Least number of shared shingles in a link of a set of n."""
    return -(-PERCENT * n // 100)


def extra(n) -> int:
    return max(1, 15 * n // 100)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _batch(schema, **columns):
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


PROFILE = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("sid", pa.binary())])


def _profiles(batches):
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column("text")]
        yield _batch(PROFILE, key=batch.column("key"), n=[len(s) for s in sets], sid=[digest(s) if len(s) else None for s in sets])


BLOCKS = pa.schema([("p", pa.int32()), ("codes", pa.binary()), ("owners", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])
BLOCKS_DDL = "p int, codes binary, owners binary, owner long, n long"


def _blocks(pairs, ranges: int):
    """From (owner, hashes): blocks of hashes by range with one owner each (``MANY`` if the block has several), and the
    owners' numbers of hashes that are shared within the block."""
    held, owners, size = [], [], 0

    def flush():
        nonlocal held, owners, size
        if not held:
            return
        tokens = np.concatenate(held)
        who = np.repeat(np.array(owners, np.int64), [len(x) for x in held])
        order = np.lexsort((who, tokens))
        tokens, who = tokens[order], who[order]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (who[1:] != who[:-1])
        tokens, who = tokens[fresh], who[fresh]
        first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        count = np.diff(np.r_[first, len(tokens)])
        several = np.repeat(count > 1, count)
        known, times = np.unique(who[several], return_counts=True)
        tokens, who = tokens[first], np.where(count > 1, MANY, who[first])
        code = mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
        p = (code % np.uint64(ranges)).astype(np.int32)
        code = code >> np.uint64(24)
        order = np.lexsort((who, p))
        p, code, who = p[order], code[order], who[order]
        cuts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        ends = np.r_[cuts[1:], len(p)]
        raw = code.view(np.uint8).reshape(-1, 8)[:, :5]
        yield _batch(BLOCKS, p=p[cuts], codes=[raw[a:b].tobytes() for a, b in zip(cuts, ends)],
                     owners=[who[a:b].tobytes() for a, b in zip(cuts, ends)], owner=[None] * len(cuts), n=[None] * len(cuts))
        if len(known):
            yield _batch(BLOCKS, p=[-1 - int(k) % ranges for k in known], codes=[None] * len(known),
                         owners=[None] * len(known), owner=known, n=times)
        held, owners, size = [], [], 0

    for owner, tokens in pairs:
        if len(tokens):
            held.append(tokens)
            owners.append(owner)
            size += len(tokens)
        if size >= BLOCK:
            yield from flush()
    yield from flush()


CREDIT = pa.schema([("owner", pa.int64()), ("n", pa.int64())])


def _credits(batches):
    """Owners' numbers of hashes that another owner has too, range by range; rows come sorted by range."""
    current, codes, owners = None, [], []

    def close():
        if not codes:
            return
        code = np.concatenate(codes)
        who = np.concatenate(owners)
        order = np.lexsort((who, code))
        code, who = code[order], who[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        last = np.r_[first[1:], len(code)] - 1
        size = np.diff(np.r_[first, len(code)])
        shared = np.repeat((who[first] != who[last]) | (who[first] == MANY), size) & (who != MANY)
        if shared.any():
            pairs = np.unique(np.stack([code[shared].view(np.int64), who[shared]]), axis=1) if len(code) else None
            known, times = np.unique(pairs[1], return_counts=True)
            yield _batch(CREDIT, owner=known, n=times)

    for batch in batches:
        for p, c, o, owner, n in zip(*(batch.column(x) for x in ("p", "codes", "owners", "owner", "n"))):
            if owner.is_valid:
                yield _batch(CREDIT, owner=[owner.as_py()], n=[n.as_py()])
                continue
            if p.as_py() != current:
                yield from close()
                current, codes, owners = p.as_py(), [], []
            raw = np.frombuffer(c.as_py(), np.uint8).reshape(-1, 5)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :5] = raw
            codes.append(wide.view(np.uint64).ravel())
            owners.append(np.frombuffer(o.as_py(), np.int64))
    yield from close()


def _shared(blocks: DataFrame) -> DataFrame:
    """(owner, shared): how many of its hashes another owner has; never too low."""
    counted = blocks.where("p >= 0").repartition("p").sortWithinPartitions("p").mapInArrow(_credits, "owner long, n long")
    local = blocks.where("p < 0").select("owner", "n")
    return counted.union(local).groupBy("owner").agg(F.sum("n").alias("shared"))


SETS = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("sid", pa.binary()), ("tokens", pa.binary()), ("central", pa.int64()),
                  ("k0", pa.int64()), ("k1", pa.int64())])
SETS_DDL = "key long, n long, sid binary, tokens binary, central long, k0 long, k1 long"


def _sets(batches):
    for batch in batches:
        rows = []
        for key, text, sid, central in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("sid").to_pylist(),
                                           batch.column("central").to_pylist()):
            tokens = shingles(text.as_py())
            if len(tokens) and digest(tokens) == sid:
                keys = [int(mix(tokens * m).min().view(np.int64)) for m in _MUL[:2]]
                rows.append((key, len(tokens), sid, tokens.tobytes(), central, *keys))
        if rows:
            yield _batch(SETS, **dict(zip(SETS.names, zip(*rows))))


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _stars(batches):
    """Rows come sorted by group key, sets that share most with others first, as these make leaders that many are similar
    to: link each set to the first leader of its run that is similar."""
    current, leaders = None, []
    for batch in batches:
        found = []
        for group, key, tokens in zip(batch.column("group").to_pylist(), batch.column("key").to_pylist(), batch.column("tokens")):
            if group != current:
                current, leaders = group, []
            own = np.frombuffer(tokens.as_py(), np.uint64)
            near = next((k for k, t in leaders if linked(own, t)), None)
            if near is not None:
                found.append((key, near))
            elif len(leaders) < LEADERS:
                leaders.append((key, own))
        if found:
            yield _batch(LINKS, a=[x[0] for x in found], b=[x[1] for x in found])


def _open(batches):
    """Rows come sorted by part, members first: open the part for each query whose bound allows a link."""
    current, members, union = None, [], None
    for batch in batches:
        found = []
        columns = [batch.column(c).to_pylist() for c in ("component", "part", "salt", "query", "key")]
        for component, part, salt, query, key, tokens in zip(*columns, batch.column("tokens")):
            if (component, part, salt) != current:
                current, members, union = (component, part, salt), [], None
            own = np.frombuffer(tokens.as_py(), np.uint64)
            if not query:
                members.append((key, own))
                continue
            if union is None:
                union = np.unique(np.concatenate([t for _, t in members]))
            if len(np.intersect1d(own, union, assume_unique=True)) < overlap(len(own)):
                continue
            near = next((k for k, t in members if linked(own, t)), None)
            if near is not None:
                found.append((key, near))
        if found:
            yield _batch(LINKS, a=[x[0] for x in found], b=[x[1] for x in found])


def _explode(batches):
    for batch in batches:
        for part in (batch.slice(k, 200) for k in range(0, batch.num_rows, 200)):
            own = [np.frombuffer(t, np.int64) for t in part.column("tokens").to_pylist()]
            which = pa.array(np.repeat(np.arange(len(own)), [len(t) for t in own]))
            names = ["sid", "key", "component", "n", "size"]
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(which) for c in names), pa.array(np.concatenate(own))], [*names, "token"])


def _across(sets: DataFrame, exact: bool) -> DataFrame:
    """Links (a, b) between different groups of ``sets`` (key, n, sid, tokens, component). Exact: at least one for each two
    groups that have any. Otherwise only those of a set with the most central sets of the largest group that has one of its
    rarest shingles, which joins what is left of large groups at a cost that grows with the number of sets.
    """
    sizes = sets.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    tokens = cut_lineage(sets.join(sizes, "component").select("sid", "key", "component", "n", "size", "tokens").mapInArrow(
        _explode, "sid binary, key long, component long, n long, size long, token long"))
    matrix = tokens.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                         F.count(F.lit(1)).alias("times")).where("low < high").select("token", "times")
    by_set = Window.partitionBy("sid", "key")
    met = tokens.join(matrix, "token").withColumns({
        "common": F.count(F.lit(1)).over(by_set), "rank": F.row_number().over(by_set.orderBy("times", "token"))})
    need = F.ceil(F.col("n") * PERCENT / 100).cast("long")
    # Of a set only its shingles that other groups have can be in a link: c of n. A link of sets of n and m needs 3 (n + m)
    # <= 7 c in both, so m <= fits; if both had fits < n, each would be smaller than the other. One is "dense" then, and
    # it is enough to hold all sets against the dense ones of other groups, those of the smaller group against the larger.
    fits = F.floor((7 * F.col("common") - 3 * F.col("n")) / 3)
    prefix = cut_lineage(met.where((F.col("common") >= need) & (F.col("rank") <= F.col("common") - need + 1))
                         .select("token", "sid", "key", "component", "n", "size", "common", fits.alias("fits"), (fits >= F.col("n")).alias("dense")))
    groups = prefix.where("dense").groupBy("token", F.col("component").alias("other")).agg(
        F.min("n").alias("least"), F.max("fits").alias("most"), F.first("size").alias("other_size"))
    dense = prefix.where("dense").select("sid", "key", "component", (F.col("common") / F.col("n")).alias("share")).distinct()
    if not exact:
        groups = groups.groupBy("token").agg(F.max_by(F.struct("other", "least", "most", "other_size"), F.struct("other_size", "other")).alias("g")).select("token", "g.*")
        best = Window.partitionBy("component").orderBy(F.desc("share"), "sid", "key")
        dense = dense.withColumn("place", F.row_number().over(best)).where(F.col("place") <= PART)
    smaller = F.struct("size", "component") < F.struct(F.col("other_size").alias("size"), F.col("other").alias("component"))
    pairs = prefix.join(groups, "token").where((F.col("component") != F.col("other")) & (F.col("least") <= F.col("fits"))
                                               & (F.col("most") >= F.col("n")) & (smaller | ~F.col("dense")))
    pairs = cut_lineage(pairs.select("sid", "key", "other").distinct())
    opened = sets.join(dense.select("sid", "key"), ["sid", "key"], "left_semi")
    parts = opened.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    asked = pairs.groupBy(F.col("other").alias("component")).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("salts"))
    plan = parts.join(asked, "component")
    members = opened.join(plan, "component").select(
        "component", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("query"), "key", "tokens")
    queries = (pairs.join(sets.select("sid", "key", "tokens"), ["sid", "key"]).withColumnRenamed("other", "component")
               .join(plan, "component").select(
        "component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("query"), "key", "tokens"))
    spot = ["component", "part", "salt"]
    queries = queries.join(members.select(*spot).distinct(), spot, "left_semi")
    return members.union(queries).repartition(*spot).sortWithinPartitions(*spot, "query").mapInArrow(_open, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"), "text")
    profile = cut_lineage(rows.mapInArrow(_profiles, "key long, n long, sid binary"))
    total = profile.agg(F.sum("n")).first()[0] or 0
    ranges = max(256, math.ceil(0.4 * total / RANGE))

    def candidates(batches):
        def pairs():
            for batch in batches:
                for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                    s = shingles(text.as_py())
                    yield key, s[:len(s) - overlap(len(s)) + extra(len(s))]
        yield from _blocks(pairs(), ranges)

    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * PERCENT / 100) * 15 / 100))
    shared = _shared(cut_lineage(rows.mapInArrow(candidates, BLOCKS_DDL)))
    possible = cut_lineage(profile.where("n > 0").join(shared, F.col("key") == F.col("owner")).where(F.col("shared") >= need)
                           .select("key", "n", "sid", F.floor(1000 * F.col("shared") / F.col("n")).alias("central")))
    first = possible.groupBy("sid").agg(F.min("key").alias("key"), F.max("central").alias("central"))
    sets = cut_lineage(rows.join(first, "key").mapInArrow(_sets, SETS_DDL))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stars = None
    for k, seed in (("k0", 1), ("k1", 2)):
        run = sets.select(F.col(k).alias("group"), F.xxhash64("sid", F.lit(seed)).alias("spread"), "central", "key", "tokens")
        found = run.repartitionByRange(parts, "group", "spread").sortWithinPartitions("group", F.desc("central"), "spread").mapInArrow(_stars, "a long, b long")
        stars = found if stars is None else stars.union(found)
    # A doc_id with several texts links the representatives of all of them.
    many = possible.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").select("key")
    same = possible.join(many, "key", "left_semi").select("key", "sid").join(first.select("sid", F.col("key").alias("b")), "sid").select("key", "b")
    groups = cut_lineage(connected(stars.union(sets.select("key", F.col("key").alias("b"))).union(same)))

    grouped = cut_lineage(sets.join(groups, F.col("key") == F.col("node")).select("key", "n", "sid", "tokens", "component"))

    def by_group(batches):
        def pairs():
            for batch in batches:
                for component, tokens in zip(batch.column("component").to_pylist(), batch.column("tokens")):
                    yield component, np.frombuffer(tokens.as_py(), np.uint64)
        yield from _blocks(pairs(), ranges)

    touched = _shared(cut_lineage(grouped.select("component", "tokens").mapInArrow(by_group, BLOCKS_DDL)))
    least = grouped.groupBy("component").agg(F.ceil(F.min("n") * PERCENT / 100).alias("need"))
    open_groups = least.join(touched, F.col("component") == F.col("owner")).where("shared >= need").select("component")
    left = cut_lineage(grouped.join(open_groups, "component").select("key", "n", "sid", "tokens", "component"))
    for exact in (False, True):
        found = _across(left, exact)
        groups = cut_lineage(connected(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found)))
        left = cut_lineage(left.drop("component").join(groups, F.col("key") == F.col("node")).drop("node"))

    named = first.join(groups, F.col("key") == F.col("node")).select("sid", "component")
    of_doc = possible.join(named, "sid").groupBy("key").agg(F.min("component").alias("component"))
    return profile.join(of_doc, "key", "left").select(
        F.when(F.col("key") != NULL_ID, F.col("key")).alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.coalesce("component", "key") != NULL_ID, F.coalesce("component", "key")).alias("component_id"))
