"""Vector operators: cosine search with pre-filter, exact batch neighbours, near-duplicates, user profiles.

Batch neighbours are exact and never form a cross join. Base rows are laid out once by cell around pivots, whose number
grows with the root of the table; the triangle inequality on angles tells which cells can hold a neighbour of a query.
Neighbouring cells form groups, some twenty or so, and a query goes once to each group that has a cell it must see: queries are
copied by groups, not by cells. Groups are cut in parts of bounded size; a task holds one part and streams the queries past it,
so neither side has to fit in memory. There a query skips the blocks of rows that cannot hold a neighbour. The base is copied
only to keep all tasks busy: copies times parts stays near twice the number of shuffle partitions, however many queries there are.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.functions import expressions as E
from feedlake.functions.ordering import top_per_group
from feedlake.session import cut_lineage

#: Base rows a task holds, and rows of them that are compared at a time.
BLOCK_ROWS = 32768
SCAN = 2048
#: Pivots for each root of the number of base rows: cells hold some 2 / ROOTS * root(n) rows, and the driver that many pivots.
ROOTS = 0.5
#: Queries compared at a time, rows handed on at a time, and rows the lists of the queries compared at a time may hold.
TILE = 512
OUT_ROWS = 10_000
HELD = 524_288
DIGITS = 6
SLACK = 2e-6


# ---- single query, JVM only ------------------------------------------------------------------------

def similar_to(embeddings: DataFrame, allowed: DataFrame, content_id: int, k: int = 10, level: int = 2) -> DataFrame:
    """Contents most similar to one content among those allowed at ``level``: filter first, then rank."""
    query_vector = embeddings.filter(F.col("contenido_id") == content_id).select("embedding").limit(1).scalar()
    pool = embeddings.filter(F.col("contenido_id") != content_id).withColumn("__q", query_vector).join(
        allowed.filter(F.col("nivel_acceso") <= level).select("contenido_id"), "contenido_id", "left_semi")
    return pool.select("contenido_id", F.round(E.cosine_similarity(F.col("embedding"), F.col("__q")), DIGITS)
                       .alias("similitud")).orderBy(F.col("similitud").desc(), F.col("contenido_id")).limit(k)


def post_filtered(embeddings: DataFrame, allowed: DataFrame, content_id: int, fetch: int, level: int) -> DataFrame:
    """What survives when the ``fetch`` nearest are taken first and filtered afterwards."""
    query_vector = embeddings.filter(F.col("contenido_id") == content_id).select("embedding").limit(1).scalar()
    nearest = embeddings.filter(F.col("contenido_id") != content_id).withColumn("__q", query_vector).select(
        "contenido_id", F.round(E.cosine_similarity(F.col("embedding"), F.col("__q")), DIGITS).alias("similitud")
    ).orderBy(F.col("similitud").desc(), F.col("contenido_id")).limit(fetch)
    return nearest.join(allowed.filter(F.col("nivel_acceso") <= level).select("contenido_id"), "contenido_id", "left_semi")


# ---- blocks ------------------------------------------------------------------------------------------

def _unit(column: pd.Series) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype(np.float64)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _angles(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ centres.T, -1.0, 1.0))


def choose_pivots(base: DataFrame, n: int) -> np.ndarray:
    """``n`` vectors picked by the hash of their id."""
    rows = base.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(n).collect()
    return _unit(pd.Series([np.asarray(r.v) for r in rows]))


def _arrange(queries: DataFrame, base: DataFrame, k: int | None, angle: float | None = None,
             centres: np.ndarray | None = None, probes: int | None = None, cap: int | None = None):
    """(queries once per group of cells to visit, base rows with their group, rows per group); with ``probes``, by cell."""
    n = base.count()
    if centres is None:
        centres = choose_pivots(base, max(1, math.ceil(ROOTS * math.sqrt(n))))
    if not len(centres):
        return queries.withColumn("cell", F.lit(0)), base.withColumn("cell", F.lit(0)), np.array([0])
    cells = cut_lineage(_in_cells(base, centres))
    bounds = _Bounds(cells, len(centres), k, angle, cap)
    count = bounds.stats["count"]
    if probes is not None:
        return _meeting_cells(queries, centres, bounds, probes), cells.drop("angle"), count
    # As many groups as make the copies of the queries and those of the base about as many rows.
    tasks = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = _groups(centres, count, max(math.ceil(n / BLOCK_ROWS), round(math.sqrt(2 * tasks * n / max(queries.count(), 1)))))
    placed = cells.drop("angle").withColumnRenamed("cell", "place").withColumn("cell", _of_cell(groups, F.col("place")))
    return _meeting_cells(queries, centres, bounds, groups=groups), placed, np.bincount(groups, count).astype(np.int64)


def _of_cell(values: np.ndarray, cell: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(x)) for x in values]), cell + 1)


def _groups(centres: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Group of each cell: cells in order of the nearest of ``n`` pivots, cut where a share of the rows is full."""
    n = max(1, min(n, len(centres)))
    a = _angles(centres, centres[:n])
    order = np.lexsort((a.min(axis=1), a.argmin(axis=1)))
    middle = count[order].cumsum() - count[order] / 2
    cut = np.minimum((middle * n / max(count.sum(), 1)).astype(np.int64), n - 1)
    out = np.zeros(len(centres), np.int64)
    out[order] = np.unique(cut, return_inverse=True)[1]
    return out


def _in_cells(base: DataFrame, centres: np.ndarray) -> DataFrame:
    """Base rows with their nearest pivot and the angle to it."""
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in _tiles(batch):
                a = _angles(_unit(pdf["v"]), centres)
                yield pdf.assign(cell=a.argmin(axis=1).astype("int32"), angle=a.min(axis=1))

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInPandas(assign, f"{names}, cell int, angle double")


def _tiles(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    return (pdf.iloc[at:at + TILE] for at in range(0, len(pdf), TILE))


def _repeated(pdf: pd.DataFrame, need: np.ndarray, near: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows once per column marked in ``need``, a bounded number at a time: a query may need all of many cells."""
    q, c = np.nonzero(need)
    for at in range(0, len(q), OUT_ROWS):
        some = q[at:at + OUT_ROWS]
        out = pdf.iloc[some].reset_index(drop=True)
        out["cell"], out["place"] = c[at:at + OUT_ROWS].astype("int32"), near[some].astype("int32")
        yield out


def _meeting_cells(queries: DataFrame, centres: np.ndarray, bounds, probes: int | None = None,
                   groups: np.ndarray | None = None) -> DataFrame:
    """Queries repeated once per cell they must visit, or once per group of cells that has one, with their nearest pivot."""
    stats = bounds.stats

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in _tiles(batch):
                a = _angles(_unit(pdf["v"]), centres)
                near = a.argmin(axis=1)
                if probes is not None:
                    rank = a.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
                    need = rank < probes
                else:
                    limit = bounds.limit(a, pdf["level"].to_numpy())
                    nearest = np.cos(np.maximum(a - stats["radius"], 0.0))
                    need = nearest + SLACK >= np.cos(np.minimum(limit, math.pi))[:, None]
                need &= stats["count"] > 0
                if groups is not None:
                    need = np.stack([need[:, groups == g].any(axis=1) for g in range(groups.max() + 1)], axis=1)
                yield from _repeated(pdf, need, near)

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)
    return queries.mapInPandas(visit, f"{names}, cell int, place int")


class _Bounds:
    """How far a query may have to look, from figures per cell that are few whatever the table's size."""

    def __init__(self, cells: DataFrame, n_cells: int, k: int | None, angle: float | None, cap: int | None = None):
        self.k, self.angle = k, angle
        count, radius = np.zeros(n_cells, dtype="int64"), np.zeros(n_cells)
        for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect():
            count[r.cell], radius[r.cell] = r.n, r.r
        self.stats = {"count": count, "radius": radius}
        self.reach: dict[int, np.ndarray] = {}
        if k is not None and angle is None:
            # The k + 1 rows of each cell and level nearest to the pivot: a query is at most its own angle to the
            # pivot plus theirs away from k rows other than itself. With a cap by group, the nearest that keep to it: a
            # group's best rows are at least as near as those, so the k-th row of the capped list is too.
            rows = cells.select("cell", "level", "angle", *(["grp"] if cap else []))
            if cap:
                rows = top_per_group(rows, ["cell", "level", "grp"], [F.col("angle").asc()], cap, "__g").drop("__g")
            inner = sorted(top_per_group(rows, ["cell", "level"], [F.col("angle").asc()], k + 1, "n").collect(), key=lambda r: r.angle)
            for level in sorted({r.level for r in inner}):
                far = np.full(n_cells, math.pi)
                near: dict[int, int] = {}
                used: dict[tuple[int, int], int] = {}
                for r in inner:
                    if r.level > level or (cap and used.get((r.cell, r.grp), 0) >= cap):
                        continue
                    if cap:
                        used[r.cell, r.grp] = used.get((r.cell, r.grp), 0) + 1
                    near[r.cell] = near.get(r.cell, 0) + 1
                    if near[r.cell] == k + 1:
                        far[r.cell] = r.angle
                self.reach[level] = far

    def limit(self, angles: np.ndarray, levels: np.ndarray) -> np.ndarray:
        if self.angle is not None:
            return np.full(len(angles), self.angle)
        out = np.full(len(angles), math.pi)
        for level in np.unique(levels):
            known = [v for v in self.reach if v <= level]
            if known:
                mine = levels == level
                out[mine] = np.minimum((angles[mine] + self.reach[max(known)]).min(axis=1), math.pi)
        return out


@dataclass
class _Rows:
    """Rows of one side as arrays; vectors have unit length."""

    id: np.ndarray
    level: np.ndarray
    grp: np.ndarray
    own: np.ndarray
    place: np.ndarray
    v: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> "_Rows":
        v = np.asarray(batch.column("v").flatten(), np.float64).reshape(batch.num_rows, -1)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
        return cls(*(np.asarray(batch.column(c)) for c in ("id", "level", "grp")), batch.column("own").to_numpy(zero_copy_only=False),
                   np.asarray(batch.column("place")), v)

    @classmethod
    def joined(cls, parts: list["_Rows"]) -> "_Rows":
        return cls(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(cls)))

    def rows(self, at: slice) -> "_Rows":
        return _Rows(*(getattr(self, f.name)[at] for f in fields(self)))

    @cached_property
    def blocks(self) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """Runs of rows of neighbouring places, up to ``SCAN`` each, with their mean direction and the largest angle to it."""
        ends, spans, start = [*np.flatnonzero(self.place[1:] != self.place[:-1]) + 1, len(self.id)], [], 0
        for at, stop in itertools.pairwise([*ends, len(self.id)]):
            if at > start and stop - start > SCAN // 2:
                spans += [(i, min(i + SCAN, at)) for i in range(start, at, SCAN)]
                start = at
        spans += [(i, min(i + SCAN, len(self.id))) for i in range(start, len(self.id), SCAN)]
        mean = np.stack([self.v[a:b].mean(axis=0) for a, b in spans])
        size = np.linalg.norm(mean, axis=1, keepdims=True)
        mean = np.divide(mean, size, out=np.zeros_like(mean), where=size > 0)
        wide = [_angles(self.v[a:b], mean[i:i + 1]).max() if size[i, 0] > 0 else math.pi for i, (a, b) in enumerate(spans)]
        return spans, mean, np.asarray(wide)

    def reach(self, v: np.ndarray) -> np.ndarray:
        """The highest similarity each row of ``v`` can have in each block."""
        _, mean, wide = self.blocks
        most = np.cos(np.maximum(_angles(v, mean) - wide, 0.0)) + SLACK
        return np.where(np.isnan(most), 2.0, most)


def _meet(queries: DataFrame, base: DataFrame, sizes: np.ndarray, block_rows: int, fn, schema: str, k: int = 1) -> DataFrame:
    """``fn(queries, base)`` for every query and every part of a cell it must visit: a part is held, queries stream past it.

    ``fn`` returns its rows, or yields them in pieces. It keeps up to ``k`` rows of the part for each query, so it gets fewer queries at a time
    where lists are long.
    """
    size = max(1, min(TILE, HELD // k))
    counts = [max(1, math.ceil(n / block_rows)) for n in sizes]
    parts = F.create_map(*[x for c, n in enumerate(counts) for x in (F.lit(c), F.lit(n))])
    tasks = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = max(1, math.ceil(2 * tasks / sum(counts)))
    columns = ["id", "v", "level", "grp", "own", "place", "cell", "part", "copy", "query"]
    # Single precision is shuffled as such, and widened in the task.
    kind = "array<float>" if all(df.schema["v"].dataType.simpleString() == "array<float>" for df in (queries, base)) else "array<double>"
    b = (base.withColumn("part", F.pmod(F.xxhash64("id"), parts[F.col("cell")]).cast("int"))
         .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))))
    q = (queries.withColumn("part", F.explode(F.sequence(F.lit(0), parts[F.col("cell")] - 1)))
         .withColumn("copy", F.pmod(F.xxhash64("id"), F.lit(copies)).cast("int")))

    def side(df: DataFrame, query: bool) -> DataFrame:
        names = set(df.columns)
        return df.select("id", F.col("v").cast(kind).alias("v"), "level",
                         (F.col("grp") if "grp" in names else F.lit(0).cast("long")).alias("grp"),
                         (F.col("own") if "own" in names else F.lit(False)).alias("own"),
                         (F.col("place") if "place" in names else F.lit(0)).alias("place"), "cell", "part", "copy", F.lit(query).alias("query"))

    spot = ["cell", "part", "copy"]
    rows = side(b, False).union(side(q, True)).repartition(*spot).sortWithinPartitions(*spot, "query", "place").select(*columns)

    def stream(batches):
        current, held, base_rows = None, [], None
        for batch in batches:
            marks = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in spot]
                             + [batch.column("query").to_numpy(zero_copy_only=False).astype(np.int64)])
            cuts = np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(axis=0)]) if batch.num_rows else []
            for at, stop in itertools.pairwise([*cuts, batch.num_rows]):
                key, run = tuple(marks[:3, at]), _Rows.of(batch.slice(at, stop - at))
                if key != current:
                    current, held, base_rows = key, [], None
                if not marks[3, at]:
                    held.append(run)
                elif held:
                    if base_rows is None:
                        base_rows = _Rows.joined(held)
                    for tile in range(0, len(run.id), size):
                        found = fn(run.rows(slice(tile, tile + size)), base_rows)
                        for piece in [found] if isinstance(found, dict) else found:
                            yield pa.RecordBatch.from_pydict(piece)

    return rows.mapInArrow(stream, schema)


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Position of each row inside its run of equal ``keys``; rows are already sorted by them."""
    new = np.zeros(len(keys[0]), dtype=bool)
    if len(new):
        new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return np.arange(len(new)) - start


def _best_in_block(k: int, per_group: int | None):
    """The ``k`` best rows of a part for each query, block by block: a row below the k-th so far is not looked at again."""
    def chosen(r, c, s, base):
        if per_group is not None:
            order = np.lexsort((base.id[c], -s, base.grp[c], r))
            r, c, s = r[order], c[order], s[order]
            keep = _rank(r, base.grp[c]) < per_group
            r, c, s = r[keep], c[keep], s[keep]
        order = np.lexsort((base.id[c], -s, r))
        r, c, s = r[order], c[order], s[order]
        at = _rank(r)
        return r[at < k], c[at < k], s[at < k], at[at < k]

    def best(q: _Rows, base: _Rows) -> dict[str, np.ndarray]:
        r, c, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        kth, reach, spans = np.full(len(q.id), -np.inf), base.reach(q.v), base.blocks[0]
        for block in (-reach.mean(axis=0)).argsort(kind="stable"):
            rows = np.flatnonzero(reach[:, block] >= kth)
            if not len(rows):
                continue
            lo, hi = spans[block]
            sim = q.v[rows] @ base.v[lo:hi].T
            floor = kth[rows]
            new = np.flatnonzero(np.isneginf(floor))
            if per_group is None and len(new) and hi - lo > k:
                ours = sim[new]
                ours[(base.level[None, lo:hi] > q.level[rows[new], None]) | np.isnan(ours)
                     | ((base.id[None, lo:hi] == q.id[rows[new], None]) & q.own[rows[new], None])] = -np.inf
                floor[new] = np.partition(ours, hi - lo - k, axis=1)[:, hi - lo - k]
            a, b = np.nonzero(sim >= (floor - SLACK)[:, None])
            a, b, found = rows[a], b + lo, np.round(sim[a, b], DIGITS)
            ok = np.isfinite(found) & (base.level[b] <= q.level[a]) & ~((base.id[b] == q.id[a]) & q.own[a])
            r, c, s, at = chosen(np.r_[r, a[ok]], np.r_[c, b[ok]], np.r_[s, found[ok]], base)
            kth[r[at == k - 1]] = s[at == k - 1]
        return {"id": q.id[r], "other": base.id[c], "sim": s, "grp": base.grp[c]}

    return best


def nearest(queries: DataFrame, base: DataFrame, k: int, per_group: int | None = None, same_space: bool = False,
            centres: np.ndarray | None = None, probes: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact ``k`` nearest base rows of every query: (id, other, sim, puesto).

    ``queries``: id, v, level. ``base``: id, v, level, grp. A base row is allowed when its level does not
    exceed the query's. ``per_group`` caps rows of one ``grp`` per query; ``same_space`` drops a row from its
    own list. Giving ``probes`` makes the search approximate: only that many nearest cells are visited.
    """
    schema = "id bigint, other bigint, sim double, grp bigint"
    q = queries.select(F.col("id").cast("long").alias("id"), "v", F.col("level").cast("int").alias("level"),
                       F.lit(same_space).alias("own"))
    b = base.select(F.col("id").cast("long").alias("id"), "v", F.col("level").cast("int").alias("level"),
                    F.col("grp").cast("long").alias("grp"))
    # Both sides are read several times below (sizes, pivots, search), so each is computed once.
    q, b = cut_lineage(q), cut_lineage(b)
    visits, cells, sizes = _arrange(q, b, k, None, centres, probes, per_group)
    found = _meet(visits, cells, sizes, block_rows, _best_in_block(k, per_group), schema, k)
    order = [F.col("sim").desc(), F.col("other").asc()]
    if per_group is not None:
        found = top_per_group(found, ["id", "grp"], order, per_group, "__g").drop("__g")
    return top_per_group(found, ["id"], order, k, "puesto")


def near_duplicates(embeddings: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs above ``threshold``: (contenido_a, contenido_b, similitud), the smaller id first.

    Exact copies are folded first. A group of n copies is listed as n - 1 pairs with its lowest id, and takes
    part in other pairs through that id, so the result stays linear in the number of copies. Zero vectors have no
    direction and are in no pair.
    """
    embeddings = embeddings.filter(F.exists("embedding", lambda x: x != 0))
    copies = embeddings.groupBy("embedding").agg(F.min("contenido_id").alias("rep"))
    member = embeddings.join(copies, "embedding").filter(F.col("contenido_id") != F.col("rep")).select(
        F.col("rep").alias("contenido_a"), F.col("contenido_id").alias("contenido_b"), F.lit(1.0).alias("similitud"))
    base = copies.select(F.col("rep").cast("long").alias("id"), F.col("embedding").alias("v"), F.lit(0).alias("level"))
    base = cut_lineage(base)

    def above(q: _Rows, other: _Rows) -> Iterator[dict[str, np.ndarray]]:
        reach = other.reach(q.v)
        for block, (lo, hi) in enumerate(other.blocks[0]):
            rows = np.flatnonzero(reach[:, block] >= threshold)
            sim = q.v[rows] @ other.v[lo:hi].T
            r, c = np.nonzero(sim > threshold - SLACK)
            a, b, s = rows[r], c + lo, np.round(sim[r, c], DIGITS)
            ok = (s > threshold) & (q.id[a] < other.id[b])
            if ok.any():
                yield {"contenido_a": q.id[a[ok]], "contenido_b": other.id[b[ok]], "similitud": s[ok]}

    visits, cells, sizes = _arrange(base, base, None, math.acos(max(-1.0, min(1.0, threshold))))
    pairs = _meet(visits, cells, sizes, block_rows, above,
                  "contenido_a bigint, contenido_b bigint, similitud double")
    return pairs.unionByName(member)


def kmeans_centres(base: DataFrame, lists: int = 50, seed: int = 42) -> np.ndarray:
    """Centres of the inverted lists, from distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = base.select(array_to_vector(F.col("v").cast("array<double>")).alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(points)
    return _unit(pd.Series([np.asarray(c) for c in model.clusterCenters()]))


@dataclass(frozen=True)
class _Lists:
    """Rows, mean vector and variance per dimension of each inverted list: figures per list, few whatever the table's size."""

    count: np.ndarray
    mean: np.ndarray
    variance: np.ndarray

    @staticmethod
    def of(cells: DataFrame, n_lists: int, dim: int) -> _Lists:
        """Sums are added up in the tasks; the driver gets one row a list."""
        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, total = np.zeros(n_lists, dtype=np.int64), np.zeros((n_lists, dim))
            for pdf in batches:
                if len(pdf):
                    at = pdf["cell"].to_numpy()
                    n += np.bincount(at, minlength=n_lists)
                    np.add.at(total, at, _unit(pdf["v"]))
            c = np.nonzero(n)[0]
            if len(c):
                yield pd.DataFrame({"cell": c.astype("int32"), "n": n[c], "total": list(total[c])})

        partial = cells.mapInPandas(sums, "cell int, n bigint, total array<double>")
        by_place = partial.select("cell", "n", F.posexplode("total").alias("place", "x")).groupBy("cell", "place").agg(
            F.sum("n").alias("n"), F.sum("x").alias("x")).groupBy("cell").agg(
            F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "x"))).alias("total"))
        count, mean = np.zeros(n_lists, dtype=np.int64), np.zeros((n_lists, dim))
        for r in by_place.collect():
            count[r.cell], mean[r.cell] = r.n, np.asarray([t.x for t in r.total]) / r.n
        spread = np.maximum(1.0 - (mean ** 2).sum(axis=1), 1e-9) / max(dim, 1)
        return _Lists(count, mean, spread)

    def expected(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Rows of each list expected to be at least ``least`` similar to each query, similarities taken as normal in a list."""
        z = (least[:, None] - q @ self.mean.T) / np.sqrt(2.0 * self.variance)
        return self.count * 0.5 * _erfc(z)


_erfc = np.vectorize(math.erfc, otypes=[float])


def nearest_in_lists(queries: DataFrame, base: DataFrame, k: int, centres: np.ndarray, target: float = 0.95,
                     same_space: bool = False, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Approximate ``k`` nearest rows through inverted lists, each query probing as many lists as it needs.

    First every query reads its nearest lists (the root of their number); the k-th similarity found bounds the true one from
    below. Each other list then has an expected number of better rows, from its size, mean and variance. A query stops when
    the lists it leaves out hold at most ``(1 - target) * k`` expected rows together; a query with fewer than ``k`` rows so
    far reads on through all. Rows read are ranked by their exact similarities. Returns the rows of ``nearest`` and, in one
    row, (leidas, posibles): base rows compared, and those an exhaustive search compares. A null vector is an error, as in ``nearest``.
    """
    schema = "id bigint, other bigint, sim double, grp bigint"
    q = cut_lineage(queries.select(F.col("id").cast("long").alias("id"), "v", F.col("level").cast("int").alias("level"),
                                   F.lit(same_space).alias("own")))
    b = base.select(F.col("id").cast("long").alias("id"), "v", F.col("level").cast("int").alias("level"),
                    F.col("grp").cast("long").alias("grp"))
    cells = cut_lineage(_in_cells(b, centres)).drop("angle")
    lists, first = _Lists.of(cells, *centres.shape), math.ceil(math.sqrt(len(centres)))
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in q.schema.fields)

    def probe(later: bool):
        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in (tile for batch in batches for tile in _tiles(batch)):
                m = _unit(pdf["v"])
                a = _angles(m, centres)
                need = a.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable") < first
                if later:
                    better = np.where(need, 0.0, lists.expected(m, pdf["least"].fillna(-math.inf).to_numpy(dtype=np.float64)))
                    order = better.argsort(axis=1, kind="stable")
                    left_out = np.take_along_axis(better, order, axis=1).cumsum(axis=1) <= (1.0 - target) * k
                    skipped = np.zeros_like(need)
                    np.put_along_axis(skipped, order, left_out, axis=1)
                    need = ~need & ~skipped
                yield from _repeated(pdf.drop(columns="least", errors="ignore"), need & (lists.count > 0), a.argmin(axis=1))

        return visit

    best, order = _best_in_block(k, None), [F.col("sim").desc(), F.col("other").asc()]
    near = cut_lineage(q.mapInPandas(probe(False), f"{names}, cell int, place int"))
    found = cut_lineage(top_per_group(_meet(near, cells, lists.count, block_rows, best, schema, k), ["id"], order, k, "puesto"))
    least = found.groupBy("id").agg(F.when(F.count("*") >= k, F.min("sim")).alias("least"))
    far = cut_lineage(q.join(least, "id", "left").select(*q.columns, "least").mapInPandas(probe(True), f"{names}, cell int, place int"))
    more = _meet(far, cells, lists.count, block_rows, best, schema, k)
    sizes = F.element_at(F.array(*[F.lit(int(n)) for n in lists.count]), F.col("cell") + 1)
    read = near.select("cell").unionByName(far.select("cell")).agg(F.coalesce(F.sum(sizes.cast("long")), F.lit(0)).alias("leidas"))
    possible = q.agg((F.count("*") * F.lit(int(lists.count.sum()))).alias("posibles"))
    return (top_per_group(found.drop("puesto").unionByName(more), ["id"], order, k, "puesto"),
            read.withColumn("posibles", possible.scalar()))


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact neighbours found, over all queries."""
    hit = exact.join(approximate.select("id", "other", F.lit(1).alias("hit")), ["id", "other"], "left")
    return hit.agg(F.count("*").alias("vecinos"), F.count("hit").alias("hallados")).select(
        "vecinos", "hallados", E.ratio(F.col("hallados"), F.col("vecinos"), 6).alias("recall"))


# ---- profiles ------------------------------------------------------------------------------------------

def _sum_runs(key: str):
    """Add the weighted vectors of consecutive rows with the same key; rows arrive sorted by the key."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, acc = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[key].to_numpy()
            m = np.stack(pdf["v"].to_numpy()).astype(np.float64) * pdf["w"].to_numpy()[:, None]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sums, names = np.add.reduceat(m, starts, axis=0), keys[starts]
            done_keys, done = [], []
            if open_key is not None:
                if names[0] == open_key:
                    sums[0] += acc
                else:
                    done_keys.append(open_key)
                    done.append(acc)
            done_keys += list(names[:-1])
            done += list(sums[:-1])
            open_key, acc = names[-1], sums[-1].copy()
            if done_keys:
                yield pd.DataFrame({key: done_keys, "v": done, "w": 1.0})
        if open_key is not None:
            yield pd.DataFrame({key: [open_key], "v": [acc], "w": [1.0]})

    return run


def _unit_sums(weighted: DataFrame, key: str, salts: int) -> DataFrame:
    """Sum of w * v per key as a unit vector (key, embedding); sums that cancel out are dropped."""
    schema = f"{key} bigint, v array<double>, w double"
    partial = (weighted.withColumn("salt", F.pmod(F.xxhash64("contenido_id"), F.lit(salts)))
               .repartition(key, "salt").sortWithinPartitions(key)
               .select(key, "v", "w").mapInPandas(_sum_runs(key), schema))
    total = partial.repartition(key).sortWithinPartitions(key).mapInPandas(_sum_runs(key), schema)
    return total.withColumn("__n", E.norm(F.col("v"))).filter(F.col("__n") > 1e-12).select(
        key, F.transform("v", lambda x: x / F.col("__n")).alias("embedding"))


def group_centroids(members: DataFrame, embeddings: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Centroid of the vectors of each group's contents, as a unit vector."""
    rows = members.select(F.col(key).cast("long").alias(key), "contenido_id").join(
        embeddings.select("contenido_id", F.col("embedding").cast("array<double>").alias("v")), "contenido_id")
    return _unit_sums(rows.withColumn("w", F.lit(1.0)), key, salts)


def user_profiles(events: DataFrame, embeddings: DataFrame, users: DataFrame, minimum: int = 4, salts: int = 16,
                  weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted centroid of what each consenting user consumed, as a unit vector.

    No profile below ``minimum`` distinct contents or when the weights cancel out. Events are reduced to one
    weight per (user, content) first; a busy user's vectors are added up in ``salts`` parts, then merged.
    """
    agreed = users.filter("consentimiento_personalizacion").select(F.col("id").alias("usuario_id"))
    pairs = events.join(agreed, "usuario_id", "left_semi").groupBy("usuario_id", "contenido_id").agg(
        F.sum(E.event_weight(F.col("tipo_evento"), weights)).alias("w"), F.count("*").alias("n"))
    enough = pairs.groupBy("usuario_id").agg(
        F.count("*").alias("contenidos"), F.sum("n").alias("cantidad_eventos")).filter(F.col("contenidos") >= minimum)
    weighted = pairs.filter("w <> 0").join(enough.select("usuario_id"), "usuario_id", "left_semi").join(
        embeddings.select("contenido_id", F.col("embedding").cast("array<double>").alias("v")), "contenido_id")
    unit = _unit_sums(weighted, "usuario_id", salts)
    return unit.join(enough, "usuario_id").select("usuario_id", "embedding", "cantidad_eventos")


def vector_sanity(embeddings: DataFrame) -> DataFrame:
    """Exactly one model and one dimension may be present: vectors of different spaces do not compare."""
    return embeddings.agg(
        F.count("*").alias("vectores"), F.countDistinct("modelo_embedding").alias("modelos"),
        F.countDistinct(F.size("embedding")).alias("dimensiones"), F.max(F.size("embedding")).alias("dimension"),
        F.count_if(F.abs(E.norm(F.col("embedding")) - 1.0) > 1e-4).alias("no_unitarios")).withColumn(
        "coherente", (F.col("modelos") == 1) & (F.col("dimensiones") == 1))


def as_queries(df: DataFrame, ident: str, vector: str, level: Column | int = 2) -> DataFrame:
    lv = F.lit(level) if isinstance(level, int) else level
    return df.select(F.col(ident).alias("id"), F.col(vector).alias("v"), lv.alias("level"))


def as_base(embeddings: DataFrame, allowed: DataFrame) -> DataFrame:
    """Vectors of allowed contents with access level and section: the pre-filter sits below the search."""
    return embeddings.join(allowed.select("contenido_id", "nivel_acceso", "seccion_id"), "contenido_id").select(
        F.col("contenido_id").alias("id"), F.col("embedding").alias("v"), F.col("nivel_acceso").alias("level"),
        F.col("seccion_id").alias("grp"))
