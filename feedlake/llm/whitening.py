"""Embedding whitening: leading components of a quantised covariance by FEAST contour integration.

Each vector entry c becomes the integer x = floor(64 c) + 1000000. The fit list holds each distinct x vector once; its
count n, sums S and covariance V (divisor n, centred before multiplying) come from partial sums of the tasks, d * d numbers
each, added up by Spark. The driver holds one d x d matrix, whatever the number of rows.

``components`` finds the eigenvectors of V:

* an inertia count (signs of the pivots of V - s I) tells how many eigenvalues lie above s. Bisection with it finds a
  cut below the ``TOP`` largest and slices what is above in intervals of at most ``SLICE`` eigenvalues;
* for each interval, Gauss quadrature along a circle through its ends adds up the solves (z I - V) X = Y with complex
  shifts z, which projects Y on the eigenvectors inside; Rayleigh-Ritz on the result gives pairs, and both steps repeat
  until the residuals vanish;
* an interval is finished only when it has as many pairs as its inertia counts say, so none is missed. A last
  Rayleigh-Ritz over all intervals makes the vectors orthonormal and numbers them by falling eigenvalue.

Rows whose vector is null or holds null, NaN or infinite entries are dropped. So are rows whose length is not the one that
most distinct vectors have (the longer of two that tie). Repeated rows count once in the fit list and are all returned.
Components without variance (eigenvalue below 1e-12 of the trace) do not exist: a table that is empty or holds one distinct
vector gives an empty result. Equal eigenvalues: any orthonormal basis of their space, the same for all rows. Entries
beyond 2**55 count as 2**55; a deviation that does not fit a long is null. Null ids stay; columns other than the id and the vector
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.session import cut_lineage

SCALE, OFFSET, TOP = 64.0, 1_000_000, 16
#: Eigenvalues an interval may hold, quadrature points on the half circle, rounds before the subspace grows.
SLICE, NODES, ROUNDS = 8, 8, 12
FLAT = 1e-12
LIMIT = 2.0**61


def quantised(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer matrix without the offset) of the usable rows of a list column, one pair for each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(pc.is_valid(column))
    rows = np.flatnonzero(valid)
    lengths = np.asarray(pc.list_value_length(column).drop_null(), np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(flat * SCALE)
        whole = np.where(np.isfinite(flat), np.clip(whole, -LIMIT, LIMIT), np.nan)
    ends = np.cumsum(lengths)
    bad = np.r_[0, np.cumsum(np.isnan(whole))]
    usable = bad[ends] == bad[ends - lengths]
    out = []
    for d in np.unique(lengths[usable & (lengths > 0)]):
        chosen = np.flatnonzero(usable & (lengths == d))
        where = (ends[chosen] - d)[:, None] + np.arange(d)
        out.append((rows[chosen], whole[where].astype(np.int64)))
    return out


def encode(x: np.ndarray) -> list[bytes]:
    """Each row as bytes: the width of its numbers, then the numbers. Equal rows have equal bytes."""
    most = np.maximum(x.max(axis=1, initial=0), -1 - x.min(axis=1, initial=0))
    width = np.where(most < 2**7, 1, np.where(most < 2**15, 2, np.where(most < 2**31, 4, 8)))
    out = [b""] * len(x)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        raw, step = np.ascontiguousarray(x[at], f"<i{w}").tobytes(), int(w) * x.shape[1]
        head = bytes([int(w)])
        for k, row in enumerate(at):
            out[row] = head + raw[k * step:(k + 1) * step]
    return out


def decode(codes: list[bytes], d: int) -> np.ndarray:
    """The rows of ``encode`` that have ``d`` numbers."""
    parts = []
    for w in (1, 2, 4, 8):
        own = [c[1:] for c in codes if c[0] == w and len(c) == 1 + w * d]
        if own:
            parts.append(np.frombuffer(b"".join(own), f"<i{w}").reshape(-1, d).astype(np.int64))
    return np.concatenate(parts) if parts else np.empty((0, d), np.int64)


def _codes(batches):
    for batch in batches:
        for _, x in quantised(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(encode(x), pa.binary())], ["code"])


def _totals(batches):
    """Count and sums by length of vector; sums as decimal digits, as they may pass 64 bits."""
    n: dict[int, int] = {}
    totals: dict[int, list[int]] = {}
    for batch in batches:
        codes = batch.column(0).to_pylist()
        for d in {(len(c) - 1) // c[0] for c in codes}:
            x = decode(codes, d)
            safe = not x.size or int(np.abs(x).max()) < 2**62 // len(x)
            sums = x.sum(axis=0) if safe else x.astype(object).sum(axis=0)
            n[d] = n.get(d, 0) + len(x)
            totals[d] = [a + int(b) for a, b in zip(totals.get(d, [0] * d), sums)]
    for d, count in n.items():
        yield pa.RecordBatch.from_pydict({"d": [d] * (d + 1), "dimension": list(range(-1, d)),
                                          "total": [str(count), *map(str, totals[d])]},
                                         pa.schema([("d", pa.int32()), ("dimension", pa.int32()), ("total", pa.string())]))


@dataclass(frozen=True)
class Fit:
    """Count and sums (without the offset) of the fit list."""

    d: int
    n: int
    sums: tuple[int, ...]

    @property
    def pivot(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        return [s - self.n * int(p) for s, p in zip(self.sums, self.pivot)]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: exact up to the last subtraction, as the nearest integers to the means go first."""
        return (x - self.pivot).astype(np.float64) - np.array([r / self.n for r in self.rest])


def fit(codes: DataFrame) -> Fit | None:
    """Count and sums of the vectors of the most frequent length."""
    found = (codes.mapInArrow(_totals, "d int, dimension int, total string")
             .groupBy("d", "dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    lengths = found.where("dimension = -1").orderBy(F.desc("total"), F.desc("d")).first()
    if lengths is None:
        return None
    rows = found.where((F.col("d") == lengths["d"]) & (F.col("dimension") >= 0)).collect()
    return Fit(lengths["d"], int(lengths["total"]), tuple(int(r["total"]) for r in sorted(rows, key=lambda r: r["dimension"])))


def moments(codes: DataFrame, known: Fit, project: np.ndarray | None = None) -> np.ndarray:
    """Covariance over the fit list, of the vectors or of their projections on the columns of ``project``."""
    size = known.d if project is None else project.shape[1]
    upper = np.triu_indices(size)

    def partial(batches):
        square, first = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            y = known.centred(decode(batch.column(0).to_pylist(), known.d))
            y = y if project is None else y @ project
            square += y.T @ y
            first += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]) + size), pa.int32()), pa.array(np.r_[square[upper], first])],
                                         ["cell", "value"])

    rows = codes.mapInArrow(partial, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    values = np.zeros(len(upper[0]) + size)
    for cell, value in rows:
        values[cell] = value
    values /= known.n
    mean = values[len(upper[0]):]
    out = np.zeros((size, size))
    out[upper] = values[:len(upper[0])]
    return np.triu(out) + np.triu(out, 1).T - np.outer(mean, mean)


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``: positive pivots of an elimination with 1 x 1 and 2 x 2
    pivots, chosen so that no entry grows much."""
    m = a - shift * np.eye(len(a))
    count = 0
    while len(m):
        size = np.abs(m)
        diagonal = size.diagonal()
        p = int(diagonal.argmax())
        largest = int(size.argmax())
        i, j = divmod(largest, len(m))
        if size[i, j] == 0:
            return count
        if diagonal[p] >= 0.6403882 * size[i, j]:
            count += m[p, p] > 0
            keep = np.delete(np.arange(len(m)), p)
            m = m[np.ix_(keep, keep)] - np.outer(m[keep, p], m[p, keep]) / m[p, p]
        else:  # a pivot block with a negative determinant: one eigenvalue of each sign
            count += 1
            keep = np.delete(np.arange(len(m)), [i, j])
            sides = m[np.ix_(keep, [i, j])]
            m = m[np.ix_(keep, keep)] - sides @ np.linalg.solve(m[np.ix_([i, j], [i, j])], sides.T)
    return int(count)


def _ritz(a: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, _ = np.linalg.qr(q)
    small = q.T @ a @ q
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return values, q @ vectors


def inside(a: np.ndarray, low: float, high: float, count: int) -> np.ndarray:
    """The eigenvectors with eigenvalues in (low, high], of which there are ``count``, by contour integration."""
    d = len(a)
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(-0.5j * np.pi * (points - 1))
    middle, radius, size_of_a = (low + high) / 2, (high - low) / 2, np.abs(a).sum(axis=1).max()
    size = min(d, count + count // 2 + 4)
    while True:
        y, last = np.random.default_rng(7).standard_normal((d, size)), np.inf
        for _ in range(ROUNDS):
            q = np.zeros((d, size))
            for turn, weight in zip(turns, weights):
                q += weight / 2 * (radius * turn * np.linalg.solve((middle + radius * turn) * np.eye(d) - a, y)).real
            values, vectors = _ritz(a, q)
            error = np.linalg.norm(a @ vectors - vectors * values, axis=0)
            found = (values > low) & (values <= high) & (error <= 1e-12 * size_of_a)
            if found.sum() == count:
                if error[found].max() > last / 2:  # no better any more
                    return vectors[:, found]
                last = error[found].max()
            y = vectors
        if found.sum() == count:
            return vectors[:, found]
        if size == d:
            raise ArithmeticError(f"{int(found.sum())} of {count} eigenvalues found between {low} and {high}")
        size = min(d, 2 * size)


def _between(a: np.ndarray, low: float, high: float, n_low: int, n_high: int, most: int) -> tuple[float, int] | None:
    """A point with between n_high + 1 and ``most`` eigenvalues above it (fewer than n_low), away from all of them."""
    for _ in range(60):
        middle = (low + high) / 2
        n = above(a, middle)
        if n_high < n <= most and n < n_low and above(a, middle + 1e-4 * (high - low)) == n == above(a, middle - 1e-4 * (high - low)):
            return middle, n
        if n > most or n == n_low:
            low = middle
        else:
            high = middle
        if high - low <= 1e-13 * abs(high):
            return None
    return None


def components(v: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the ``top`` largest eigenvalues of a covariance, falling."""
    trace = float(np.trace(v))
    if not trace > 0:
        return np.empty(0), np.empty((len(v), 0))
    a = v / trace
    low, high = FLAT, 1 + 1e-9
    total = above(a, low)
    want = min(top, total)
    if want == 0:
        return np.empty(0), np.empty((len(v), 0))
    cut, n = low, total
    if total > want:  # the highest cut that has all wanted above it
        under, over = low, high
        for _ in range(50):
            middle = (under + over) / 2
            count = above(a, middle)
            if count >= want:
                under, cut, n = middle, middle, count
            else:
                over = middle
            if count == want or over - under <= 1e-13 * over:
                break
        # Away from the eigenvalue above: the lowest point that has no more above it, coarsely.
        under, over = low, cut
        for _ in range(8):
            middle = (under + over) / 2
            under, over = (under, middle) if above(a, middle) == n else (middle, over)
        cut = (cut + over) / 2
    slices, todo = [], [(cut, high, n, 0)]
    while todo:
        low, high, n_low, n_high = todo.pop()
        split = None
        if n_low - n_high > SLICE:
            split = _between(a, low, high, n_low, n_high, n_high + SLICE)
        if split:
            todo += [(low, split[0], n_low, split[1]), (split[0], high, split[1], n_high)]
        else:
            slices.append((low, high, n_low - n_high))
    vectors = np.concatenate([inside(a, low, high, count) for low, high, count in slices if count], axis=1)
    values, vectors = _ritz(a, vectors)
    order = np.argsort(-values, kind="stable")[:want]
    return values[order] * trace, vectors[:, order]


def whiten(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", top: int = TOP) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and identity_error: one row for each usable vector and
    component. ``identity_error`` is the largest entry of the covariance of the whitened fit list minus the identity."""
    rows = table.select(F.col(id_column), F.col(vector).alias("_vector"))
    id_type = rows.schema[0].dataType.simpleString()
    ddl = f"`{id_column}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = table.sparkSession
    codes = cut_lineage(rows.select("_vector").mapInArrow(_codes, "code binary").distinct())
    known = fit(codes)
    if known is None:
        return spark.createDataFrame([], ddl)
    v = moments(codes, known)
    values, vectors = components(v, top)
    if not len(values):
        return spark.createDataFrame([], ddl)
    project = vectors / np.sqrt(values)
    explained = values / float(np.trace(v))
    error = float(np.abs(moments(codes, known, project) - np.eye(len(values))).max())
    n, k, rest = known.n, len(values), known.rest

    def deviations(x: np.ndarray) -> list[int | None]:
        from_pivot = x - known.pivot
        largest = n * (int(np.abs(from_pivot).max(initial=0)) + 1)
        if largest * largest * known.d < 2**62:
            return ((n * from_pivot - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((n * int(e) - r) ** 2 for e, r in zip(row, rest)) for row in from_pivot]
        return [e if e < 2**63 else None for e in exact]

    def project_rows(batches):
        for batch in batches:
            for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
                for at, x in quantised(part.column(1)):
                    if x.shape[1] != known.d:
                        continue
                    repeat = pa.array(np.repeat(np.arange(len(at)), k))
                    many = len(at) * k
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(many, n, np.int64)),
                        pa.array(deviations(x), pa.int64()).take(repeat),
                        pa.array((known.centred(x) @ project).ravel()),
                        pa.array(np.tile(explained, len(at))),
                        pa.array(np.full(many, error)),
                    ], [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project_rows, ddl)
