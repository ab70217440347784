"""Whitening of vectors by spectral divide and conquer with QDWH polar decompositions.

Entries become whole numbers ``floor(SCALE * c)``; every distinct vector counts
once in the fit. Spark adds up means, then centred products, one partial sum for
each task, combined in a tree; only a d x d matrix comes to the driver, which
splits it: the polar factor of the covariance minus a shift, from dynamically
weighted Halley steps, gives the projector on the eigenvectors above the shift,
whose basis and complement cut the matrix into two smaller ones, until each has
one dimension. Only the halves that hold leading components are followed. The
components are broadcast and every vector is projected on them where it lies.

Vectors that are null, or hold null or non-finite entries, take no part. So do
vectors without entries and those of another length than most (of the longest
such length). Components that the fit list does not spread along (an eigenvalue
of no more than 1e-12 of the largest) are left out, so one distinct vector, or
none, gives no rows. Components of equal eigenvalues are any basis of their
space. Rows that repeat a key or a vector each give their own rows; a null key
stays null. ``deviation`` is null where it is beyond 64 bits. Other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersmith.llm.frames import written

SCALE = 256
#: A d x d matrix is held by the driver and by every task.
MOST_DIMENSIONS = 4096
FAN_IN = 64
EPS = np.finfo(float).eps
_LIMIT = 1 << 62


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix, by QR- and Cholesky-based weighted Halley steps."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    low = EPS / 2  # no singular value that counts is smaller
    for _ in range(40):
        before = x
        sq = low * low
        d = np.cbrt(4 * (1 - sq) / (sq * sq))
        root = np.sqrt(1 + d)
        f = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - sq) / (sq * root))
        g = (f - 1) ** 2 / 4
        h = f + g - 1
        if h > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(h) * x, np.eye(n)]))[0]
            x = g / h * x + (f - g / h) / np.sqrt(h) * (q[:n] @ q[n:].T)
        else:
            chol = np.linalg.cholesky(np.eye(n) + h * (x.T @ x))
            x = g / h * x + (f - g / h) * np.linalg.solve(chol.T, np.linalg.solve(chol, x.T)).T
        x = (x + x.T) / 2
        low = min(1.0, low * (f + g * sq) / (1 + h * sq))
        if low > 1 - 10 * EPS and np.linalg.norm(x - before) < 1e-12 * np.sqrt(n):
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the eigenvectors above a shift; None if all values are alike."""
    n = len(a)
    size = np.linalg.norm(a)
    middle = np.trace(a) / n
    if np.linalg.norm(a - middle * np.eye(n)) <= 4 * n * EPS * size:
        return None
    diagonal = np.sort(np.diag(a))
    shifts = [np.median(diagonal), middle, *((diagonal[1:] + diagonal[:-1]) / 2)]
    spread = np.linalg.norm(a - middle * np.eye(n)) / np.sqrt(n)
    shifts += [middle + f * spread for f in (0.3, -0.3, 0.6, -0.6, 0.9, -0.9, 0.05, -0.05)]
    draw = np.random.default_rng(n)
    best = None
    for shift in shifts:
        half = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(np.trace(half)))
        if not 0 < k < n:
            continue
        q = np.linalg.qr(half @ draw.standard_normal((n, k)), mode="complete")[0]
        for _ in range(2):
            q = np.linalg.qr(np.hstack([half @ q[:, :k], q[:, k:] - half @ q[:, k:]]))[0]
        off = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or off < best[0]:
            best = off, q, k
        if off <= 20 * n * EPS * size:
            break
    if best is None:
        raise ArithmeticError("no shift splits the spectrum")
    return best[1], best[2]


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    n = len(a)
    if n == 1 or (cut := _split(a)) is None:
        return np.diag(a)[:count].copy(), np.eye(n)[:, :count]
    q, k = cut
    values, vectors = leading(_even(q[:, :k].T @ a @ q[:, :k]), min(count, k))
    vectors = q[:, :k] @ vectors
    if count > k:
        more, rest = leading(_even(q[:, k:].T @ a @ q[:, k:]), count - k)
        values, vectors = np.concatenate([values, more]), np.hstack([vectors, q[:, k:] @ rest])
    vectors = np.linalg.qr(vectors)[0]
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _even(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


@dataclass
class Whitening:
    n: int                  # distinct vectors
    sums: list[int]         # of each dimension
    values: np.ndarray      # eigenvalues, falling
    vectors: np.ndarray     # d x components
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(0)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(float) - self.mean) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n*x - sum)^2, exact, or null beyond 64 bits."""
        far = np.abs(x.astype(float) * self.n - np.array(self.sums, float)).max(initial=0)
        if far < np.sqrt(_LIMIT / max(1, len(self.sums))):
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def quantised(rows: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, d, x): the whole numbers of every usable vector, packed as two, four or eight bytes each, whatever fits all of them."""
    key_type = rows.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat = lists.flatten()
            bad = np.asarray(flat.is_null()) | ~np.isfinite(c := np.asarray(flat.fill_null(0), float))
            sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            ends = np.cumsum(sizes)
            wrong = np.concatenate([[0], np.cumsum(bad)])
            good = (sizes > 0) & (wrong[ends] == wrong[ends - sizes])
            x = np.floor(np.clip(scale * np.where(bad, 0, c), -(2.0**63), 2.0**63 - 1025)).astype(np.int64)
            packed = []
            for at in np.flatnonzero(good).tolist():
                own = x[ends[at] - sizes[at]:ends[at]]
                top = max(int(own.max()), -int(own.min()) - 1)
                packed.append(own.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8").tobytes())
            yield pa.record_batch([batch.column("id").filter(pa.array(good)), pa.array(sizes[good].astype(np.int32)),
                                   pa.array(packed, pa.binary())], names=["id", "d", "x"])

    taken = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return taken.mapInArrow(run, f"id {key_type.simpleString()}, d int, x binary")


def _unpacked(batch: pa.RecordBatch, d: int) -> np.ndarray:
    raw = batch.column("x").to_pylist()
    if all(len(r) == 2 * d for r in raw):
        return np.frombuffer(b"".join(raw), "<i2").reshape(-1, d).astype(np.int64)
    return np.stack([np.frombuffer(r, f"<i{len(r) // d}").astype(np.int64) for r in raw])


def _summed(fit: DataFrame, d: int, width: int, work, kind: type) -> np.ndarray:
    """Sum over all vectors of ``work(x)``, arrays of ``width`` numbers, one partial sum for each task, FAN_IN at a time.

    The partial sums are written first, so that what is lost is not added up in another order.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, kind)
        for batch in batches:
            if len(batch):
                total += work(_unpacked(batch, d))
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def add(key, group: pa.Table) -> pa.Table:
        parts = group.column("total").to_pylist()
        return pa.table({"total": pa.array([np.sum([np.frombuffer(p, kind) for p in parts], 0).tobytes()], pa.binary())})

    parts = written(fit.select("x").mapInArrow(partial, "total binary"), "partial")
    left = parts.count()
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        place = F.pmod(F.xxhash64("total"), F.lit(left)).alias("place")
        parts = written(parts.select(place, "total").groupBy("place").applyInArrow(add, "total binary"), "partial")
    return np.sum([np.zeros(width, kind), *(np.frombuffer(bytes(r["total"]), kind) for r in parts.collect())], 0)


def fit(packed: DataFrame, components: int = 4) -> Whitening:
    """Components of the distinct vectors of ``packed(d, x)``, all of one length."""
    distinct = written(packed.select("d", "x").distinct(), "distinct")
    n, d = distinct.agg(F.count("*"), F.max("d")).first()
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions are too many for a d x d matrix on the driver")

    def halves(x: np.ndarray) -> np.ndarray:  # two sums, so that neither overflows
        return np.concatenate([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])

    high_low = _summed(distinct, d, 2 * d, halves, np.int64).tolist()
    sums = [(h << 32) + low for h, low in zip(high_low[:d], high_low[d:])]
    mean = np.array([s / n for s in sums])

    def products(x: np.ndarray) -> np.ndarray:
        c = x.astype(float) - mean
        return (c.T @ c).ravel()

    covariance = _even(_summed(distinct, d, d * d, products, float).reshape(d, d) / n)
    values, vectors = leading(covariance, min(components, d))
    here = values > 1e-12 * max(values[0], 0)
    model = Whitening(int(n), sums, values[here], vectors[:, here], float(np.trace(covariance)))
    k = len(model.values)
    if k:
        def moments(x: np.ndarray) -> np.ndarray:
            w = model.project(x)
            return np.concatenate([w.sum(0), (w.T @ w).ravel()])

        found = _summed(distinct, d, k + k * k, moments, float) / n
        # the projected mean is zero but for rounding, whose square is what centring takes away
        error = found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)
        model.identity_error = float(np.abs(error).max())
    return model


def apply(packed: DataFrame, model: Whitening, key: str) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    key_type = packed.schema["id"].dataType.simpleString()
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    shared = packed.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        for batch in batches:
            if not k or not len(batch):
                continue
            x = _unpacked(batch, len(m.sums))
            rows = np.repeat(np.arange(len(batch)), k)
            own = pa.array(rows)
            deviation = pa.array(m.deviation(x), pa.int64())
            yield pa.record_batch([
                batch.column("id").take(own), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))),
                pa.array(np.full(len(rows), m.n, np.int64)), deviation.take(own), pa.array(m.project(x).ravel()),
                pa.array(np.tile(m.values / m.trace, len(batch))), pa.array(np.full(len(rows), m.identity_error))], names=names)

    return packed.select("id", "x").mapInArrow(
        run, f"`{key}` {key_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = SCALE) -> DataFrame:
    """Fit on all rows and apply to all rows."""
    packed = written(quantised(rows, key, vector, scale), "packed")
    lengths = packed.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    same = packed.where(F.col("d") == (lengths[0]["d"] if lengths else 0))
    return apply(same, fit(same, components), key)
