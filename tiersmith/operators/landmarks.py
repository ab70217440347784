"""Multi-task regression on landmarks, for training tables without a bound.

A landmark is a point under a task number (0 = primary). Between landmarks and
rows the covariance is that of ``gp``: ``rho_a*rho_b*v_0*k_0`` plus ``v_i*k_i``
where both are of the same secondary task i. The rows stay wide, one column of
values for each task, null where a task was not measured; so a row's distances
to the landmarks are formed once for all its tasks.

One pass gives everything: for each task the products of the covariances with
themselves, with the values and with one (the prior mean of a task is known only
when its sum is), the values' sum and number. Tasks give one partial sum each,
which are combined in a tree; an m x m system is solved on the driver. With all
training rows as landmarks the result is the exact regression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tiersmith.operators.gp import BROADCAST_BYTES, FAN_IN, NOISE, covariance
from tiersmith.session import cut_lineage, spread, task_slots

#: Added to the diagonal of the landmarks' covariance, times the primary's variance.
JITTER = 1e-10
BATCH = 4096


@dataclass(frozen=True)
class Landmarks:
    """Points ``x`` (m x d) under task numbers ``task`` with (variance, lengthscale, rho) arrays by task."""
    x: np.ndarray
    task: np.ndarray
    theta: tuple[np.ndarray, np.ndarray, np.ndarray]

    def __post_init__(self) -> None:
        m = len(self.x)
        if 8 * m * m > BROADCAST_BYTES // 8:
            raise ValueError(f"{m} landmarks are too many for a driver-side solve")
        if len(self.task) != m or (m and not 0 <= self.task.min() <= self.task.max() < len(self.theta[0])):
            raise ValueError("each landmark needs the number of a task with parameters")

    def to_rows(self, x: np.ndarray, task: int) -> np.ndarray:
        return covariance(self.x, self.task, x, np.full(len(x), task), self.theta)


@dataclass(frozen=True)
class LandmarkFit:
    landmarks: Landmarks
    means: np.ndarray       # prior mean of each task; NaN without rows
    inv: np.ndarray         # inverse of the landmarks' Cholesky factor
    inner_inv: np.ndarray   # and of the factor of noise + projected products
    white: np.ndarray
    noise: float

    def predict(self, x: np.ndarray, task: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Posterior mean and deviation of a task without its noise."""
        v, _, rho = self.landmarks.theta
        q = self.inv @ self.landmarks.to_rows(x, task)
        r = self.inner_inv @ q
        own = rho[task] ** 2 * v[0] + (v[task] if task else 0.0)
        var = own - (q * q).sum(0) + self.noise * (r * r).sum(0)
        return self.means[task] + self.white @ q, np.sqrt(np.maximum(var, 0.0))


def vectors(column: pa.Array) -> np.ndarray:
    """A list column without nulls and of one length as a matrix."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    if len(sizes) and (sizes.min() != sizes.max() or sizes[0] < 1):
        raise ValueError("vectors are null, empty or of several lengths")
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _tree_sum(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """Sum of one array from each task, FAN_IN of them at a time; no task gets them all.

    Splits are put together up to the number of task slots first, so that there
    are as many partial sums as tasks run at once and not as many as the table has files.
    """
    slots = task_slots(rows.sparkSession)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([pa.array([partial(batches).tobytes()], pa.binary())], names=["total"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in group.column("total").to_pylist())
        return pa.table({"total": pa.array([total.tobytes()], pa.binary())})

    parts = cut_lineage(rows.coalesce(slots).mapInArrow(job, "total binary"))
    n = parts.count()
    while n > FAN_IN:
        n = ceil(n / FAN_IN)
        parts = cut_lineage(parts.withColumn("place", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(n)))
                                 .groupBy("place").applyInArrow(add, "total binary"))
        n = parts.count()
    return sum(np.frombuffer(bytes(r["total"])) for r in parts.collect())


def fit(train: DataFrame, tasks: list[str], landmarks: Landmarks, noise: float = NOISE) -> LandmarkFit:
    """Regression from one pass over ``train(x, <tasks>)``; a row counts for the tasks in which it has a value."""
    m, t = len(landmarks.x), len(tasks)
    if t != len(landmarks.theta[0]):
        raise ValueError("one set of parameters for each task column is needed")
    shared = train.sparkSession.sparkContext.broadcast(landmarks)

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        lm = shared.value
        kk, ky, k1, n, sy = np.zeros((m, m)), np.zeros(m), np.zeros((t, m)), np.zeros(t), np.zeros(t)
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                batch = whole.slice(at, BATCH)
                x = vectors(batch.column("x"))
                for i in range(t):
                    y = np.asarray(batch.column(f"y{i}").cast(pa.float64()).fill_null(np.nan))
                    here = ~np.isnan(y)
                    k = lm.to_rows(x[here], i)
                    kk += k @ k.T
                    ky += k @ y[here]
                    k1[i] += k.sum(1)
                    n[i] += here.sum()
                    sy[i] += y[here].sum()
        return np.concatenate([kk.ravel(), ky, k1.ravel(), n, sy])

    rows = spread(train.select("x", *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(tasks)]))
    total = _tree_sum(rows, partial)
    kk, ky, k1, n, sy = np.split(total, np.cumsum([m * m, m, t * m, t]))
    if not n[0]:
        raise ValueError("no row has a value of the primary task")
    means = np.divide(sy, n, out=np.full(t, np.nan), where=n > 0)
    v, _, _ = landmarks.theta
    kzz = covariance(landmarks.x, landmarks.task, landmarks.x, landmarks.task, landmarks.theta)
    inv = np.linalg.inv(np.linalg.cholesky(kzz + JITTER * v[0] * np.eye(m)))
    inner = noise * np.eye(m) + inv @ kk.reshape(m, m) @ inv.T
    inner_inv = np.linalg.inv(np.linalg.cholesky((inner + inner.T) / 2))
    rest = ky - np.nan_to_num(means) @ k1.reshape(t, m)
    return LandmarkFit(landmarks, means, inv, inner_inv, inner_inv.T @ (inner_inv @ (inv @ rest)), noise)


def score(test: DataFrame, fitted: LandmarkFit, task: int = 0) -> DataFrame:
    """Mean and deviation of every row, without a shuffle; adds mu, sigma and drops x."""
    shared = test.sparkSession.sparkContext.broadcast(fitted)
    keep = [f for f in test.schema if f.name != "x"]
    names = [f.name for f in keep]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                batch = whole.slice(at, BATCH)
                mu, sigma = shared.value.predict(vectors(batch.column("x")), task)
                yield pa.record_batch([*(batch.column(c) for c in names), pa.array(mu), pa.array(sigma)], names=[*names, "mu", "sigma"])

    schema = StructType([*keep, StructField("mu", DoubleType()), StructField("sigma", DoubleType())])
    return spread(test.select(*names, "x")).mapInArrow(job, schema)


def sampled_landmarks(ranked: DataFrame, params: dict[str, tuple[float, float, float]], counts: dict[str, int]) -> Landmarks:
    """Landmarks from the first rows of a ranked sample: each task takes the next ``counts`` ranks."""
    rows = ranked.where(F.col("rank") <= sum(counts.values())).orderBy("rank").select("x").collect()
    task = np.repeat(np.arange(len(counts)), list(counts.values()))
    theta = tuple(np.array([params[t][k] for t in counts]) for k in range(3))
    return Landmarks(np.array([list(r["x"]) for r in rows], float), task[:len(rows)], theta)
