"""Gaussian-process regression as grouped Spark jobs.

Covariance between rows a and b with task numbers (0 = primary):
``rho_a*rho_b*v_0*k_0(x_a,x_b)`` plus ``v_i*k_i(x_a,x_b)`` when both rows belong
to the same secondary task i. ``k`` is the squared exponential. Training rows
carry their task's ``rho, variance, lengthscale`` from a keyed join, so a group
needs nothing but its own rows.

A cell's training set is bounded by the grid and fitted in one task, in place
and by blocks: a cell of n rows needs 8*n*n bytes and no further matrix of that
size. The rows to score are not bounded, so they are either cut in chunks that
read the cell's stored fit, or mapped with a broadcast of fits whose total size is
checked. ``inducing_*`` is the form for training sets without a bound.

``kernel(squared distances, lengthscale)`` and ``mean(values)``, the prior mean
of a task, are functions that are shipped with the job; a kernel is 1 at
distance 0.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tiersmith.session import cut_lineage, spread, task_slots

NOISE = 0.015
BLOCK = 512
CHUNK_ROWS = 8192
#: Bytes of a stored fit in one row.
PIECE_BYTES = 16 << 20
BROADCAST_BYTES = 256 << 20
FAN_IN = 32
PARTIAL = "part int, total binary"


def sq_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def squared_exponential(d: np.ndarray, lengthscale: float) -> np.ndarray:
    return np.exp(-d / (2 * lengthscale**2))


Kernel = Callable[[np.ndarray, float], np.ndarray]
Mean = Callable[[np.ndarray], float]


def covariance(xa, ta, xb, tb, theta, kernel: Kernel = squared_exponential) -> np.ndarray:
    """Covariance block of tagged rows; ``theta`` is (variance, lengthscale, rho) per task number."""
    v, l, rho = theta
    d = sq_distances(xa, xb)
    k = rho[ta][:, None] * rho[tb][None, :] * v[0] * kernel(d, l[0])
    for i in range(1, len(v)):
        ra, rb = np.flatnonzero(ta == i), np.flatnonzero(tb == i)
        if len(ra) and len(rb):
            k[np.ix_(ra, rb)] += v[i] * kernel(d[np.ix_(ra, rb)], l[i])
    return k


def factor(x: np.ndarray, task: np.ndarray, theta: tuple, noise: float, kernel: Kernel = squared_exponential) -> np.ndarray:
    """Lower Cholesky factor of the covariance plus noise; one n x n array, filled and factored by blocks."""
    n = len(x)
    low = np.empty((n, n))
    for at in range(0, n, BLOCK):
        rows = slice(at, min(n, at + BLOCK))
        low[rows, :rows.stop] = covariance(x[rows], task[rows], x[:rows.stop], task[:rows.stop], theta, kernel)
    low[np.diag_indices(n)] += noise
    for at in range(0, n, BLOCK):
        mine, end = slice(at, min(n, at + BLOCK)), min(n, at + BLOCK)
        low[mine, mine] = np.linalg.cholesky(low[mine, mine])
        low[mine, end:] = 0
        for lo in range(end, n, BLOCK):  # what is below, then its share in the later blocks
            rows = slice(lo, min(n, lo + BLOCK))
            low[rows, mine] = np.linalg.solve(low[mine, mine], low[rows, mine].T).T
        for lo in range(end, n, BLOCK):
            rows = slice(lo, min(n, lo + BLOCK))
            low[rows, end:rows.stop] -= low[rows, mine] @ low[end:rows.stop, mine].T
    return low


def forward(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of ``low @ q = b`` by forward substitution in blocks."""
    q = np.array(b, float)
    for at in range(0, len(low), BLOCK):
        rows = slice(at, at + BLOCK)
        if at:
            q[rows] -= low[rows, :at] @ q[:at]
        q[rows] = np.linalg.solve(low[rows, rows], q[rows])
    return q


def fit_rows(pdf: pd.DataFrame, noise: float, kernel: Kernel = squared_exponential, mean: Mean = np.mean) -> dict:
    """Cholesky fit of one cell from columns task_no, x, y, variance, lengthscale, rho."""
    x = np.stack(pdf["x"].to_numpy())
    task = pdf["task_no"].to_numpy(int)
    y = pdf["y"].to_numpy(float)
    last = task.max()
    v, l, rho = (np.ones(last + 1) for _ in range(3))
    means = np.zeros(last + 1)
    for i in np.unique(task):
        rows = task == i
        v[i], l[i], rho[i] = pdf.loc[rows, ["variance", "lengthscale", "rho"]].iloc[0]
        means[i] = mean(y[rows])
    theta = (v, l, rho)
    chol = factor(x, task, theta, noise, kernel)
    return dict(x=x, task=task, theta=theta, means=means, chol=chol, white=forward(chol, y - means[task]), noise=noise, kernel=kernel)


def predict_rows(fit: dict, x: np.ndarray, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and deviation of the primary task at ``x``.

    With ``low`` the value of the last secondary task at the same point joins
    the training set of that point alone: a rank-one border of the fit.
    """
    v, l, rho = fit["theta"]
    zero = np.zeros(len(x), int)
    q = forward(fit["chol"], covariance(fit["x"], fit["task"], x, zero, fit["theta"], fit["kernel"]))
    mu = fit["means"][0] + fit["white"] @ q
    var = v[0] - (q * q).sum(0)
    if low is not None:
        last = len(v) - 1
        b = forward(fit["chol"], covariance(fit["x"], fit["task"], x, zero + last, fit["theta"], fit["kernel"]))
        cross = rho[last] * v[0] - (q * b).sum(0)
        own = rho[last] ** 2 * v[0] + v[last] + fit["noise"] - (b * b).sum(0)
        mu = mu + cross / own * (low - fit["means"][last] - fit["white"] @ b)
        var = var - cross * cross / own
    return mu, np.sqrt(np.maximum(var, 0.0))


TRAIN = ["cell_id", "task_no", "x", "y", "rho", "variance", "lengthscale"]


def fit_and_predict(train: DataFrame, test: DataFrame, key: str, *, test_rows: int, noise: float = NOISE,
                    low: str | None = None, carry: tuple[str, ...] = (), solver: Callable[[str], tuple] | None = None) -> DataFrame:
    """Posterior of every test row of every cell.

    ``solver(cell_id)`` gives the functions ``fit(training rows, noise)`` and
    ``score(fit, x, low) -> (mu, sigma)`` of a cell; without it, ``fit_rows`` and ``predict_rows``.

    Returns (cell_id, key, mu, sigma, n_primary, n_secondary_rows, train_time,
    test_time) and the double columns ``carry`` of the test rows. Where ``low``
    is not null, that value of the last task joins the row's training set.
    ``test_rows`` is the number of test rows per cell; above ``CHUNK_ROWS`` a
    cell is scored by several groups. Times are shares that sum to the cell's seconds.
    """
    chunks = max(1, ceil(test_rows / CHUNK_ROWS))
    chunk = F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int").alias("chunk")
    none = F.lit(None).cast("double")
    test = test.select("cell_id", F.col(key).cast("string").alias("key"), "x", (F.col(low) if low else none).cast("double").alias("low"),
                       *[F.col(c).cast("double").alias(c) for c in carry], chunk).withMetadata("key", {"type": test.schema[key].dataType.simpleString()})
    run = _scored_by_stored_fits if chunks > 1 else _fitted_and_scored
    done = run(train.select(*TRAIN), test, chunks, noise, solver or (lambda cell: (fit_rows, predict_rows)), carry)
    kind = test.schema["key"].metadata["type"]
    return done.withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", key)


def _out(carry: tuple[str, ...]) -> dict[str, str]:
    return {"cell_id": "string", "key": "string", "mu": "double", "sigma": "double", "n_primary": "bigint",
            "n_secondary_rows": "bigint", "train_time": "double", "test_time": "double", **{c: "double" for c in carry}}


def _kinds(columns: dict[str, str]) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in columns.items())


def _scores(at: pd.DataFrame, fit, score, carry: tuple[str, ...], n_primary: int, n_rest: int, train_time: float) -> pd.DataFrame:
    """Rows to score with their results; ``train_time`` is the share of each of them."""
    start = time.perf_counter()
    extra = at["low"].to_numpy(float)
    mu, sigma = score(fit, np.stack(at["x"].to_numpy()), None if np.isnan(extra).all() else extra)
    return at[["cell_id", "key", *carry]].assign(
        mu=mu, sigma=sigma, n_primary=n_primary, n_secondary_rows=n_rest, train_time=train_time,
        test_time=(time.perf_counter() - start) / len(at))[list(_out(carry))]


def _fitted_and_scored(train: DataFrame, test: DataFrame, chunks: int, noise: float, solver, carry: tuple[str, ...]) -> DataFrame:
    """Cells whose rows to score are one group: fitted and scored by one task."""
    none = F.lit(None).cast("double")
    left = train.select("*", F.lit(None).cast("string").alias("key"), none.alias("low"), *[none.alias(c) for c in carry])
    right = test.drop("chunk").select("*", F.lit(-1).alias("task_no"), *[none.alias(c) for c in ("y", "rho", "variance", "lengthscale")])

    def job(pdf: pd.DataFrame) -> pd.DataFrame:
        at, rows = pdf[pdf.task_no < 0], pdf[pdf.task_no >= 0]
        if not len(at):
            return pd.DataFrame()
        if not len(rows):
            raise ValueError(f"cell {at.cell_id.iloc[0]} has no training rows")
        start = time.perf_counter()
        fit_cell, score_cell = solver(at.cell_id.iloc[0])
        fit = fit_cell(rows, noise)
        first = int((rows.task_no == 0).sum())
        return _scores(at, fit, score_cell, carry, first, len(rows) - first, (time.perf_counter() - start) / len(at))

    rows = left.unionByName(right).repartition(task_slots(train.sparkSession), "cell_id")
    return rows.groupBy("cell_id").applyInPandas(job, _kinds(_out(carry)))


def _scored_by_stored_fits(train: DataFrame, test: DataFrame, chunks: int, noise: float, solver, carry: tuple[str, ...]) -> DataFrame:
    """Cells with several groups of rows to score: each is fitted once, its fit is stored in pieces, which the groups read."""
    def store(pdf: pd.DataFrame) -> pd.DataFrame:
        start = time.perf_counter()
        fit = cloudpickle.dumps(solver(pdf.cell_id.iloc[0])[0](pdf, noise))
        first = int((pdf.task_no == 0).sum())
        pieces = [fit[lo:lo + PIECE_BYTES] for lo in range(0, len(fit), PIECE_BYTES)]
        return pd.DataFrame({"cell_id": pdf.cell_id.iloc[0], "piece": range(len(pieces)), "data": pieces, "n_primary": first,
                             "n_secondary_rows": len(pdf) - first, "seconds": time.perf_counter() - start})

    slots = task_slots(train.sparkSession)
    fits = cut_lineage(train.repartition(slots, "cell_id").groupBy("cell_id").applyInPandas(
        store, "cell_id string, piece int, data binary, n_primary bigint, n_secondary_rows bigint, seconds double"))
    sent = fits.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    total = test.groupBy("cell_id").agg(F.count("*").alias("to_score"))
    sent = sent.join(total, "cell_id", "left").repartition(slots, "cell_id", "chunk")

    def job(pieces: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if not len(at):
            return pd.DataFrame()
        if not len(pieces):
            raise ValueError(f"cell {at.cell_id.iloc[0]} has no training rows")
        one = pieces.iloc[0]
        fit = cloudpickle.loads(b"".join(pieces.sort_values("piece")["data"]))
        return _scores(at, fit, solver(one.cell_id)[1], carry, one.n_primary, one.n_secondary_rows, one.seconds / one.to_score)

    return sent.groupBy("cell_id", "chunk").cogroup(test.repartition(slots, "cell_id", "chunk").groupBy("cell_id", "chunk")).applyInPandas(
        job, _kinds(_out(carry)))


def fit_models(train: DataFrame, noise: float = NOISE, kernel: Kernel = squared_exponential, mean: Mean = np.mean) -> dict[str, dict]:
    """Fits of a few cells, brought to the driver after a check of their total size.

    ``train`` is read twice; store it first when it is expensive.
    """
    train = train.select(*TRAIN)
    sizes = train.groupBy("cell_id").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d"))
    need = sizes.agg(F.sum(8.0 * F.col("n") * (F.col("n") + F.col("d") + 8))).first()[0]
    if need > BROADCAST_BYTES:
        raise ValueError(f"fits need {need:.0f} bytes; score them with fit_and_predict instead")

    def job(pdf: pd.DataFrame) -> pd.DataFrame:
        f = fit_rows(pdf, noise, kernel, mean)
        arrays = [f["x"], f["task"].astype(float), np.stack(f["theta"]), f["means"], f["chol"], f["white"]]
        return pd.DataFrame({"cell_id": [pdf.cell_id.iloc[0]], "parts": [[a.tobytes() for a in arrays]],
                             "n": [len(pdf)]})

    fits = {}
    done = train.repartition(task_slots(train.sparkSession), "cell_id").groupBy("cell_id").applyInPandas(
        job, "cell_id string, parts array<binary>, n int")
    for r in done.collect():
        x, task, theta, means, chol, white = [np.frombuffer(bytes(p)) for p in r["parts"]]
        fits[r["cell_id"]] = dict(x=x.reshape(r["n"], -1), task=task.astype(int), theta=tuple(theta.reshape(3, -1)),
                                  means=means, chol=chol.reshape(r["n"], r["n"]), white=white, noise=noise, kernel=kernel)
    return fits


def _shared(test: DataFrame, fits: dict[str, dict]) -> Callable[[], dict[str, dict]]:
    """What gives the fits in a task: arrays by broadcast, kernels, which may be any function, with the job."""
    arrays = test.sparkSession.sparkContext.broadcast({c: {k: v for k, v in f.items() if k != "kernel"} for c, f in fits.items()})
    kernels = {c: f["kernel"] for c, f in fits.items()}
    return lambda: {c: {**f, "kernel": kernels[c]} for c, f in arrays.value.items()}


def score_rows(test: DataFrame, fits: dict[str, dict], low: str | None = None) -> DataFrame:
    """Every test row under every fit, without a shuffle; adds cell_id, mu, sigma and drops x."""
    shared = _shared(test, fits)
    keep = [f for f in test.schema if f.name != "x"]
    schema = StructType([*keep, StructField("cell_id", StringType()), StructField("mu", DoubleType()),
                         StructField("sigma", DoubleType())])
    names = [f.name for f in keep]

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy())
            for cell, fit in shared().items():
                mu, sigma = predict_rows(fit, x, pdf[low].to_numpy(float) if low else None)
                yield pdf[names].assign(cell_id=cell, mu=mu, sigma=sigma)

    return spread(test).mapInPandas(job, schema)


def score_levels(test: DataFrame, fits: dict[str, dict]) -> DataFrame:
    """Every test row under the sum of all fits, the levels of a chain of differences, without a shuffle; drops x."""
    shared = _shared(test, fits)
    keep = [f for f in test.schema if f.name != "x"]
    names = [f.name for f in keep]
    schema = StructType([*keep, StructField("mu", DoubleType()), StructField("sigma", DoubleType())])

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy())
            levels = [predict_rows(fit, x) for _, fit in sorted(shared().items())]
            yield pdf[names].assign(mu=sum(m for m, _ in levels), sigma=np.sqrt(sum(s * s for _, s in levels)))

    return spread(test).mapInPandas(job, schema)


def sum_levels(parts: DataFrame, keys: list[str]) -> DataFrame:
    """A chain of differences: means and variances of independent levels add up."""
    return parts.groupBy(*keys).agg(F.sum("mu").alias("mu"), F.sqrt(F.sum(F.col("sigma") ** 2)).alias("sigma"))


def prior_means(train: DataFrame) -> DataFrame:
    """Prior means per cell and task: the primary's mean, and each secondary's mean minus rho times it."""
    per = train.groupBy("cell_id", "task_no", "rho").agg(F.avg("y").alias("m"))
    base = per.where(F.col("task_no") == 0).select("cell_id", F.col("m").alias("m0"))
    shifted = F.when(F.col("task_no") == 0, F.col("m")).otherwise(F.col("m") - F.col("rho") * F.col("m0"))
    return per.join(base, "cell_id").select("cell_id", "task_no", shifted.alias("prior_mean"))


def _sum_partials(parts: DataFrame) -> bytes:
    """Sum of byte-packed arrays of all partitions, FAN_IN at a time, so no task gets them all."""
    parts = cut_lineage(parts)
    n = parts.count()
    while n > 1:
        n = ceil(n / FAN_IN)
        parts = parts.withColumn("part", F.pmod(F.col("part"), F.lit(n))).groupBy("part").applyInPandas(
            lambda pdf: pd.DataFrame({"part": [pdf.part.iloc[0]], "total": [
                sum(np.frombuffer(b) for b in pdf["total"]).tobytes()]}), PARTIAL)
    return sum(np.frombuffer(bytes(r["total"])) for r in parts.select("total").collect())


def inducing_fit(train: DataFrame, landmarks: np.ndarray, variance: float, lengthscale: float,
                 noise: float = NOISE) -> dict:
    """Regression on ``m`` landmarks from one pass over a training table of any size.

    Each partition adds up its m x m and m x 1 products; the partial sums are
    combined in a tree, and only the final m x m system reaches the driver.
    """
    m = len(landmarks)
    if 8 * m * m > BROADCAST_BYTES // 8:
        raise ValueError(f"{m} landmarks are too many for a driver-side solve")
    z = train.sparkSession.sparkContext.broadcast(landmarks)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kk, ky, k1, n, sy, part = np.zeros((m, m)), np.zeros(m), np.zeros(m), 0.0, 0.0, 0
        for pdf in batches:
            if not len(pdf):
                continue
            part = int(pdf["part"].iloc[0])
            y = pdf["y"].to_numpy(float)
            k = variance * np.exp(-sq_distances(z.value, np.stack(pdf["x"].to_numpy())) / (2 * lengthscale**2))
            kk += k @ k.T
            ky += k @ y
            k1 += k.sum(1)
            n, sy = n + len(y), sy + y.sum()
        if n:
            yield pd.DataFrame({"part": [part], "total": [
                np.concatenate([kk.ravel(), ky, k1, [n, sy]]).tobytes()]})

    rows = spread(train.select("x", "y")).select("x", "y", F.spark_partition_id().alias("part"))
    t = _sum_partials(rows.mapInPandas(partial, PARTIAL))
    s, ky, k1, n, sy = t[:m * m].reshape(m, m), t[m * m:m * m + m], t[m * m + m:m * m + 2 * m], t[-2], t[-1]
    mean = sy / n
    kzz = variance * np.exp(-sq_distances(landmarks, landmarks) / (2 * lengthscale**2))
    chol = np.linalg.cholesky(kzz + 1e-10 * variance * np.eye(m))
    inv = np.linalg.solve(chol, np.eye(m))
    inner = noise * np.eye(m) + inv @ s @ inv.T
    inner_inv = np.linalg.inv(np.linalg.cholesky(inner))
    white = inner_inv.T @ (inner_inv @ (inv @ (ky - mean * k1)))
    return dict(z=landmarks, v=variance, l=lengthscale, mean=mean, inv=inv, inner_inv=inner_inv, white=white,
                noise=noise)


def inducing_score(test: DataFrame, fit: dict) -> DataFrame:
    """Mean and deviation of every row under an inducing-point fit, without a shuffle."""
    shared = test.sparkSession.sparkContext.broadcast(fit)
    keep = [f for f in test.schema if f.name != "x"]
    names = [f.name for f in keep]
    schema = StructType([*keep, StructField("mu", DoubleType()), StructField("sigma", DoubleType())])

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            k = f["v"] * np.exp(-sq_distances(f["z"], np.stack(pdf["x"].to_numpy())) / (2 * f["l"] ** 2))
            q = f["inv"] @ k
            r = f["inner_inv"] @ q
            var = f["v"] - (q * q).sum(0) + f["noise"] * (r * r).sum(0)
            yield pdf[names].assign(mu=f["mean"] + f["white"] @ q, sigma=np.sqrt(np.maximum(var, 0.0)))

    return spread(test).mapInPandas(job, schema)
