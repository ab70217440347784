"""Error statistics, exact medians, rank correlations and conformal scaling.

No statistic gathers a group in one task: medians and conformal quantiles pick
positions of a bucketed index, and Kendall's tau counts inversions in blocks of
bounded size plus a block histogram.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tiersmith.functions.columns import safe_div
from tiersmith.operators.relational import join_groups
from tiersmith.operators.rows import row_index
from tiersmith.session import cut_lineage

BLOCK_ROWS = 1 << 15
MAX_BLOCKS = 1024
MAX_LOCAL = 1 << 20
#: Groups whose size has such a bound may be gathered in a task.
BOUNDED_ROWS = 4096


def pearson(x: str, y: str) -> Column:
    """Correlation that is null for constant input."""
    return safe_div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _ranked(df: DataFrame, group: list[str], value: str, ties: list[str], n: int | None) -> tuple[DataFrame, Column]:
    """Non-null values with a column that is the value at the middle positions of the group and null elsewhere."""
    rows = df.where(F.col(value).isNotNull()).select(*group, value, *ties)
    ranked = row_index(rows, [value, *ties], group=group, out="__i", total="__n", n=n)
    half = (F.col("__n") + 1) / 2
    middle = (F.col("__i") >= F.floor(half)) & (F.col("__i") <= F.ceil(half))
    return ranked, F.when(middle, F.col(value))


def medians(df: DataFrame, group: list[str], value: str, ties: list[str], n: int | None = None) -> DataFrame:
    """Exact median per group; ``ties`` makes the order total so that repeated values spread."""
    ranked, middle = _ranked(df, group, value, ties, n)
    return ranked.groupBy(*group).agg(F.avg(middle).alias("median"))


def abs_stats(long: DataFrame, group: list[str], value: str, ties: list[str], n: int | None = None) -> DataFrame:
    """Mean, median, minimum and maximum of the absolute value, and the number of rows with a value."""
    ranked, middle = _ranked(long.withColumn(value, F.abs(value)), group, value, ties, n)
    return ranked.groupBy(*group).agg(F.avg(value).alias("mean"), F.avg(middle).alias("median"),
                                      F.min(value).alias("minimum"), F.max(value).alias("maximum"),
                                      F.count("*").alias("n"))


def task_medians(log: DataFrame, columns: list[str] = ("variance", "lengthscale", "rho"),
                 ties: list[str] = ("seed",)) -> DataFrame:
    """Median of each parameter per task of a search log."""
    long = log.select("task", *ties, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v"))
                                                        for c in columns])).alias("e"))
    med = medians(long.select("task", *ties, "e.name", "e.v"), ["task", "name"], "v", list(ties))
    return med.groupBy("task").agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in columns])


def inversions(order: np.ndarray) -> float:
    """Number of pairs that are out of order in a permutation of 0..m-1, bit by bit."""
    cur = np.asarray(order, dtype=np.int64)
    total = 0.0
    if len(cur) < 2:
        return total
    for k in range(int(len(cur) - 1).bit_length() - 1, -1, -1):
        high, bit = cur >> (k + 1), (cur >> k) & 1
        ones = np.cumsum(bit) - bit
        start = np.searchsorted(high, high, side="left")
        total += float((ones - ones[start])[bit == 0].sum())
        cur = cur[np.argsort(cur >> k, kind="stable")]
    return total


def _block_inversions(pdf: pd.DataFrame) -> float:
    b = pdf.sort_values("a")["b"].to_numpy()
    return inversions(np.argsort(np.argsort(b)))


def discordant_pairs(ranked: DataFrame, group: list[str], n: int, largest: int | None = None,
                     depth: int = 0) -> DataFrame:
    """Strictly discordant pairs per group from the two total orders ``a`` and ``b``, as partial counts.

    Pairs in one a-block are counted there, pairs in one b-block but different
    a-blocks there, and all others from the block histogram. Blocks that are
    still too large for a task are groups of a further round. ``n`` is the
    number of rows, ``largest`` a bound on the size of a group.
    """
    largest = n if largest is None else largest
    size = max(BLOCK_ROWS, ceil(largest / MAX_BLOCKS))
    xb, yb = f"xb{depth}", f"yb{depth}"
    blocks = ranked.select(*group, "a", "b", F.floor((F.col("a") - 1) / size).alias(xb),
                           F.floor((F.col("b") - 1) / size).alias(yb))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*group).schema]
                       + ["discordant double"])

    def in_a(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[group].head(1).assign(discordant=_block_inversions(pdf))

    def in_b(pdf: pd.DataFrame) -> pd.DataFrame:
        same = sum(_block_inversions(p) for _, p in pdf.groupby(xb))
        return pdf[group].head(1).assign(discordant=_block_inversions(pdf) - same)

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.zeros((int(pdf[xb].max()) + 2, int(pdf[yb].max()) + 2))
        np.add.at(h, (pdf[xb].to_numpy(int) + 1, pdf[yb].to_numpy(int)), pdf["c"].to_numpy(float))
        above = h[:, ::-1].cumsum(axis=1)[:, ::-1]
        earlier = above.cumsum(axis=0)
        return pdf[group].head(1).assign(discordant=float((h[1:, :-1] * earlier[:-1, 1:]).sum()))

    if largest <= size:
        return blocks.groupBy(*group, xb).applyInPandas(in_a, schema)
    hist = blocks.groupBy(*group, xb, yb).agg(F.count("*").alias("c"))
    parts = [hist.groupBy(*group).applyInPandas(across, schema)]
    if size <= MAX_LOCAL:
        parts += [blocks.groupBy(*group, xb).applyInPandas(in_a, schema),
                  blocks.groupBy(*group, yb).applyInPandas(in_b, schema)]
    else:
        for by, sign in (([xb], 1.0), ([yb], 1.0), ([xb, yb], -1.0)):
            sub, inner = blocks.select(*group, *by, "a", "b"), [*group, *by]
            first = row_index(sub, ["a"], group=inner, out="a2", n=n)
            both = row_index(first, ["b"], group=inner, out="b2", n=n, source=sub)
            dense = cut_lineage(both.select(*inner, F.col("a2").alias("a"), F.col("b2").alias("b")))
            deeper = discordant_pairs(dense, inner, n, size, depth + 1)
            parts.append(deeper.select(*group, (sign * F.col("discordant")).alias("discordant")))
    return reduce(lambda u, v: u.unionByName(v), parts)


def rank_correlations(pairs: DataFrame, group: list[str], key: str, *, n: int | None = None) -> DataFrame:
    """Pearson, Spearman (average ranks) and Kendall (tau-b) of x and y per group.

    ``n`` is the number of rows; giving it says that ``pairs`` is cheap to read
    again and has no nulls, otherwise the rows are written once first.
    """
    rows = pairs.select(*group, key, "x", "y")
    if n is None:
        rows = cut_lineage(rows.where(F.col("x").isNotNull() & F.col("y").isNotNull()))
        n = rows.count()
    first = row_index(rows, ["x", "y", key], group=group, out="a", n=n)
    both = row_index(first, ["y", "x", key], group=group, out="b", n=n, source=rows)
    ranked = cut_lineage(both.select(*group, "x", "y", "a", "b"))
    t = F.col("t")
    lone = t * (t - 1.0) / 2.0

    def ties(by: str, at: str, name: str) -> DataFrame:
        return ranked.groupBy(*group, by).agg(((F.min(at) + F.max(at)) / 2.0).alias(f"r_{name}"),
                                              F.count("*").cast("double").alias("t"))

    tx, ty = ties("x", "a", "x"), ties("y", "b", "y")
    txy = ranked.groupBy(*group, "x", "y").agg(F.count("*").cast("double").alias("t"))
    cross = join_groups(join_groups(txy, tx.drop("t"), [*group, "x"]), ty.drop("t"), [*group, "y"])
    parts = [tx.select(*group, lone.alias("n1"), t.alias("n"), (t * F.col("r_x") * F.col("r_x")).alias("qx")),
             ty.select(*group, lone.alias("n2"), (t * F.col("r_y") * F.col("r_y")).alias("qy")),
             cross.select(*group, (t * F.col("r_x") * F.col("r_y")).alias("qxy"), lone.alias("n3")),
             discordant_pairs(ranked, group, n),
             ranked.groupBy(*group).agg(pearson("x", "y").alias("pearson"))]
    names = ["n", "n1", "n2", "n3", "qx", "qy", "qxy", "discordant"]
    sums = reduce(lambda u, v: u.unionByName(v, allowMissingColumns=True), parts).groupBy(*group).agg(
        *[F.sum(c).alias(c) for c in names], F.max("pearson").alias("pearson"))
    n_, m2 = F.col("n"), F.col("n") * (F.col("n") + 1) * (F.col("n") + 1) / 4.0
    spearman = safe_div(F.col("qxy") - m2, F.sqrt((F.col("qx") - m2) * (F.col("qy") - m2)))
    n0 = n_ * (n_ - 1) / 2.0
    score = n0 - F.col("n1") - F.col("n2") + F.col("n3") - 2 * F.col("discordant")
    kendall = safe_div(score, F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2"))))
    return sums.select(*group, "pearson", spearman.alias("spearman"), kendall.alias("kendall"))


def result_rows(pred: DataFrame, group: list[str], key: str, *, stored: bool = False) -> DataFrame:
    """The 18 statistics of predictions ``(group, key, mu, sigma, truth)``.

    ``stored`` says that ``pred`` is read from storage, not recomputed.

    With the columns mu_total and truth_total (a difference prediction) the
    relative error refers to the total truth and the first correlations to the totals.
    """
    mu, truth = ("mu_total", "truth_total") if "mu_total" in pred.columns else ("mu", "truth")
    rows = pred.withColumn("__e", F.col("mu") - F.col("truth")).where(F.col("__e").isNotNull() & F.col("sigma").isNotNull())
    rows = rows if stored else cut_lineage(rows)
    n = rows.count()

    def pick(*entries: Column) -> Column:
        return F.explode(F.array(*entries)).alias("e")

    metric = rows.select(*group, key, pick(
        F.struct(F.lit("error").alias("name"), F.col("__e").alias("v")),
        F.struct(F.lit("relative").alias("name"), safe_div(F.col("__e"), F.col(truth)).alias("v")),
        F.struct(F.lit("std").alias("name"), F.col("sigma").alias("v")))).select(*group, key, "e.name", "e.v")
    spread = abs_stats(metric, [*group, "name"], "v", [key], 3 * n)
    two = rows.select(*group, key, pick(
        F.struct(F.lit("error").alias("name"), F.col(mu).alias("x"), F.col(truth).alias("y")),
        F.struct(F.lit("std").alias("name"), F.col("sigma").alias("x"), F.abs("__e").alias("y")))) \
        .select(*group, key, "e.name", "e.x", "e.y")
    cors = rank_correlations(two, [*group, "name"], key, n=2 * n)

    def widen(df: DataFrame, stats: dict[str, str], names: list[str]) -> DataFrame:
        return df.groupBy(*group).agg(*[F.max(F.when(F.col("name") == m, F.col(c))).alias(f"{p}_{m}")
                                        for m in names for c, p in stats.items()])

    left = widen(spread, {"mean": "mae", "median": "median_ae", "minimum": "minimum_ae", "maximum": "maximum_ae"},
                 ["error", "relative", "std"])
    right = widen(cors, {c: c for c in ("pearson", "spearman", "kendall")}, ["error", "std"])
    return join_groups(left, right, group, "left")


def _ranks(v: np.ndarray) -> np.ndarray:
    """Average ranks."""
    values, place, count = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2.0)[place]


def _agreement(x: np.ndarray, y: np.ndarray) -> dict[str, float | None]:
    """Pearson, Spearman and Kendall (tau-b) of a few thousand values; None where a side is constant."""
    if len(x) == 0 or (x == x[0]).all() or (y == y[0]).all():
        return dict.fromkeys(("pearson", "spearman", "kendall"))

    def corr(a: np.ndarray, b: np.ndarray) -> float:
        a, b = a - a.mean(), b - b.mean()
        return float((a @ b) / np.sqrt((a @ a) * (b @ b)))

    sx, sy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    tau = float((sx * sy).sum() / np.sqrt((sx * sx).sum() * (sy * sy).sum()))
    return {"pearson": corr(x, y), "spearman": corr(_ranks(x), _ranks(y)), "kendall": tau}


def bounded_result_rows(pred: DataFrame, group: list[str]) -> DataFrame:
    """``result_rows`` for groups whose size has a bound of at most ``BOUNDED_ROWS``: one grouped pass."""
    mu, truth = ("mu_total", "truth_total") if "mu_total" in pred.columns else ("mu", "truth")
    names = [f"{p}_{m}" for m in ("error", "relative", "std") for p in ("mae", "median_ae", "minimum_ae", "maximum_ae")]
    names += [f"{p}_{m}" for m in ("error", "std") for p in ("pearson", "spearman", "kendall")]
    rows = pred.select(*group, F.col("mu").alias("__mu"), F.col("truth").alias("__truth"), F.col("sigma").alias("__sigma"),
                       F.col(mu).alias("__m"), F.col(truth).alias("__t"))

    def job(pdf: pd.DataFrame) -> pd.DataFrame:
        e = (pdf["__mu"] - pdf["__truth"]).to_numpy(float)
        keep = ~(np.isnan(e) | np.isnan(pdf["__sigma"].to_numpy(float)))
        if not keep.any():
            return pd.DataFrame()
        if keep.sum() > BOUNDED_ROWS:
            raise ValueError(f"a group of {keep.sum()} rows; use result_rows")
        e, sigma, m, t = e[keep], *(pdf.loc[keep, c].to_numpy(float) for c in ("__sigma", "__m", "__t"))
        with np.errstate(divide="ignore", invalid="ignore"):
            relative = np.where(t != 0, e / t, np.nan)
        out: dict[str, object] = {g: pdf[g].iloc[0] for g in group}
        for name, v in (("error", e), ("relative", relative), ("std", sigma)):
            v = np.abs(v[~np.isnan(v)])
            found = (v.mean(), np.median(v), v.min(), v.max()) if len(v) else (None,) * 4
            out |= {f"{p}_{name}": x for p, x in zip(("mae", "median_ae", "minimum_ae", "maximum_ae"), found)}
        for name, (x, y) in {"error": (m, t), "std": (sigma, np.abs(e))}.items():
            out |= {f"{p}_{name}": x for p, x in _agreement(x, y).items()}
        return pd.DataFrame([out])[[*group, *names]]

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pred.select(*group).schema]
    return rows.groupBy(*group).applyInPandas(job, ", ".join([*kinds, *[f"`{n}` double" for n in names]]))


def conformal_scales(calibration: DataFrame, group: list[str], key: str, alpha: float = 0.05) -> DataFrame:
    """Per group the ceil((n+1)(1-alpha))-th smallest score |mu-truth|/sigma; infinite when n is too small."""
    scored = (calibration.withColumn("score", safe_div(F.abs(F.col("mu") - F.col("truth")), F.col("sigma")))
                         .where(F.col("score").isNotNull()).select(*group, key, "score"))
    ranked = row_index(scored, ["score", key], group=group, out="__i", total="__n")
    k = F.ceil((F.col("__n") + 1) * F.lit(1 - alpha))
    at = F.max(F.when(F.col("__i") == k, F.col("score")))
    return ranked.groupBy(*group).agg(F.max("__n").alias("n"), F.coalesce(at, F.lit(float("inf"))).alias("scale"))


def apply_scales(target: DataFrame, scales: DataFrame, group: list[str]) -> DataFrame:
    return join_groups(target, scales.select(*group, "scale"), group) \
        .withColumn("conformal", F.col("scale") * F.col("sigma"))


def coverage(df: DataFrame, group: list[str]) -> DataFrame:
    """Share of rows with the truth strictly inside the interval, before and after scaling."""
    def inside(w: str) -> Column:
        hit = (F.col("truth") > F.col("mu") - F.col(w)) & (F.col("truth") < F.col("mu") + F.col(w))
        return F.avg(hit.cast("double"))

    return df.groupBy(*group).agg(inside("sigma").alias("before"), inside("conformal").alias("after"))
