"""Prediction methods over grids of training sets: scenarios x seeds x cases as one job.

A method is an object in ``METHODS``: which rows it trains on, how it fits and
scores a cell, and how its results are named. ``register`` adds others, whose
cells are dispatched in the same grouped job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from itertools import permutations
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tiersmith.operators.gp import NOISE, Kernel, Mean, fit_and_predict, fit_rows, predict_rows, squared_exponential
from tiersmith.operators.grid import CELL, cell_counts, expand_cases, identifiers, level_members, membership
from tiersmith.operators.relational import back_transform, difference_columns, lookup_parameters, stack
from tiersmith.operators.sampling import nested_split
from tiersmith.operators.stats import BOUNDED_ROWS, bounded_result_rows, result_rows
from tiersmith.session import cut_lineage



@dataclass(frozen=True)
class Method:
    """How cells of a kind are trained, scored and named.

    ``result_name`` stands in the results' method column; without one, results
    go by the only task. ``chained`` fits each level of differences between
    neighbouring tasks by itself, levels are summed; ``with_target`` adds the
    value that a predicted row has for the last task to the training set of that
    row. ``fit(rows, noise)`` gets the training rows of a cell (task_no, x, y,
    rho, variance, lengthscale) and ``score(fit, x, low)`` gives means and
    deviations; ``low`` is null unless ``with_target``. Without ``fit``, cells
    are Gaussian-process regressions with the run's kernel and prior mean.
    """
    name: str
    result_name: str | None = "Multitask"
    chained: bool = False
    with_target: bool = False
    fit: Callable | None = None
    score: Callable = predict_rows

    def solver(self, kernel: Kernel, mean: Mean) -> tuple[Callable, Callable]:
        return self.fit or partial(fit_rows, kernel=kernel, mean=mean), self.score


METHODS: dict[str, Method] = {}


def register(method: Method) -> Method:
    METHODS[method.name] = method
    return method


register(Method("single", None))
register(Method("multitask"))
register(Method("multitask_with_target", with_target=True))
register(Method("delta", "Delta", chained=True))


def method_traits() -> dict[str, tuple[str | None, bool]]:
    """For ``identifiers``: result name, and whether the predicted row's own value counts as a row."""
    return {m.name: (m.result_name, m.with_target or m.chained) for m in METHODS.values()}


DEFAULT_A = (0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)


@dataclass(frozen=True)
class Scenario:
    """A method applied to one ordered list of tasks.

    ``parameters`` names the parameter rows, primary first; a delta scenario
    names one row per pair of neighbouring tasks.
    """
    name: str
    method: str
    primary: str
    secondaries: tuple[str, ...] = ()
    cores: tuple[int, ...] = (5, 10, 20, 40)
    c_ratios: tuple[float, ...] = (0.0, 1.0)
    a_ratios: tuple[float, ...] = DEFAULT_A
    shares: tuple[float, ...] = (1.0,)
    parameters: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method!r}; known are {', '.join(METHODS)}")

    @property
    def tasks(self) -> tuple[str, ...]:
        return (self.primary, *self.secondaries)

    @property
    def parameter_names(self) -> tuple[str, ...]:
        if self.parameters:
            return self.parameters
        if METHODS[self.method].chained:
            return tuple(f"{a}_{b}" for a, b in zip(self.tasks, self.tasks[1:]))
        return self.tasks


def single(name: str, primary: str, cores: tuple[int, ...], **kw) -> Scenario:
    return Scenario(name, "single", primary, (), cores, (0.0,), (0.0,), **kw)


def scenario_cells(seeds: DataFrame, scenarios: list[Scenario]) -> DataFrame:
    """Cells of all scenarios for the rows of ``seeds(seed)``, exploded from one array of scenarios."""
    def entry(s: Scenario):
        def numbers(values):
            return F.array(*[F.lit(float(v)) for v in values])
        return F.struct(
            F.lit(s.name).alias("scenario"), F.lit(s.method).alias("kind"), F.lit(len(s.secondaries)).alias("n_secondary"),
            F.array(*[F.lit(t) for t in s.tasks]).alias("tasks"), F.array(*[F.lit(int(c)) for c in s.cores]).alias("cores"),
            numbers(s.c_ratios).alias("cs"), numbers(s.a_ratios).alias("as"), numbers(s.shares).alias("ss"))

    base = seeds.select("seed", F.explode(F.array(*[entry(s) for s in scenarios])).alias("s")).select("seed", "s.*") \
                .withColumn("core", F.explode("cores"))
    return expand_cases(base, "cs", "as", "ss").select(*CELL, "n_secondary", "kind", "tasks")


def cell_id():
    return F.concat_ws("|", *[F.col(c).cast("string") for c in CELL])


def _task_table(spark, scenarios: list[Scenario]) -> DataFrame:
    """Scenario names with their method, task list and the parameter row of every task or level."""
    rows = [(s.name, s.method, s.tasks, i, p) for s in scenarios for i, p in enumerate(s.parameter_names)]
    return spark.createDataFrame(rows, "scenario string, kind string, tasks array<string>, task_no int, task string").coalesce(1)


def _value(i) -> F.Column:
    """Measurement of the i-th task of the scenario."""
    return F.col("v")[F.element_at("tasks", i + 1)]


#: Bytes of the sample that every cell reads, up to which it is broadcast.
POOL_BYTES = 64 << 20


def _sent_whole(pool: DataFrame, names: int) -> DataFrame:
    """The stored sample, broadcast if its measured size allows it.

    Cells outnumber its rows by far and ask for the same first positions, so a
    shuffle would send most of them to the tasks of a few keys.
    """
    rows, d = pool.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    return F.broadcast(pool) if rows * (8 * d + 64 * names + 128) <= POOL_BYTES else pool


def predict_cells(measurements: DataFrame, key: str, tasks: list[str], params: DataFrame, scenarios: list[Scenario],
                  seeds: list[int], target: int, *, noise: float = NOISE, kernel: Kernel = squared_exponential,
                  mean: Mean = np.mean) -> DataFrame:
    """Predictions of all target rows of all cells in one grouped job.

    ``measurements(key, x, <tasks>)``; all scenarios of a seed share T, C and A.
    A level of a difference chain is a fit of its own; levels are summed per row.
    """
    spark = measurements.sparkSession
    core = max(max(s.cores) for s in scenarios)
    extra = max(ceil(max(s.a_ratios) * max(s.cores)) for s in scenarios)
    split = nested_split(measurements.select(key, "x", *tasks), key, target, core, extra, seeds)
    names = [*tasks, *[f"{a}_{b}" for a, b in permutations(tasks, 2)]]
    # The sample is bounded by the grid; it is stored because every cell reads it.
    pool = cut_lineage(difference_columns(split, tasks).select(
        "seed", "part", "pos", key, "x", F.create_map(*[v for c in names for v in (F.lit(c), F.col(c))]).alias("v")))
    pool = _sent_whole(pool, len(names))
    table = _task_table(spark, scenarios)
    # One row per scenario and task; hashing training rows by so few keys would leave most tasks idle.
    par = F.broadcast(lookup_parameters(table, params).drop("task"))
    by_level = [s.name for s in scenarios if METHODS[s.method].chained]
    chained = F.col("scenario").isin(by_level)
    cells = scenario_cells(spark.createDataFrame([(int(s),) for s in seeds], "seed int").coalesce(1), scenarios)
    members = membership(cells.drop("kind", "tasks"), pool, [key, "x", "v"])

    plain = (members.where(~chained).join(par, ["scenario", "task_no"])
                    .withColumn("y", _value(F.col("task_no"))).withColumn("level", F.lit(1)))
    trains = [plain]
    if by_level:
        levels = level_members(members.where(chained), CELL, key).join(pool.select("seed", key, "x", "v"), ["seed", key])
        trains.append(levels.withColumn("task_no", F.col("level") - 1).join(par, ["scenario", "task_no"])
                            .withColumn("y", _value(F.col("task_no")) - _value(F.col("task_no") + 1))
                            .withColumn("task_no", F.lit(0)).withColumn("rho", F.lit(1.0)))
    fit_id = F.concat_ws("#", cell_id(), "level")
    train = stack([t.select(fit_id.alias("cell_id"), "task_no", "x", "y", "rho", "variance", "lengthscale") for t in trains])

    last = F.col("v")[F.element_at("tasks", -1)]
    is_delta = F.col("kind").isin([m.name for m in METHODS.values() if m.chained])
    own_value = F.col("kind").isin([m.name for m in METHODS.values() if m.with_target])
    level_list = F.when(is_delta, F.sequence(F.lit(1), F.col("n_secondary"))).otherwise(F.array(F.lit(1)))
    tests = (cells.join(pool.where(F.col("part") == "T").select("seed", key, "x", "v"), "seed")
                  .withColumn("baseline", F.when(is_delta, last).otherwise(0.0))
                  .withColumn("truth", F.col("v")[F.col("tasks")[0]] - F.col("baseline"))
                  .withColumn("low", F.when(own_value, last))
                  .withColumn("level", F.explode(level_list)).withColumn("cell_id", fit_id))
    solvers = {s.name: METHODS[s.method].solver(kernel, mean) for s in scenarios}
    names_end = len(CELL) - 1  # a scenario's name may hold the mark between the parts of a cell's
    parts = fit_and_predict(train, tests, key, test_rows=target, noise=noise, low="low", carry=("truth", "baseline"),
                            solver=lambda cell: solvers[cell.rsplit("|", names_end)[0]])
    level = F.element_at(F.split("cell_id", "#"), -1)
    summed = (parts.withColumn("level", level).withColumn("cell_id", F.regexp_replace("cell_id", "#[0-9]+$", ""))
                   .groupBy("cell_id", key).agg(
        F.sum("mu").alias("mu"), F.sqrt(F.sum(F.col("sigma") ** 2)).alias("sigma"),
        F.max("truth").alias("truth"), F.max("baseline").alias("baseline"), F.lit(1.0).alias("factor"),
        F.max(F.when(F.col("level") == "1", F.col("n_primary"))).alias("n_first"),
        F.sum("n_primary").alias("n_levels"), F.sum("n_secondary_rows").alias("n_rest"),
        F.sum("train_time").alias("train_time"), F.sum("test_time").alias("test_time")))
    named = cells.select(
        cell_id().alias("cell_id"), "kind", *CELL, "n_secondary", F.col("tasks")[0].alias("primary"),
        F.element_at("tasks", -1).alias("last_task"))
    return summed.join(named, "cell_id").select(
        "cell_id", "kind", *CELL, "n_secondary", "primary", "last_task", key, "mu", "sigma", "truth", "baseline", "factor",
        F.col("n_first").alias("n_primary"),
        F.when(is_delta, F.col("n_levels")).otherwise(F.col("n_rest")).alias("n_secondary_rows"), "train_time", "test_time")


def cell_identifiers(members: DataFrame, key: str, scenarios: list[Scenario]) -> DataFrame:
    """Identifier columns of every cell, counted from its training rows."""
    spark = members.sparkSession
    names = spark.createDataFrame([(s.name, s.method, s.primary, s.tasks[-1], len(s.secondaries)) for s in scenarios],
                                  "scenario string, kind string, primary string, last_task string, n_secondary int").coalesce(1)
    chained = F.col("scenario").isin([s.name for s in scenarios if METHODS[s.method].chained])
    levels = level_members(members.where(chained), CELL, key)
    counts = stack([cell_counts(members.where(~chained)), levels.groupBy(*CELL).agg(
        F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).alias("n_primary"), F.count("*").alias("n_secondary_rows"))])
    return identifiers(counts.join(names, "scenario"), method_traits()).select(
        *CELL, "levels", "lowest", "high_level", "low_level", "method", "datasets", "task_fractions")


def run_grid(measurements: DataFrame, key: str, tasks: list[str], params: DataFrame, scenarios: list[Scenario],
             seeds: list[int], target: int, *, noise: float = NOISE, kernel: Kernel = squared_exponential,
             mean: Mean = np.mean) -> DataFrame:
    """Result rows of all scenarios, seeds and cases: identifiers, times and the 18 statistics."""
    pred = cut_lineage(predict_cells(measurements, key, tasks, params, scenarios, seeds, target, noise=noise, kernel=kernel, mean=mean))
    total = back_transform(pred)  # a cell has ``target`` rows
    stats = bounded_result_rows(total, ["cell_id"]) if target <= BOUNDED_ROWS else result_rows(total, ["cell_id"], key, stored=True)
    about = ["kind", "seed", "c_ratio", "a_ratio", "shared", "n_secondary", "primary", "last_task"]
    counts = pred.groupBy("cell_id", *about).agg(
        F.max("n_primary").alias("n_primary"), F.max("n_secondary_rows").alias("n_secondary_rows"),
        F.sum("train_time").alias("train_time"), F.sum("test_time").alias("test_time"))
    return (identifiers(counts, method_traits()).join(stats, "cell_id").withColumn("target", F.lit(target))
                               .drop("cell_id", *[c for c in about if c != "seed"], "n_primary", "n_secondary_rows"))
