"""Cost against error across many runs: the data behind the comparison figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tiersmith.functions.columns import COST_MODELS, linear_cost, safe_div
from tiersmith.operators.grid import expected_low_level
from tiersmith.operators.relational import stack, tuple_filter
from tiersmith.operators.stats import medians

RUN_CELL = ["method", "datasets", "levels", "lowest", "task_fractions", "high_level", "low_level"]


def mean_over_runs(runs: DataFrame, metrics: list[str] = ("mae_error",), keys: list[str] = RUN_CELL) -> DataFrame:
    """Mean of each metric over all runs of a cell, and how many runs there were."""
    return runs.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("n_runs"),
                                   F.countDistinct("seed").alias("n_seeds"))


def std_over_runs(runs: DataFrame, metrics: list[str] = ("mae_error",), keys: list[str] = RUN_CELL) -> DataFrame:
    return runs.groupBy(*keys).agg(*[F.stddev_samp(m).alias(m) for m in metrics])


def with_cost(df: DataFrame, model: str | tuple[float, float] | Callable[[Column, Column], Column] = "water") -> DataFrame:
    """Attach seconds by a linear model of the two counts, or by any function of the two columns."""
    if callable(model):
        return df.withColumn("cost", model(F.col("high_level"), F.col("low_level")))
    high, low = COST_MODELS[model] if isinstance(model, str) else model
    return df.withColumn("cost", linear_cost(F.col("high_level"), F.col("low_level"), high, low))


def with_cost_table(df: DataFrame, models: DataFrame, key: str = "domain") -> DataFrame:
    """The same with coefficients from ``models(domain, per_high, per_low)``."""
    return df.join(models, key).withColumn(
        "cost", F.col("high_level") * F.col("per_high") + F.col("low_level") * F.col("per_low"))


def _series(means: DataFrame, name: str, columns: list[str], values: tuple, cost) -> DataFrame:
    return with_cost(tuple_filter(means, columns, [values]), cost).select(
        F.lit(name).alias("series"), *RUN_CELL, "cost", F.col("mae_error").alias("mae"))


FULL = ["method", "datasets", "levels", "lowest"]


def reference_curve(means: DataFrame, primary: str, cost="water") -> DataFrame:
    return _series(means, "reference", ["method"], (primary,), cost)


def two_task_curve(means: DataFrame, primary: str, datasets: str, lowest: str, cost="water") -> DataFrame:
    return stack([_series(means, datasets, FULL, ("Multitask", datasets, 2, lowest), cost),
                  _series(means, datasets + "T", FULL, ("Multitask", datasets + "T", 2, lowest), cost),
                  reference_curve(means, primary, cost)])


def three_task_curve(means: DataFrame, primary: str, datasets: str, lowest: list[str], cost="water") -> DataFrame:
    threes = lowest[:1] if datasets in ("C", "A", "CA") else lowest
    return stack([_series(means, f"3 levels ({w})", FULL, ("Multitask", datasets, 3, w), cost) for w in threes]
                 + [_series(means, f"2 levels ({w})", FULL, ("Multitask", datasets, 2, w), cost) for w in lowest]
                 + [reference_curve(means, primary, cost)])


def layer_curves(means: DataFrame, datasets: str, layers: list[tuple[int, str, float]], primary: str, cost="water") -> DataFrame:
    """Every cell of (levels, lowest, fraction) layers as a series of its own, and the reference curve."""
    out = [_series(means, f"{levels} levels ({lowest})", [*FULL, "task_fractions"],
                   ("Multitask", datasets, levels, lowest, fraction if levels > 2 else 1.0), cost) for levels, lowest, fraction in layers]
    return stack([*out, reference_curve(means, primary, cost)])


def layer_band(means: DataFrame, datasets: str, layers: list[tuple[int, str, float]], cost="water",
               low_ratio: float = 1.0, high_ratio: float = 6.0) -> DataFrame:
    """Error at the smallest and the largest additional set per core size, for (levels, lowest, fraction) layers."""
    def edge(cells: DataFrame, levels: int, share: float, ratio: float) -> DataFrame:
        size = expected_low_level(F.col("high_level"), F.lit(datasets), F.lit(levels - 1), F.lit(share), F.lit(ratio))
        return cells.where(F.col("low_level") == size)

    out = []
    for levels, lowest, fraction in layers:
        share = fraction if levels > 2 else 1.0
        cells = tuple_filter(means, [*FULL, "task_fractions"], [("Multitask", datasets, levels, lowest, share)])
        low = with_cost(edge(cells, levels, share, low_ratio), cost).select(
            F.lit(levels).alias("levels"), F.lit(lowest).alias("lowest"), "high_level", "cost",
            F.col("mae_error").alias("mae_low"))
        high = edge(cells, levels, share, high_ratio).select("high_level", F.col("mae_error").alias("mae_high"))
        out.append(low.join(high, "high_level"))
    return stack(out)


def additional_rows() -> Column:
    """Secondary rows of a cell beyond the core set and the target row (one secondary task)."""
    label = F.col("datasets")
    return (F.col("low_level") - F.when(label.startswith("C"), F.col("high_level")).otherwise(0)
            - F.when(label.endswith("T"), 1).otherwise(0)).alias("extra")


def core_benefit(means: DataFrame, datasets: str, lowest: str) -> DataFrame:
    """Error without against error with the core set, for equal additional sets (two tasks)."""
    def side(label: str, name: str) -> DataFrame:
        return tuple_filter(means, FULL, [("Multitask", label, 2, lowest)]).select(
            "task_fractions", "high_level", additional_rows(), F.col("mae_error").alias(name))

    return side(datasets[1:], "without_core").join(side(datasets, "with_core"),
                                                   ["task_fractions", "high_level", "extra"])


def core_benefit_curves(means: DataFrame, datasets: str, lowest: str, primary: str, cost="water") -> DataFrame:
    """Cost and error without and with the core set (two tasks), and the reference curve beside them."""
    return stack([*[_series(means, label, FULL, ("Multitask", label, 2, lowest), cost) for label in (datasets[1:], datasets)],
                  reference_curve(means, primary, cost)])


def percent_improvement(means: DataFrame, lowest: str, middle: str,
                        places: dict[str, list[tuple[int, int]]]) -> DataFrame:
    """``100*(two - three)/two`` per label and core size.

    ``places`` lists, per label, which place (by secondary rows) of the two-task
    curve is compared with which place of the three-task curve.
    """
    order = Window.partitionBy("datasets", "high_level").orderBy("low_level", "task_fractions")

    def curve(label: str, levels: int, low: str, name: str) -> DataFrame:
        cells = tuple_filter(means, FULL, [("Multitask", label, levels, low)])
        return cells.select("datasets", "high_level", F.row_number().over(order).alias(f"place_{name}"),
                            F.col("low_level").alias(f"low_{name}"), F.col("mae_error").alias(f"mae_{name}"))

    out = []
    for label, pairs in places.items():
        two = curve(label, 2, lowest, "two")
        three = curve(label, 3, lowest if label.endswith("T") else middle, "three")
        match = F.lit(False)
        for a, b in pairs:
            match = match | ((F.col("place_two") == a) & (F.col("place_three") == b))
        out.append(two.join(three, ["datasets", "high_level"]).where(match))
    gain = safe_div(100 * (F.col("mae_two") - F.col("mae_three")), F.col("mae_two"))
    return stack(out).select("datasets", "high_level", F.col("low_two").alias("low_level"), gain.alias("percent"))


def improvement_by_ratio(means: DataFrame, lowest: str, middle: str,
                         pairs: dict[str, list[tuple[float, float, float]]]) -> DataFrame:
    """``100*(two - three)/two`` of cells named by what they are made of, so that a missing run has no partner and moves no other pair.

    ``pairs`` lists, per label, (additional ratio of two tasks, that of three
    tasks, shared fraction of three tasks); labels without an additional set
    take 0 for the ratios. A cell is found by the number of secondary rows
    that its label, core size and ratio imply.
    """
    def cells(label: str, levels: int, low: str, ratio: float, share: float, name: str) -> DataFrame:
        size = expected_low_level(F.col("high_level"), F.lit(label), F.lit(levels - 1), F.lit(share), F.lit(ratio))
        return tuple_filter(means, [*FULL, "task_fractions"], [("Multitask", label, levels, low, share)]).where(
            F.col("low_level") == size).select("datasets", "high_level", F.col("low_level").alias(f"low_{name}"), F.col("mae_error").alias(f"mae_{name}"))

    out = []
    for label, wanted in pairs.items():
        for two, three, share in wanted:
            joined = cells(label, 2, lowest, two, 1.0, "two").join(
                cells(label, 3, lowest if label.endswith("T") else middle, three, share, "three"), ["datasets", "high_level"])
            out.append(joined.withColumn("ratio_two", F.lit(float(two))).withColumn("ratio_three", F.lit(float(three))).withColumn("shared", F.lit(share)))
    gain = safe_div(100 * (F.col("mae_two") - F.col("mae_three")), F.col("mae_two"))
    return stack(out).select("datasets", "high_level", "ratio_two", "ratio_three", "shared", "low_two", "low_three", gain.alias("percent"))


def difference_report(means: DataFrame, primary: str, lowest: str, datasets: tuple[str, str]) -> DataFrame:
    """Reference minus each of two labels and their difference, at equal core and additional sets."""
    ref = tuple_filter(means, ["method"], [(primary,)]).select("high_level", F.col("mae_error").alias("ref"))

    def side(label: str, name: str) -> DataFrame:
        return tuple_filter(means, FULL, [("Multitask", label, 2, lowest)]).select(
            "task_fractions", "high_level", additional_rows(), F.col("mae_error").alias(name))

    both = side(datasets[0], "m1").join(side(datasets[1], "m2"), ["task_fractions", "high_level", "extra"])
    return both.join(ref, "high_level").select(
        "task_fractions", "high_level", "extra", (F.col("ref") - F.col("m1")).alias("ref_1"),
        (F.col("ref") - F.col("m2")).alias("ref_2"), (F.col("m1") - F.col("m2")).alias("m1_2"))


def difference_summary(report: DataFrame) -> DataFrame:
    """Minimum, median and maximum of each difference of a report."""
    names = ["ref_1", "ref_2", "m1_2"]
    ties = ["task_fractions", "high_level", "extra"]
    long = report.select(*ties, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v"))
                                                   for c in names])).alias("e")).select(*ties, "e.name", "e.v")
    ends = long.groupBy("name").agg(F.min("v").alias("minimum"), F.max("v").alias("maximum"))
    return ends.join(medians(long, ["name"], "v", ties), "name")


def method_comparison(means: DataFrame, primary: str, lowest: str, difference_task: str, cost="water") -> DataFrame:
    """Ways to predict one difference: multi-task, chained and plain differences, multi-task on differences."""
    return stack([
        _series(means, "multitask", FULL, ("Multitask", "CAT", 3, lowest), cost),
        _series(means, "delta 3 levels", FULL, ("Delta", "CAT", 3, lowest), cost),
        _series(means, "delta 2 levels", ["method", "levels", "lowest"], ("Delta", 2, lowest), cost),
        _series(means, "multitask of differences", ["method", "datasets", "lowest"],
                ("Multitask", "CAT", difference_task), cost),
        reference_curve(means, primary, cost)])


def error_against_sigma(scaled: DataFrame) -> DataFrame:
    return scaled.withColumn("abs_error", F.abs(F.col("truth") - F.col("mu")))


def parameter_matrix(df: DataFrame, rows: list[str], column: str, values: list, metric: str) -> DataFrame:
    """Matrix of a metric for each parameter setting, one column per value of ``column``."""
    return df.groupBy(*rows).pivot(column, values).agg(F.avg(metric))


def search_study_view(study: DataFrame, tasks: list[str], sizes: list[int]) -> DataFrame:
    picked = tuple_filter(study, ["task", "n"], [(t, n) for t in tasks for n in sizes])
    return picked.select("task", "n", "mle_mae", "mae_mae")
