"""Tuple filters, difference columns, products, set operations and keyed look-ups."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

INLINE_TUPLES = 64
MAX_LIST = 10_000


def tuple_match(columns: list[str], selectors: list[tuple]) -> Column:
    """True when the tuple of columns equals one of the selectors; null when undecided."""
    tests = [reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(columns, s)]) for s in selectors]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def tuple_filter(df: DataFrame, columns: list[str], selectors: list[tuple] | DataFrame) -> DataFrame:
    """Rows whose tuple of columns is in a set of tuples.

    A short list becomes a predicate that reaches the scan; a table of tuples
    is semi-joined and the optimizer picks the strategy from its size.
    """
    if isinstance(selectors, DataFrame):
        return df.join(selectors.select(*columns), columns, "left_semi")
    if len(selectors) <= INLINE_TUPLES:
        return df.where(tuple_match(columns, selectors))
    return tuple_filter(df, columns, df.sparkSession.createDataFrame(selectors, df.select(*columns).schema))


def tuple_split(df: DataFrame, columns: list[str],
                selectors: list[tuple] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matching rows and the rest; tuples with a null belong to the rest."""
    if isinstance(selectors, DataFrame):
        keys = selectors.select(*columns)
        return df.join(keys, columns, "left_semi"), df.join(keys, columns, "left_anti")
    hit = F.coalesce(tuple_match(columns, selectors), F.lit(False))
    return df.where(hit), df.where(~hit)


def range_filter(df: DataFrame, columns: list[str], lower: list, upper: list) -> DataFrame:
    """All columns inside their half-open interval [lower, upper)."""
    tests = [(F.col(c) >= F.lit(lo)) & (F.col(c) < F.lit(hi)) for c, lo, hi in zip(columns, lower, upper)]
    return df.where(reduce(lambda a, b: a & b, tests))


def difference_columns(df: DataFrame, tasks: list[str]) -> DataFrame:
    """Add the difference of every ordered pair of tasks under the name ``a_b``."""
    return df.select("*", *[(F.col(a) - F.col(b)).alias(f"{a}_{b}") for a, b in permutations(tasks, 2)])


def scaled_residual(df: DataFrame, primary: str, secondary: str, out: str = "residual") -> DataFrame:
    """``secondary - rho*primary`` with rho the correlation over all rows of ``df``."""
    rho = df.agg(F.corr(primary, secondary).alias("rho")).scalar()
    return df.withColumn(out, F.col(secondary) - rho * F.col(primary))


def ordered_pairs(items: DataFrame, item: str) -> DataFrame:
    """All ordered pairs of distinct items of a small list, from one aggregated array."""
    return _pairs(items, item, lambda x, y: x != y)


def combinations2(items: DataFrame, item: str) -> DataFrame:
    """All pairs a < b of a small list."""
    return _pairs(items, item, lambda x, y: x < y)


def _bounded(items: DataFrame, item: str) -> DataFrame:
    """The distinct values; a list beyond ``MAX_LIST`` is an error before anything is gathered, for these are lists of names."""
    values = items.select(item).distinct()
    if values.limit(MAX_LIST + 1).count() > MAX_LIST:
        raise ValueError(f"{item}: more than {MAX_LIST} distinct values")
    return values


def _pairs(items: DataFrame, item: str, keep) -> DataFrame:
    everything = _bounded(items, item).agg(F.collect_set(item).alias("a")).select(F.explode("a").alias("left_item"), "a")
    partners = F.filter("a", lambda y: keep(F.col("left_item"), y))
    return everything.select("left_item", F.explode(partners).alias("right_item"))


def parameter_product(**lists: DataFrame) -> DataFrame:
    """Product of parameter lists (one single-column table each), as nested explodes of arrays."""
    out = None
    for name, table in lists.items():
        values = _bounded(table, table.columns[0]).agg(F.collect_set(table.columns[0])).scalar()
        base = table.sparkSession.range(1).select(values.alias("__v")) if out is None else out.withColumn("__v", values)
        out = base.withColumn(name, F.explode("__v")).drop("__v")
    return out


def index_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.join(b.select(*key), key, "left_anti")


def index_intersection(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.join(b.select(*key), key, "left_semi")


def stack(parts: list[DataFrame]) -> DataFrame:
    """Vertical concatenation by column name; empty parts need no special case."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def stack_tagged(parts: dict[str, DataFrame], tag: str = "proc") -> DataFrame:
    """Blocks of rows under their process label."""
    return stack([df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def join_groups(left: DataFrame, right: DataFrame, group: list[str], how: str = "inner") -> DataFrame:
    """Join on group columns where null is a group like any other; ``right`` has one row per group."""
    names = {g: f"__right_{g}" for g in group}
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(n)) for g, n in names.items()])
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Horizontal concatenation of two indexed tables of equal length.

    A position that one side lacks raises an error instead of losing a row.
    """
    l = left.withColumn("__l", F.lit(True))
    r = right.withColumn("__r", F.lit(True))
    whole = F.col("__l") & F.col("__r")
    return (l.join(r, "row_idx", "full")
             .where(F.assert_true(F.coalesce(whole, F.lit(False)), "tables differ in length").isNull())
             .drop("__l", "__r"))


def lookup_parameters(wanted: DataFrame, params: DataFrame) -> DataFrame:
    """Parameters of ``wanted(ord, task)`` in the given order; an unknown task and one with several rows are errors."""
    asked = params.join(wanted.select("task").distinct(), "task", "left_semi")  # a log may have very many rows of other tasks
    own = [F.col(c) for c in params.columns if c != "task"]
    hit = asked.groupBy("task").agg(F.count("*").alias("__rows"), F.any_value(F.struct(*own)).alias("__p"))
    text = F.concat(F.when(F.col("__rows").isNull(), F.lit("no parameters for task ")).otherwise(F.lit("several parameter rows for task ")), F.col("task"))
    return (wanted.join(hit, "task", "left")
                  .where(F.assert_true(F.coalesce(F.col("__rows") == 1, F.lit(False)), text).isNull())
                  .select("*", "__p.*").drop("__p", "__rows"))


def parameter_bundle(wanted: DataFrame, params: DataFrame, key: list[str]) -> DataFrame:
    """One row per model with its ordered arrays of variance, lengthscale and rho."""
    rows = lookup_parameters(wanted, params)
    packed = F.array_sort(F.collect_list(F.struct("ord", "variance", "lengthscale", "rho")))
    return rows.groupBy(*key).agg(packed.alias("p")).select(
        *key, F.col("p.variance").alias("v"), F.col("p.lengthscale").alias("l"), F.col("p.rho").alias("rho"))


def accepted(log: DataFrame, cap: float) -> DataFrame:
    """Search results that converged with a variance below the cap."""
    return log.where(F.col("converged") & (F.col("variance") < cap))


def back_transform(df: DataFrame) -> DataFrame:
    """Totals of a difference prediction: ``factor*(baseline + .)`` for prediction and truth."""
    return (df.withColumn("mu_total", F.col("factor") * (F.col("baseline") + F.col("mu")))
              .withColumn("truth_total", F.col("factor") * (F.col("baseline") + F.col("truth"))))


def wide_to_long_costs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns named ``method-suffix`` to rows (method, suffix, seconds)."""
    long = df.select(*[F.col(f"`{c}`") for c in columns]).unpivot([], [F.col(f"`{c}`") for c in columns],
                                                                 "name", "seconds")
    parts = F.split("name", "-")
    return long.select(parts[0].alias("method"), parts[1].cast("int").alias("suffix"), "seconds")


def mean_costs(long: DataFrame) -> DataFrame:
    return long.groupBy("method", "suffix").agg(F.avg("seconds").alias("seconds"))


def interaction_energy(energies: DataFrame) -> DataFrame:
    """Energy of the whole minus the sum over its pairs, per molecule and method, with total seconds."""
    signed = F.when(F.col("kind") == "trimer", F.col("energy")).otherwise(-F.col("energy"))
    return energies.groupBy("mol_id", "method").agg(F.sum(signed).alias("interaction"),
                                                    F.sum("seconds").alias("seconds"))
