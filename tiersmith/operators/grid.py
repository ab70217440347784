"""Training-set compositions: cases, index intervals, membership and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tiersmith.functions.columns import case_label

CELL = ["scenario", "seed", "core", "c_ratio", "a_ratio", "shared"]


def _doubles(values: list[float] | str) -> Column:
    """A list of numbers, given as values or as the name of an array column."""
    return F.col(values) if isinstance(values, str) else F.array(*[F.lit(float(v)) for v in values])


def expand_cases(base: DataFrame, c_ratios: list[float] | str, a_ratios: list[float] | str,
                 shares: list[float] | str = (1.0,)) -> DataFrame:
    """Cases of every row of ``base(core, n_secondary, ...)``.

    The empty case (0, 0) is dropped unless it is the only one, and the shared
    fraction is 1 when there is at most one secondary task.
    """
    c, a, nothing = _doubles(c_ratios), _doubles(a_ratios), F.array(F.lit(0.0))
    share_list = F.when(F.col("n_secondary") > 1, _doubles(shares)).otherwise(_doubles([1.0]))
    out = (base.withColumn("__only", (F.array_distinct(c) == nothing) & (F.array_distinct(a) == nothing))
               .withColumn("c_ratio", F.explode(c)).withColumn("a_ratio", F.explode(a))
               .withColumn("shared", F.explode(share_list)))
    return out.where(F.col("__only") | (F.col("c_ratio") != 0) | (F.col("a_ratio") != 0)).drop("__only")


def split_interval(n: Column, k: Column, i: Column, shared: Column) -> dict[str, Column]:
    """Indices of task ``i`` of ``k``: 1..common_hi for all, then a block of its own.

    Block sizes are rounded half to even; the last task takes what is left.
    Blocks never run past ``n``.
    """
    common = F.ceil(shared * n).cast("bigint")
    unit = F.bround((n - common) / k, 0).cast("bigint")
    low = common + 1 + (i - 1) * unit
    whole = F.floor(n).cast("bigint")
    high = F.when(i < k, F.least(low + unit - 1, whole)).otherwise(whole)
    own = (shared < 1) & (high >= low)
    return {"common_hi": common, "uniq_lo": F.when(own, low), "uniq_hi": F.when(own, high)}


def split_positions(n: Column, k: Column, i: Column, shared: Column) -> Column:
    """The interval as an array of positions, common ones first."""
    iv = split_interval(n, k, i, shared)
    none = F.array().cast("array<bigint>")
    shared_part = F.when(iv["common_hi"] >= 1, F.sequence(F.lit(1).cast("bigint"), iv["common_hi"])).otherwise(none)
    own_part = F.when(iv["uniq_lo"].isNotNull(), F.sequence(iv["uniq_lo"], iv["uniq_hi"])).otherwise(none)
    return F.concat(shared_part, own_part)


def cell_positions(cells: DataFrame) -> DataFrame:
    """One row per (cell, task number, part, position); task 0 is the primary.

    Positions are dense ranks, so the later join with the sample is an
    equi-join instead of a range join.
    """
    core = F.col("core").cast("double")
    k = F.col("n_secondary")
    none = F.array().cast("array<bigint>")
    primary = F.struct(F.lit(0).alias("task_no"), F.lit("C").alias("part"), F.lit(0).cast("bigint").alias("skip"),
                       F.sequence(F.lit(1).cast("bigint"), F.col("core").cast("bigint")).alias("positions"))

    def secondary(i: Column) -> Column:
        c = F.when(F.col("c_ratio") > 0, split_positions(F.col("c_ratio") * core, k, i, F.col("shared"))).otherwise(none)
        a = F.when(F.col("a_ratio") > 0, split_positions(F.col("a_ratio") * core, k, i, F.col("shared"))).otherwise(none)
        no = i.cast("int").alias("task_no")
        return F.array(F.struct(no, F.lit("C").alias("part"), F.lit(0).cast("bigint").alias("skip"), c.alias("positions")),
                       F.struct(no, F.lit("A").alias("part"), F.size(c).cast("bigint").alias("skip"), a.alias("positions")))

    numbers = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    tasks = F.concat(F.array(primary), F.flatten(F.transform(numbers, secondary)))
    return (cells.withColumn("t", F.explode(tasks))
                 .select(*cells.columns, "t.task_no", "t.part", "t.skip", F.posexplode("t.positions").alias("p", "pos"))
                 .withColumn("ord", F.col("skip") + F.col("p") + 1).drop("skip", "p"))


def membership(cells: DataFrame, split: DataFrame, keep: list[str]) -> DataFrame:
    """Training rows of every cell; ``split(seed, part, pos, ...)`` is the sample."""
    pool = split.where(F.col("part") != "T").select("seed", "part", "pos", *keep)
    return cell_positions(cells).join(pool, ["seed", "part", "pos"])  # a broadcast hint on the sample holds here


def cell_counts(members: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Rows of the primary and of all secondary tasks per cell."""
    return members.groupBy(*cell).agg(
        F.sum(F.when(F.col("task_no") == 0, 1).otherwise(0)).alias("n_primary"),
        F.sum(F.when(F.col("task_no") > 0, 1).otherwise(0)).alias("n_secondary_rows"))


def level_members(members: DataFrame, cell: list[str], key: str) -> DataFrame:
    """Rows shared by neighbouring levels: level i joins task i-1 with task i on the row key."""
    upper = members.select(*cell, key, (F.col("task_no") + 1).alias("level"), "ord")
    lower = members.where(F.col("task_no") > 0).select(*cell, key, F.col("task_no").alias("level"))
    return upper.join(lower, [*cell, key, "level"], "left_semi")


def identifiers(counts: DataFrame, traits: dict[str, tuple[str | None, bool]]) -> DataFrame:
    """Result identifier of every cell; methods count their rows in different ways.

    ``counts`` carries kind, n_primary, n_secondary_rows, n_secondary, primary,
    last_task, c_ratio, a_ratio, shared. ``traits`` gives for each kind its name
    in the results, null for one that goes by its only task, and whether the
    target row's own value is counted.
    """
    kind = F.col("kind")
    alone, target = kind.isin([k for k, (name, _) in traits.items() if name is None]), kind.isin([k for k, (_, own) in traits.items() if own])
    named = F.coalesce(*[F.when(kind == k, F.lit(name)) for k, (name, _) in traits.items() if name is not None], F.lit(None).cast("string"))
    label = case_label(F.col("c_ratio"), F.col("a_ratio"))
    cols = {
        "levels": F.when(alone, 1).otherwise(F.col("n_secondary") + 1).cast("int"),
        "lowest": F.when(alone, F.col("primary")).otherwise(F.col("last_task")),
        "high_level": F.col("n_primary"),
        "low_level": F.when(alone, F.lit(0)).otherwise(F.col("n_secondary_rows") + target.cast("int")).cast("bigint"),
        "method": F.when(alone, F.col("primary")).otherwise(named),
        "datasets": F.when(alone, F.col("primary")).when(target, F.concat(label, F.lit("T"))).otherwise(label),
        "task_fractions": F.when(alone, F.lit(0.0)).otherwise(F.col("shared"))}
    return counts.select("*", *[c.alias(n) for n, c in cols.items()])


def expected_low_level(core: Column, label: Column, tasks: Column, shared: Column, max_ratio: Column) -> Column:
    """Number of secondary rows that a label implies (the one-letter labels included)."""
    core = core.cast("double")
    target = F.when(label.endswith("T"), 1).otherwise(0)
    common_c = F.ceil(core * shared)
    in_c = F.when(label.startswith("C"), common_c * tasks + core - common_c).otherwise(0)
    common_a = F.ceil(core * shared * max_ratio)
    has_a = F.substring(label, 1, 2).contains("A")
    in_a = F.when(has_a, common_a * tasks + F.ceil(core * max_ratio) - common_a).otherwise(0)
    return (target + in_c + in_a).cast("bigint")
