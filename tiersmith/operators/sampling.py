"""Seeded samples of exact size, splits and draws.

A row's place in a sample is the rank of md5(key-seed). The ranking needs no
shuffle of the table: on large tables hashes above a threshold are dropped while
scanning, and the threshold is widened if a seed should fall short, so the size
is exact. A null key is ranked as the empty text, on tables of any size.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from tiersmith.functions.columns import order_hash
from tiersmith.operators.rows import row_index

RANK_BY_SORT = 200_000
PREFILTER_ROWS = 200_000


def ranked_sample(df: DataFrame, key: str, n: int, seeds: list[int] = (0,), *, total: int | None = None,
                  out: str = "rank") -> DataFrame:
    """The first ``n`` rows of each seed's order with their rank; columns ``seed`` and ``rank`` are added.

    Small samples are ranked per seed after the threshold filter. Larger ones
    go through the bucketed index, so no task receives a whole sample.
    """
    total = df.count() if total is None else total
    if total < n:
        raise ValueError(f"cannot draw {n} of {total} rows")
    def hashed(seed):
        return order_hash(F.coalesce(F.col(key).cast("string"), F.lit("")), seed)

    def seeded(limit: str | None = None) -> DataFrame:
        """A row for each seed, those above the threshold not made."""
        wanted_seeds = F.array(*[F.lit(int(s)) for s in seeds])
        if limit is not None:
            wanted_seeds = F.filter(wanted_seeds, lambda s: hashed(s) < limit)
        return df.withColumn("seed", F.explode(wanted_seeds)).withColumn("__h", hashed(F.col("seed")))

    drawn = seeded()
    wanted = n + 8 * sqrt(n) + 64
    while total > PREFILTER_ROWS and wanted < total:
        below = seeded(format(ceil(wanted / total * 2**32), "08x"))
        found = below.groupBy("seed").count().agg(F.min("count").alias("least"), F.count("*").alias("seeds")).first()
        if found["seeds"] == len(seeds) and found["least"] >= n:
            drawn = below
            break
        wanted *= 2
    if n <= RANK_BY_SORT:
        order = Window.partitionBy("seed").orderBy("__h", key)
        ranked = drawn.withColumn(out, F.row_number().over(order).cast("bigint"))
    else:
        ranked = row_index(drawn, ["__h", key], group=["seed"], out=out)
    return ranked.where(F.col(out) <= n).drop("__h")


def shuffled(df: DataFrame, key: str, seed: int, out: str = "row_idx") -> DataFrame:
    """Every row with its position in a seeded shuffle."""
    return row_index(df.withColumn("__h", order_hash(F.col(key), seed)), ["__h", key], out=out).drop("__h")


def sample_excluding(df: DataFrame, key: str, reserved: DataFrame, n: int, seeds: list[int]) -> DataFrame:
    """Exact sample of the rows that are not reserved."""
    return ranked_sample(df.join(reserved.select(key), key, "left_anti"), key, n, seeds)


def augmented_draw(indexed: DataFrame, key: str, reserved: DataFrame, match: int, n: int, m: int,
                   seed: int) -> DataFrame:
    """``n`` unreserved rows among the first ``match`` positions and ``m - n`` of the rest."""
    near = sample_excluding(indexed.where(F.col("row_idx") <= match), key, reserved, n, [seed])
    far = ranked_sample(indexed.where(F.col("row_idx") > match), key, m - n, [seed])
    return (near.withColumn("stratum", F.lit("matched"))
                .unionByName(far.withColumn("stratum", F.lit("extra"))
                                .withColumn("rank", F.col("rank") + n)))


def draw_with_replacement(indexed: DataFrame, total: int, n: int, seed: int) -> DataFrame:
    """``n`` independent uniform positions, gathered in draw order."""
    digits = F.substring(order_hash(F.col("ord"), seed), 1, 12)
    draws = (indexed.sparkSession.range(1, n + 1).withColumnRenamed("id", "ord")
                    .withColumn("row_idx", F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(total)) + 1))
    return draws.join(indexed, "row_idx")


def split_parts(target: int, core: int, extra: int) -> Column:
    """Part of a ranked row: target T, then core C, then additional A."""
    r = F.col("rank")
    return F.when(r <= target, "T").when(r <= target + core, "C").when(r <= target + core + extra, "A")


def nested_split(df: DataFrame, key: str, target: int, core: int, extra: int, seeds: list[int]) -> DataFrame:
    """Disjoint parts of exact size from one ranking; ``pos`` is the 1-based position in the part."""
    ranked = ranked_sample(df, key, target + core + extra, seeds)
    start = F.when(F.col("part") == "T", 0).when(F.col("part") == "C", target).otherwise(target + core)
    return (ranked.withColumn("part", split_parts(target, core, extra))
                  .withColumn("pos", F.col("rank") - start).drop("rank"))


def holdout_split(df: DataFrame, key: str, seed: int, total: int | None = None) -> DataFrame:
    """``2*(n div 3)`` rows to train, the others to test, as the column ``part``."""
    total = df.count() if total is None else total
    ranked = row_index(df.withColumn("__h", order_hash(F.col(key), seed)), ["__h", key], n=total, out="rank")
    n_train = 2 * (total // 3)
    return ranked.withColumn("part", F.when(F.col("rank") <= n_train, "train").otherwise("test")).drop("__h")
