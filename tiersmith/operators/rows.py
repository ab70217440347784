"""Row positions: dense index in key order, gathers, sections, prefix sums.

Positions never rely on the physical order of a DataFrame. The index is built
without a one-partition window: quantiles of a sample of the keys become
constant bucket boundaries, each bucket is ranked on its own, and the sums of
the earlier buckets are added. A key that holds a large share of the rows is
split because the boundaries range over the whole (tie-broken) sort key.
"""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from tiersmith.session import cut_lineage

ROWS_PER_BUCKET = 50_000
MAX_BUCKETS = 4096
SAMPLE_PER_BUCKET = 48
TREE_BOUNDS = 64


def _bucket(df: DataFrame, keys: list[str], n: int) -> Column | None:
    """Number of the key-range bucket of a row, from sampled constant boundaries; None when one will do."""
    n_buckets = min(MAX_BUCKETS, ceil(n / ROWS_PER_BUCKET))
    if n_buckets <= 1:
        return None
    wanted = SAMPLE_PER_BUCKET * n_buckets
    sample = df.select(*keys).sample(min(1.0, wanted / n), seed=17).orderBy(*keys).collect()
    step = max(1, len(sample) // n_buckets)
    cuts = sorted(set(range(step, len(sample), step)))
    bounds = [[sample[i][k] for k in keys] for i in cuts]
    if not bounds:
        return None
    if len(bounds) <= TREE_BOUNDS:
        return _search_tree(keys, bounds, 0, len(bounds))
    types = dict(df.select(*keys).dtypes)
    width = max(isqrt(len(bounds)) + 1, ceil(len(bounds) / TREE_BOUNDS))
    chunks = [bounds[i:i + width] for i in range(0, len(bounds), width)]
    top = _search_tree(keys, [c[0] for c in chunks], 0, len(chunks))
    literal = F.array(*[F.array(*[F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(keys, b)]) for b in c])
                        for c in chunks])
    key = F.struct(*keys)
    inner = F.size(F.filter(F.element_at(literal, F.greatest(top, F.lit(1))), lambda b: b <= key))
    return F.when(top == 0, F.lit(0)).otherwise((top - 1) * width + inner)


def _search_tree(keys: list[str], bounds: list[list], lo: int, hi: int) -> Column:
    """Number of bounds at or below the key, as nested comparisons that compile to plain branches."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(_before(keys, bounds[mid]), _search_tree(keys, bounds, lo, mid)) \
            .otherwise(_search_tree(keys, bounds, mid + 1, hi))


def _before(keys: list[str], bound: list) -> Column:
    """Key strictly below a bound in sort order, nulls first."""
    test = F.lit(False)
    for k, v in reversed(list(zip(keys, bound))):
        c = F.col(k)
        if v is None:
            test = c.isNull() & test
        else:
            test = c.isNull() | (c < F.lit(v)) | ((c == F.lit(v)) & test)
    return test


def running_sum(df: DataFrame, order_by: list[str], weight: str | None = None, *,
                group: list[str] | None = None, out: str = "row_idx", total: str | None = None,
                n: int | None = None, source: DataFrame | None = None) -> DataFrame:
    """Inclusive running sum of ``weight`` (1 when absent) in key order, per group.

    ``order_by`` must break ties. ``total`` names a column for the sum of the
    whole group. The pass over the keys that fixes the boundaries runs at once;
    the result itself is lazy. ``source`` may name a cheaper table with the same
    keys and weights for the passes that only count.
    """
    group = group or []
    source = df if source is None else source
    n = source.count() if n is None else n
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    if n > MAX_BUCKETS * ROWS_PER_BUCKET:
        return _running_sum_by_range(df, order_by, w, group, out, total, n)
    bucket = _bucket(source, [*group, *order_by], n)
    if bucket is None:  # at most ROWS_PER_BUCKET rows in all
        local = Window.partitionBy(*group).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        extra = {} if total is None else {total: F.sum(w).over(Window.partitionBy(*group))}
        return df.withColumns({out: F.sum(w).over(local), **extra})
    whole = F.struct(*group) if group else F.lit(0)
    keyed = df.withColumn("__b", bucket).withColumn("__g", whole)
    counted = source.withColumn("__b", bucket).withColumn("__g", whole)
    sums = counted.groupBy("__g", "__b").agg(F.sum(w).alias("__s"))
    before = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__g", "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"),
                          F.sum("__s").over(Window.partitionBy("__g")).alias("__t"))
    inside = (Window.partitionBy("__g", "__b").orderBy(*order_by)
                    .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The window comes first: the join then needs no exchange of the rows of its own.
    joined = keyed.withColumn("__w", F.sum(w).over(inside)).join(offsets, ["__g", "__b"]) \
                  .withColumn(out, F.col("__o") + F.col("__w"))
    if total is not None:
        joined = joined.withColumn(total, F.col("__t"))
    return joined.drop("__g", "__b", "__o", "__w", "__t")


def _running_sum_by_range(df: DataFrame, order_by: list[str], w: Column, group: list[str], out: str, total: str | None, n: int) -> DataFrame:
    """The same for tables with too many buckets for constant boundaries.

    One range shuffle over the whole key makes the buckets, and its result is
    stored, so that the sums and the rows see the same buckets. The buckets'
    sums are prefix-summed by this module again.
    """
    keys = [*group, *order_by]
    ranged = cut_lineage(df.withColumn("__x", w).repartitionByRange(ceil(n / ROWS_PER_BUCKET), *keys)
                           .withColumn("__b", F.spark_partition_id()).withColumn("__g", F.struct(*group) if group else F.lit(0)))
    sums = ranged.groupBy("__g", "__b").agg(F.sum("__x").alias("__s"))
    offsets = running_sum(sums, ["__b"], "__s", group=["__g"], out="__o", total="__t").withColumn("__o", F.col("__o") - F.col("__s"))
    inside = Window.partitionBy("__g", "__b").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = ranged.withColumn("__w", F.sum("__x").over(inside)).join(offsets.drop("__s"), ["__g", "__b"]) \
                   .withColumn(out, F.col("__o") + F.col("__w"))
    if total is not None:
        joined = joined.withColumn(total, F.col("__t"))
    return joined.drop("__g", "__b", "__o", "__w", "__t", "__x")


def row_index(df: DataFrame, order_by: list[str], *, group: list[str] | None = None, out: str = "row_idx",
              total: str | None = None, n: int | None = None, source: DataFrame | None = None) -> DataFrame:
    """Dense 1-based index in key order, over all rows or within groups; ``total`` names a group size column."""
    return running_sum(df, order_by, group=group, out=out, total=total, n=n, source=source)


def gather(indexed: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows at the listed positions; ``positions(ord, row_idx)`` may repeat a position."""
    return positions.select("ord", "row_idx").join(indexed, "row_idx")


def row_range(indexed: DataFrame, first: int, last: int) -> DataFrame:
    return indexed.where(F.col("row_idx").between(first, last))


def shard(indexed: DataFrame, k: int, n: int) -> DataFrame:
    """Every n-th row starting from the (k+1)-th."""
    return indexed.where(F.pmod(F.col("row_idx") - 1, F.lit(n)) == k)


def filter_positions(indexed: DataFrame, column: str, value) -> DataFrame:
    """Positions whose column is identical to a value, where null is identical to null."""
    return indexed.where(F.col(column).eqNullSafe(F.lit(value))).select("row_idx")


def section_of(n: int, split: int) -> Column:
    """Section number of a position: equal sections, the remainder joins the last one."""
    if n < split:
        raise ValueError(f"cannot cut {n} rows into {split} sections")
    size = n // split
    return F.least(F.floor((F.col("row_idx") - 1) / F.lit(size)) + 1, F.lit(split)).cast("int")


def sections(indexed: DataFrame, n: int, split: int, select: list[int]) -> DataFrame:
    """Rows of the selected sections, with ``ord`` counting them in the order of ``select``.

    The remainder of the division is returned only when the last selected
    section is the last section.
    """
    size = n // split
    starts = {s: [j * size for j, t in enumerate(select) if t == s] for s in set(select)}
    sec = section_of(n, split)
    found = F.lit(None).cast("array<int>")
    for s, at in starts.items():
        found = F.when(sec == s, F.array(*[F.lit(v) for v in at])).otherwise(found)
    remainder = F.col("row_idx") > split * size
    last = F.array(F.lit((len(select) - 1) * size)) if select[-1] == split else F.array().cast("array<int>")
    return (indexed.where(sec.isin(select))
                   .withColumn("__at", F.explode(F.when(remainder, last).otherwise(found)))
                   .withColumn("ord", F.col("__at") + F.col("row_idx") - (sec - 1) * size)
                   .drop("__at"))


def first_part(indexed: DataFrame, n: int, split: int = 2) -> DataFrame:
    return indexed.where(F.col("row_idx") <= n // split)


def rest_part(indexed: DataFrame, n: int, split: int = 2) -> DataFrame:
    """Everything after the first section."""
    return indexed.where(F.col("row_idx") > n // split)


def exchange(core: DataFrame, n_core: int, other: DataFrame, n_other: int, split: int = 2) -> DataFrame:
    """Replace part of a set of ``n_other`` rows by rows of the core set; new positions."""
    keep = n_other - n_other // split
    if keep > n_core:
        head, tail, n_head = core, row_range(other, 1, n_other - n_core), n_core
    else:
        head, tail, n_head = row_range(core, 1, keep), first_part(other, n_other, split), keep
    return head.unionByName(tail.withColumn("row_idx", F.col("row_idx") + F.lit(n_head)))


def replace_last(indexed: DataFrame, n: int, column: str, value) -> DataFrame:
    return indexed.withColumn(column, F.when(F.col("row_idx") == n, F.lit(value)).otherwise(F.col(column)))


def exchange_replace_last(core: DataFrame, n_core: int, other: DataFrame, n_other: int,
                          column: str, value, split: int = 2) -> DataFrame:
    swapped = exchange(core, n_core, other, n_other, split)
    keep = n_other - n_other // split
    total = n_other if keep > n_core else keep + n_other // split
    return replace_last(swapped, total, column, value)


def attach_by_position(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the row at the same position of another table."""
    return left.join(right.select("row_idx", *columns), "row_idx")
