"""Pooling of per-atom vectors into one vector per structure.

A null vector takes no part in a mean; a structure or species without any
vector keeps its row with nulls. All vectors have one length: the given one or
the largest of the table, and any other length is an error. The same holds
whichever of the two plans the length selects.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tiersmith.operators.rows import row_index

WIDE_LIMIT = 512


def _dim(df: DataFrame, column: str) -> int:
    return df.agg(F.coalesce(F.max(F.size(column)), F.lit(0))).first()[0] if column in df.columns else 0


def _checked(df: DataFrame, dim: int) -> DataFrame:
    """Vectors of another length are an error."""
    fits = F.coalesce(F.size("f") == dim, F.lit(True)) | F.col("f").isNull()
    return df.withColumn("f", F.when(F.assert_true(fits, F.lit(f"a vector is not of length {dim}")).isNull(), F.col("f")))


def mean_pool(local: DataFrame, keys: list[str], dim: int | None = None) -> DataFrame:
    """Mean vector per key.

    Up to ``WIDE_LIMIT`` components the sums are separate aggregates, so a large
    structure is reduced before the only shuffle. Longer vectors are summed in
    (key, component) form.
    """
    dim = max(_dim(local, "f"), 0) if dim is None else dim
    local = _checked(local, dim)
    if dim <= WIDE_LIMIT:
        sums = [F.sum(F.col("f")[i]).alias(f"s{i}") for i in range(dim)]
        agg = local.groupBy(*keys).agg(F.count("f").alias("n"), *sums)
        return agg.select(*keys, F.array(*[F.try_divide(f"s{i}", "n") for i in range(dim)]).alias("x"))
    blank = F.array_repeat(F.lit(None).cast("double"), dim)
    parts = (local.select(*keys, F.col("f").isNotNull().cast("int").alias("__there"), F.posexplode(F.coalesce("f", blank)).alias("pos", "v"))
                  .groupBy(*keys, "pos").agg(F.try_divide(F.sum("v"), F.sum("__there")).alias("v")))
    return parts.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("x"))


def concat_pool(local: DataFrame, dim: int | None = None) -> DataFrame:
    """Local vectors laid end to end in atom order, as rows (mol_id, pos, value).

    The long form keeps a structure with very many atoms in many rows.
    """
    dim = _dim(local, "f") if dim is None else dim
    placed = row_index(local.select("mol_id", "atom_idx", "f"), ["atom_idx"], group=["mol_id"], out="__a")
    return (placed.select("mol_id", "__a", F.posexplode("f").alias("d", "value"))
                  .select("mol_id", ((F.col("__a") - 1) * dim + F.col("d") + 1).alias("pos"), "value"))


def species_pool(local: DataFrame, species: list[str], isolated: DataFrame | None = None,
                 dim: int | None = None) -> DataFrame:
    """Mean vector per species, concatenated in the order of ``species``.

    A species that a structure lacks contributes the vector of the isolated
    atom, or nulls when ``isolated(species, x)`` is not given.
    """
    dim = max(_dim(local, "f"), 0) if dim is None else dim
    if dim * len(species) > WIDE_LIMIT:
        return _species_pool_long(local, species, isolated, dim)
    local = _checked(local, dim)
    sums = []
    for j, s in enumerate(species):
        mine = (F.col("species") == s) & F.col("f").isNotNull()
        sums.append(F.count(F.when(mine, 1)).alias(f"n{j}"))
        sums += [F.sum(F.when(mine, F.col("f")[i])).alias(f"s{j}_{i}") for i in range(dim)]
    agg = local.groupBy("mol_id").agg(*sums)
    blank = F.array_repeat(F.lit(None).cast("double"), dim)
    if isolated is not None:  # one row per species: a map of a few vectors
        entry = F.map_from_entries(F.collect_list(F.struct("species", "x")))
        agg = agg.withColumn("__iso", isolated.where(F.col("species").isin(species)).agg(entry).scalar())
    parts = []
    for j, s in enumerate(species):
        mean = F.array(*[F.try_divide(f"s{j}_{i}", f"n{j}") for i in range(dim)])
        absent = blank if isolated is None else F.coalesce(F.col("__iso")[s], blank)
        parts.append(F.when(F.col(f"n{j}") > 0, mean).otherwise(absent))
    return agg.select("mol_id", F.concat(*parts).alias("x"))


def _species_pool_long(local: DataFrame, species: list[str], isolated: DataFrame | None, dim: int) -> DataFrame:
    """The same for vectors too long for separate aggregates: pool by (structure, species), then line up."""
    pooled = mean_pool(local.where(F.col("species").isin(species) & F.col("f").isNotNull()), ["mol_id", "species"], dim)
    slots = local.select("mol_id").distinct().withColumn("species", F.explode(F.array(*[F.lit(s) for s in species])))
    filled = slots.join(pooled, ["mol_id", "species"], "left")
    if isolated is not None:
        filled = filled.join(isolated.select("species", F.col("x").alias("__iso")), "species", "left") \
                       .withColumn("x", F.coalesce("x", "__iso"))
    blank = F.array_repeat(F.lit(None).cast("double"), dim)
    picks = [F.coalesce(F.max(F.when(F.col("species") == s, F.col("x"))), blank) for s in species]
    return filled.groupBy("mol_id").agg(F.concat(*picks).alias("x"))


def pool(local: DataFrame, how: str | Callable[[DataFrame], DataFrame] = "mean",
         select: Callable[[DataFrame], DataFrame] | None = None, **options) -> DataFrame:
    """Pooled vectors (mol_id, x) with a pluggable choice of atoms and of pooling."""
    chosen = local if select is None else select(local)
    if callable(how):
        return how(chosen)
    return {"mean": lambda d: mean_pool(d, ["mol_id"], **options),
            "species": lambda d: species_pool(d, **options),
            "concat": lambda d: concat_pool(d, **options)}[how](chosen)


def pair_difference(pooled: DataFrame, pairs: DataFrame) -> DataFrame:
    """Difference of the pooled vectors of listed pairs (mol_a, mol_b)."""
    a = pooled.select(F.col("mol_id").alias("mol_a"), F.col("x").alias("xa"))
    b = pooled.select(F.col("mol_id").alias("mol_b"), F.col("x").alias("xb"))
    return (pairs.join(a, "mol_a").join(b, "mol_b")
                 .select("mol_a", "mol_b", F.zip_with("xa", "xb", lambda p, q: p - q).alias("x")))


def frobenius_normalise(local: DataFrame) -> DataFrame:
    """Local vectors divided by the Frobenius norm of their structure's matrix."""
    norms = (local.select("mol_id", F.aggregate("f", F.lit(0.0), lambda s, v: s + v * v).alias("q"))
                  .groupBy("mol_id").agg(F.sqrt(F.sum("q")).alias("norm")))
    return local.join(norms, "mol_id").withColumn("f", F.transform("f", lambda v: v / F.col("norm"))).drop("norm")


def heavy_atoms(local: DataFrame) -> DataFrame:
    return local.where(F.col("species") != "H")


def exploded_atoms(structures: DataFrame) -> DataFrame:
    return structures.select("file", "frame", F.posexplode("atoms").alias("atom_idx", "a")) \
                     .select("file", "frame", "atom_idx", "a.symbol", "a.x", "a.y", "a.z")


def geometry_line(symbol: Column, x: Column, y: Column, z: Column) -> Column:
    return F.concat_ws(" ", symbol, x.cast("string"), y.cast("string"), z.cast("string"))


def geometry_text(structures: DataFrame, fragments: list[list[int]] | None = None) -> DataFrame:
    """Text block of a structure: one line per atom, ``--`` between fragments."""
    def block(atoms: Column) -> Column:
        return F.array_join(F.transform(atoms, lambda a: geometry_line(a["symbol"], a["x"], a["y"], a["z"])), "\n")

    if fragments is None:
        text = block(F.col("atoms"))
    else:
        text = F.concat_ws("\n--\n", *[block(F.array(*[F.get("atoms", F.lit(i)) for i in f])) for f in fragments])
    return structures.select("file", "frame", text.alias("geometry"))


def fragment_expansion(atoms: DataFrame, fragments: dict[str, list[int]], size: int) -> DataFrame:
    """Atoms of every ``size``-subset of fragments; an atom appears once per subset that holds its fragment."""
    subsets = {}
    for names in combinations(sorted(fragments), size):
        for name in names:
            for i in fragments[name]:
                subsets.setdefault(i, []).append("".join(names))
    entries = [v for i, labels in sorted(subsets.items())
               for v in (F.lit(i), F.array(*[F.lit(s) for s in labels]))]
    where = F.create_map(*entries)
    return atoms.withColumn("fragment", F.explode(F.element_at(where, F.col("atom_idx").cast("int"))))
