"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tiersmith.llm.frames import written

#: Smallest neighbours are broadcast up to this number of nodes (some 50 MB); beyond, they are joined by shuffle.
BROADCAST_NODES = 1_000_000
#: A table that has no more rows than this for each task is written by fewer tasks.
ROWS_PER_TASK = 100_000


def _kept(df: DataFrame, what: str, most: int | None = None) -> tuple[DataFrame, tuple[int, int]]:
    """A table (u, v) written, with its number of rows and the sum of their hashes, taken while it is written.

    ``most`` is about how many rows it can have, if that is known; the tasks are put together accordingly.
    """
    seen = Observation()
    df = df if most is None else df.coalesce(max(1, -(-most // ROWS_PER_TASK)))
    values = F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")
    out = written(df.observe(seen, *values), what)
    return out, (seen.get["n"], seen.get["x"])


def _with_least(edges: DataFrame, least: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Edges with m, the smallest neighbour of u, and that table; it is written, so that a join by shuffle can be split at a hot node."""
    least, (n, _) = _kept(least.toDF("u", "v"), "least", most)
    least = least.toDF("u", "m")
    return edges.join(F.broadcast(least) if n <= BROADCAST_NODES else least, "u"), least


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest node around it. No neighbourhood is gathered."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    around = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both.where("v > u"), around, 2 * rows)[0].select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, are linked with the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined, least = _with_least(down, down.groupBy("u").agg(F.min("v").alias("m")), rows)
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge between different nodes; the component is its smallest node.

    Each round is written to the shared folder, and so are the smallest
    neighbours, whose join is thereby one that adaptive execution can split at a
    node with very many neighbours. Loops and repeated edges are
    harmless; an edge with a null end is no edge; without edges the result is empty.
    """
    at = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    at, before = _kept(at.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        at, now = _kept(_small_star(_large_star(at, before[0]), before[0]), "stars", 2 * before[0])
        if now == before:
            return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components not stable after {rounds} rounds")
